"""Operators over DataFrames: triples, look-ups, linking, link checks, facts, alignment."""
