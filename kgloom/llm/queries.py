"""The queries of this package and their SQL, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import capfilters, html_text, jaccard, languages, lines, mixing, neighbours, pieces, quality, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op5_mixing": mixing.op5_mixing,
    "op6_language_id": languages.op6_language_id,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_embedding_dedup": capfilters.op8_embedding_dedup,
    "op9_quality": quality.op9_quality,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}

SQL: dict[str, str] = {
    "op8_embedding_dedup": capfilters.OP8_SQL,
    "op3_line_dedup": lines.OP3_SQL, "op5_mixing": mixing.OP5_SQL, "op7_ngram_jaccard": jaccard.OP7_SQL, "op10_substring_dedup": substrings.OP10_SQL}
