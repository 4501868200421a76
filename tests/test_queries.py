"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kgloom.plans import queries

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", ["iri_template", "rewrite_triples", "block_cleaning", "entity_link_best", "link_validation", "align_fine", "merge", "fact_scores", "bnode_closure", "sink_ntriples", "sink_matches", "sink_clusters", "csv_source", "turtle_source", "embedding_source", "count_reader", "invoker_icd9", "invoker_lab", "transcribe", "schema_mapping_files", "alignment_files"])
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    assert rows(df.columns, [list(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_registry_imports_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
