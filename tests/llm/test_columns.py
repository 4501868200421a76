"""Every operator over a table whose columns are named like its own, with nulls, ties and repeated rows, and over an empty one."""

import pytest
from pyspark.sql import functions as F

from kgloom.llm import capfilters, html_text, jaccard, languages, lines, mixing, neighbours, pieces, quality, substrings

TEXT = {
    "quality": (lambda d: quality.scored(d, None), ["score"]),
    "languages": (lambda d: languages.identified(d, None), ["lang_pred", "score", "rejected", "entropy"]),
    "learned languages": (lambda d: languages.identified(d, languages.trained(d.withColumn("lang", F.lit("en")))), ["lang_pred", "score", "rejected", "entropy"]),
    "language tables": (lambda d: languages.identified(d, languages.trained(d.withColumn("lang", F.lit("en")), 0)), ["lang_pred", "score", "rejected", "entropy"]),
    "lines": (lines.dedup_lines, ["n_lines", "n_dropped"]),
    "substrings": (substrings.dedup_substrings, ["n_words", "n_removed"]),
    "encode": (pieces.encode, ["ids"]),
    "decode": (lambda d: pieces.decode(pieces.encode(d)), ["ids", "decoded"]),
    "mixed": (mixing.whole_documents, []),
    "unlike": (jaccard.one_of_each, []),
}
ROWS = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, None, None), (None, "x y", None), (2, "", "s"), (3, "Ab cd. " * 4000, "t")]
INNER = ["id", "version", "row", "text_", "_block", "marks", "drop", "lines", "at", "h1", "times", "bag", "_id", "gram", "c0", "size", "position"]


def made(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.lit("clash").alias(c) for c in INNER])


@pytest.mark.parametrize("name", sorted(TEXT))
def test_columns(spark, name):
    operator, made_columns = TEXT[name]
    docs = made(spark, ROWS)
    plain = operator(docs)
    clashing = operator(docs.select("*", *[F.lit("other").alias(c) for c in made_columns]))
    assert sorted(map(str, clashing.columns)) == sorted(plain.columns) and set(docs.columns) <= set(plain.columns)
    rows = clashing.select(*plain.columns).collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain.collect()))
    assert all(r[c] == "clash" for r in rows for c in INNER)
    assert operator(made(spark, [])).collect() == []


def test_vectors(spark):
    rows = [(2**60 + i, [float(i % 3), 1.0], "c") for i in range(9)] + [(None, [0.0, 1.0], "c"), (None, None, "c"), (7, [float("nan"), 1.0], "c"), (8, [5.0, 5.0], "c"), (8, [6.0, 5.5], "c"), (8, [6.0, 5.5], "c")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, clash string").select("*", *[F.lit("x").alias(c) for c in ("key", "cid", "n_links", "kept", "rank", "score", "id")])
    near = {}
    for r in neighbours.nearest(v, v, 3).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(near) == {2**60 + i for i in range(9)} | {8}
    assert sorted(near[2**60 + 3]) == [(1, 2**60, 0.0), (2, 2**60 + 6, 0.0), (3, 2**60 + 1, 1.0)]
    out = capfilters.near_duplicates(v).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by[2**60][0][1:] == (2**60, True) and by[2**60 + 3][0][1:] == (2**60, False)
    assert sorted(by[None], key=str) == [(0, None, True), (by[2**60][0][0], 2**60, False)]
    assert by[7] == [(0, 7, True)]
    empty = v.limit(0)
    assert neighbours.nearest(empty, empty).count() == capfilters.near_duplicates(empty).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None)], "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit("z").alias("N_chars"))
    out = html_text.extracted(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.text for r in out.collect()) == ["", "x", "x"]
