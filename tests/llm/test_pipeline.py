"""The pipeline's stages, each against a brute-force version on its own input."""

import pytest
from pyspark.sql import functions as F
from test_mixing import brute_targets
from test_texts import brute_components, brute_lines, made, words

pipeline = pytest.importorskip("corpus_pipeline")

from kgloom.llm import pieces  # noqa: E402
from kgloom.llm._stage import written  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "n_lines", "ids", "row"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in made()]
    junk = [(5000 + i, " ".join(f"x{j}###" for j in range(i + 5)), "en", "a", 1) for i in range(60)]
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long").select(
        "*", F.lit("clash").alias("score"), F.lit(1.5).alias("n_lines"), F.array(F.lit("a")).alias("ids"), F.lit(None).cast("string").alias("row")).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1) for r in rows] + [(r[0], 0) for r in junk]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, folder), name)
        seen[name] = (before, docs.collect())
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    junk = [r.doc_id for r in before if 5000 <= r.doc_id]
    assert len(kept & set(junk)) <= 6 and sum(r.doc_id not in kept for r in before if r.doc_id < 3000) <= 3
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    before, after = seen["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == {i: (v[2], len(v[2])) for i, v in want.items()}
    before, after = seen["near_copies"]
    want = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in want.items() if i == c)
    assert all((r.score, r.n_lines, r.ids, r.row) == ("clash", 1.5, ["a"], None) for r in after)
    before, after = seen["mixing"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    longest = max(len(words(r.text)) for r in before)
    for source, target in brute_targets(sizes).items():
        assert abs(sum(len(words(r.text)) for r in after if r.source == source) - target) <= longest
    before, after = seen["sentencepiece"]
    v = pieces.Vocabulary()
    assert len(before) == len(after)
    assert sorted((r.doc_id, tuple(r.ids)) for r in after) == sorted((r.doc_id, tuple(pieces.Encoder(v).words(["▁" + r.text.replace(" ", "▁")])[0]) if r.text and "▁" not in r.text and "\n" not in r.text and "\r" not in r.text else tuple(v.merged("▁" + r.text.replace(" ", "▁")) if r.text else ())) for r in before)


def test_run_and_empty(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).columns == ["doc_id", "source", "n_tokens", "ids"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_or_of_one_id(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve"
    other = "quite another text of more than five words it is"
    rows = [(None, text), (None, text), (3, text), (3, text), (4, other), (4, "some third text that is like no other one here"), (None, "only here and nowhere else do we say this now"), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(pipeline.STAGES)["near_copies"](spark, docs, "")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == sorted([(False, 3, text), (False, 4, other), (False, 4, rows[5][1]), (True, 0, rows[6][1]), (True, 0, ""), (False, 5, "")])
