import pytest
from pyspark.sql import functions as F

from kgloom.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    """Share the run by weight; stop sources at their ceiling; reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(stopped.values()), [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: 2.0 * sizes[s] for s in over}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken_match_brute_force(spark):
    rows = [(i, "w " * (5 + i * 7 % 40), ["a", "b", "c", "d", None][min(i % 9, 4)]) for i in range(300)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == 300
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_positions_follow_the_ramp_and_reruns_agree(spark):
    rows = [(i, "w " * 10, ["a", "b", "c"][i % 3]) for i in range(300)]
    frame = docs_of(spark, rows)
    one, two = ([tuple(r) for r in mixing.mix(frame).collect()] for _ in range(2))
    assert one == two
    at = [r.position for r in mixing.mix(frame).collect() if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = {s: sum(r.position < 0.5 for r in mixing.mix(frame.filter(F.col("source") == s)).collect() if r.position is not None) for s in "a"}
    assert early["a"] > 50  # a source whose weight falls is met early


def test_whole_documents(spark):
    rows = [(i, f"doc {i} " + "w " * (i % 13), ["a", "b", "c"][i % 3]) for i in range(200)]
    frame = docs_of(spark, rows)
    out = mixing.whole_documents(frame).collect()
    assert {(r.doc_id, r.text, r.source) for r in out} <= set(rows)
    target = {r.source: r.target for r in mixing.mix(frame).collect()}
    for s, t in target.items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == s) - t) <= 15


def test_nulls_empty_and_repeats(spark):
    rows = [(1, None, None), (1, "a b", None), (1, "a b", None), (None, "x", "s"), (2, "", "s")]
    out = mixing.mix(docs_of(spark, rows)).collect()
    assert len(out) == 5 and sum(r.size for r in out) == 5
    assert mixing.mix(docs_of(spark, [])).collect() == []
    clash = docs_of(spark, rows).withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    assert mixing.mix(clash).count() == 5


def test_repeated_rows_and_clashing_columns_in_whole_documents(spark):
    rows = [(i % 20, "w " * (i % 7), "ab"[i % 2], i // 40) for i in range(120)] + [(500, "x y z", "a", 9)] * 6
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, times long").withColumn("row1", F.lit("clash"))
    one, two = (sorted(tuple(r) for r in mixing.whole_documents(frame).collect()) for _ in range(2))
    assert one == two and {r[:4] for r in one} <= set(rows)
    target = {r.source: r.target for r in mixing.mix(frame).collect()}
    for s, t in target.items():
        assert abs(sum(len(r[1].split()) for r in one if r[2] == s) - t) <= 7
    assert all(one.count(r) <= 2 * [(*x, "clash") for x in rows].count(r) for r in set(one))
