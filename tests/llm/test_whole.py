"""Whatever the size of the input, no part of it is left out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgloom.llm import _components, capfilters, jaccard, languages, quality
from test_models import DOCS, made


def test_languages_keep_every_gram(spark):
    rows, _ = made(150)
    rare = [(5000 + i, "ŵyn ŷd llŷn ŵy", "cy") for i in range(3)]
    docs = spark.createDataFrame([*rows, *rare, (9001, None, "en"), (9002, "123 !?", None), (9003, "ыъ щь ŵy the", None)], DOCS)
    whole, tables = languages.trained(docs), languages.trained(docs, 10)
    assert tables.langs == whole.langs == ["cy", "de", "en", "fr"]
    assert tables.bound == pytest.approx(whole.bound, abs=1e-4)
    asked = docs.withColumn("score", F.lit("clash")).drop("score")
    want, got = ({r.doc_id: r for r in languages.identified(asked, m).collect()} for m in (whole, tables))
    assert len(got) == len(want) == 156 and got[5000].lang_pred == "cy" and got[9001].lang_pred == "und"
    assert all(got[i].lang_pred == r.lang_pred and got[i].rejected == r.rejected and np.isclose(got[i].score, r.score, atol=1e-4) for i, r in want.items())


@pytest.mark.parametrize("n", [10_000, 300_000, 5_000_000])
def test_cap_filters_miss_no_more_in_large_tables(n):
    assert capfilters.missed(capfilters.needed(64, n), 64, 0.9, 3000, 5) < 0.015


def test_cap_filters_count_distinct_vectors(spark, monkeypatch):
    asked, needed = [], capfilters.needed
    monkeypatch.setattr(capfilters, "needed", lambda dim, n, threshold: asked.append((dim, n, threshold)) or needed(dim, n, threshold))
    x = np.random.default_rng(3).normal(size=(20, 8)).astype(np.float32)
    rows = [(i, x[min(i, 19)].tolist()) for i in range(400)]
    out = capfilters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95).collect()
    assert asked == [(8, 20, 0.95)] and {r.n_links for r in out if r.vec_id >= 19} == {380}


@pytest.mark.parametrize("shared", [None, -5])
def test_jaccard_rows_of_one_id_keep_their_own_texts(spark, shared):
    base = [[f"{k}w{i}" for i in range(60)] for k in range(12)]
    rows = [(shared, " ".join(w)) for w in base] + [(100 + k, " ".join([*w[:-1], "other"])) for k, w in enumerate(base)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + k] == (shared or 100 + k) for k in range(12))  # a missing id names no component


def test_quality_trains_on_every_passage():
    text = " ".join(f"w{i}" for i in range(40 * quality.PASSAGE))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "short"]), pa.array([1.0, 0.0])], ["key", "text", "quality"])
    (got,) = quality._training(iter([batch]))
    read = [quality._read(*(got.column(c)[i].as_py() for c in ("x", "tokens", "filled"))) for i in range(2)]
    (want,) = quality.encode(batch.column(1))
    assert [len(b.x) for b in read] == [40, 1] and np.array_equal(read[0].x, want.x[: want.bag[1]])
    assert [len(b.tokens) for b in read] == [40 * quality.PASSAGE * quality.GRAMS, quality.GRAMS]
    assert np.array_equal(np.concatenate([b.tokens for b in read]), want.tokens)


def test_cap_filters_bound_what_a_task_holds(spark, monkeypatch):
    for name, value in {"TARGET": 60, "LARGE": 50, "LARGEST": 50, "ROUND": 3000, "SENT": 1}.items():
        monkeypatch.setattr(capfilters, name, value)
    compared, sent, rounds = capfilters._compared, capfilters._sent, []

    def bounded(*args):
        run = compared(*args)

        def checked(t):
            assert t.num_rows <= 150  # two blocks of about 50, however many vectors pass a filter
            return run(t)

        return checked

    monkeypatch.setattr(capfilters, "_compared", bounded)
    monkeypatch.setattr(capfilters, "_sent", lambda slices, low, high: rounds.append((low, high)) or sent(slices, low, high))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16))
    x[200:] = x[7] + 0.25 * rng.normal(size=(300, 16))
    x = x.astype(np.float32).astype(float)
    out = {r.vec_id: r.n_links for r in capfilters.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = np.array([out[i] for i in range(500)])
    assert len(rounds) > 1 and [z for _, z in rounds[:-1]] == [a for a, _ in rounds[1:]]
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


@pytest.mark.parametrize("n", [600, 20_000])
def test_cap_filters_count_a_pair_at_one_shared_filter(n):
    codes = capfilters.needed(64, n)
    assert codes.height > -np.inf and codes.m == 2  # never all vectors in all filters
    x = np.concatenate(capfilters._pairs(64, 300, 0.93, np.random.default_rng(4)))
    at = codes.at(x, np.arange(300), np.arange(300, 600))
    row, own, _ = codes.decode(x)
    lists = [set(own[row == i].tolist()) for i in range(600)]
    shared = [bool(lists[i] & lists[300 + i]) for i in range(300)]
    assert all(at[i] in lists[i] & lists[300 + i] for i in range(300) if shared[i]) and np.mean(shared) > 0.98
    alone = [codes.decode(v[None]) for v in x[:20]]
    assert all(set(f.tolist()) == lists[i] for i, (_, f, _) in enumerate(alone))


def test_languages_count_every_document_and_calibrate_on_the_whole_fold(spark, monkeypatch):
    monkeypatch.setattr(languages, "MANY", 20)
    rows = [(i, "tha dorn " * (1 + i % 3) + f"q{chr(97 + i % 26)}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    judged, built, highest = [], languages._built, languages._highest
    monkeypatch.setattr(languages, "_built", lambda counts, most: judged.append(counts.agg(F.sum("n")).first()[0]) or built(counts, most))
    monkeypatch.setattr(languages, "_highest", lambda own: judged.append([r.entropy for r in own.collect()]) or highest(own))
    model = languages.trained(docs)
    learned = docs.filter(~quality.held_out(F.col("doc_id")))
    grams = sum(len(languages.grams(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text)]))[0]) for r in learned.collect())
    fold = learned.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(languages.FOLDS)) == 0).count()
    assert judged[0] == grams > judged[1]  # the model counts all, the one that judges the fold only the others
    assert len(judged[2]) == fold and model.bound == pytest.approx(languages.bounds(["en"], [("en", e) for e in judged[2]]))


@pytest.mark.parametrize("held, rounds", [(1 << 20, 1), (4000, 8)])
def test_components_of_long_chains_take_few_rounds(spark, monkeypatch, held, rounds):
    monkeypatch.setattr(_components, "HELD", held)
    labels, write = [], _components.written
    monkeypatch.setattr(_components, "written", lambda df, label: labels.append(label) or write(df, label))
    names = np.random.default_rng(4).permutation(30_000)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(20_000 - 1)] + [(int(names[i]), int(names[20_000 + i % 5])) for i in range(20_005, 30_000)] + [(5, 5)]
    found = {r.node: r.component for r in _components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    groups = [names[:20_000], *(names[[20_000 + k, *range(20_005 + k, 30_000, 5)]] for k in range(5))]
    assert found == {int(i): int(g.min()) for g in groups for i in g} and labels.count("cc-hooks") <= rounds


def test_forests_of_a_task_are_bounded(monkeypatch):
    monkeypatch.setattr(_components, "HELD", 100)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 500, (2, 5000))
    made = list(_components._forests(pa.RecordBatch.from_arrays([pa.array(a[k : k + 30]), pa.array(b[k : k + 30])], ["a", "b"]) for k in range(0, 5000, 30)))
    assert len(made) > 1 and max(x.num_rows for x in made) < 130 and all((x.column(0).to_numpy() < x.column(1).to_numpy()).all() for x in made)
    parts = lambda x, y: sorted(zip(*(v.tolist() for v in _components.forest(x, y)), strict=True))
    assert parts(*(np.concatenate([x.column(i).to_numpy() for x in made]) for i in range(2))) == parts(a, b)
    assert list(_components._forests(iter([]))) == []


def test_quality_is_fitted_off_the_driver(spark, monkeypatch):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{(i * k) % 7}" for k in range(30))) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality.Attention, "fit", lambda *args: pytest.fail("fitted on the driver"))
    model = quality.learned(docs, labels)
    assert model.w["E"].any()
    score = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert all((score[i] > 0.5) == bool(i % 2) for i, _ in rows)
    assert quality.learned(docs, labels.filter("quality = 1")) is None and quality.learned(docs, labels.limit(0)) is None


def test_shingle_counts_reach_the_driver_as_small_numbers(spark):
    assert jaccard.shingle_counts(spark.createDataFrame([("a b c d e f",)] * 3, "text string")).dtype == np.int32
    part = [pa.array([0, 0], pa.int32()), pa.array([np.array([2**31 - 2, 1]).tobytes(), np.array([5, 1]).tobytes()], pa.binary())]
    (row,) = jaccard._add(pa.table(part, ["part", "counts"])).to_pylist()
    assert np.frombuffer(row["counts"], np.int32).tolist() == [2**31 - 1, 2]
