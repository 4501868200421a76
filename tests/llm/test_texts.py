"""Line dedup, substring dedup, Jaccard join and SentencePiece against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import jaccard, lines, pieces, substrings

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "Über", "THE", "the", "x y"]
    shared = [" ".join(rng.choices(vocabulary, k=k)) for k in (12, 25, 30, 60)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(rng.randint(0, 4))]
        parts += rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((i * 3, rng.choice(["\n", " ", "\r\n"]).join(parts)))
    for i in range(0, n, 6):  # near copies
        w = rows[i][1].split(" ")
        for at in rng.sample(range(len(w)), min(len(w), rng.randint(0, 3))):
            w[at] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, rows[5][1]) for i in range(8)] + [(3000, None), (3001, ""), (3002, "   \n"), (3003, "one two"), (3004, "ONE  two"), (3005, "the " * 200), (3006, "the " * 150)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute_lines(rows, least=5):
    key = lambda line: lower(line.strip(BLANK))
    holders = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, set()).add(i)
    out = {}
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(holders.get(key(x), ())) >= least and i != max(holders[key(x)]))]
        out[i] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [None, 7])
def test_lines(rows, docs, batches):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs, batches=batches).collect()}
    assert got == brute_lines(rows)
    assert sum(v[1] for v in got.values()) > 20


def test_line_runs_are_disjoint_and_stay_in_place(docs):
    keys = lines.long_lines(docs)
    runs = lines.LineRuns(fanout=3)
    for at in range(5):
        runs.add(keys.filter(F.pmod("id", F.lit(5)) == at))
    assert [len(level) for level in runs.levels] == [2, 1] and runs.deltas
    want = {(r.h1, r.h2): (r.n, r.keeper) for r in keys.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).collect()}
    assert {(r.h1, r.h2): (r.n, r.keeper) for r in runs.index().collect()} == want
    assert sum(run.rows.count() for run in runs.runs()) == len(want)  # each key in one run
    plan = runs.index(5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.drop()


def test_lines_of_hashed_and_repeated_ids(spark):
    line = "a line that is long enough to be counted as one"
    rows = [(i, f"{line}\nown {i}") for i in (-(2**63), -5, 2**62, 2**63 - 1)] + [(7, line), (7, f"x\n{line}")]
    got = sorted((r.doc_id, r.n_dropped, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    want = brute_lines(rows)  # by id: the rows of 7 are one document
    assert [x for x in got if x[0] != 7] == sorted((i, d, t) for i, (_, d, t) in want.items() if i != 7)
    assert [x for x in got if x[0] == 7] == [(7, 1, ""), (7, 1, "x")]
    four = [(i, line) for i in range(3)] + [(3, line), (3, line)]
    assert {r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(four, SCHEMA)).collect()} == {0}


def brute_substrings(rows, n=20):
    first, gone = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone[i] = set()
        for s in range(len(w) - n + 1):
            if first.setdefault(tuple(w[s : s + n]), (i, s)) != (i, s):
                gone[i] |= set(range(s, s + n))
    return {i: (len(words(x)), len(gone[i]), " ".join(w for at, w in enumerate(words(x)) if at not in gone[i])) for i, x in rows}


def test_substrings(rows, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.dedup_substrings(docs).collect()}
    assert got == brute_substrings(rows)


def test_substrings_with_a_notice_in_every_document(spark, monkeypatch):
    """A short notice in ever new surroundings: its windows all differ, and no slice gets them all."""
    monkeypatch.setattr(substrings, "FREQUENT", 500)
    rng, notice = random.Random(1), " ".join(f"n{i}" for i in range(12))
    some = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    rows = [(i, f"{some(50)} {notice} {some(50)}") for i in range(3000)] + [(9000 + i, "a b " * (12 + i)) for i in range(5)] + [(9100, "x " * 23)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.dedup_substrings(docs).collect()} == brute_substrings(rows)
    sizes = [r.n for r in substrings.window_blobs(docs).filter("slice >= 0").groupBy("slice").agg((F.sum(F.length("windows")) / 8).alias("n")).collect()]
    assert sum(sizes) < 3000 * 40 and max(sizes) < 4 * sum(sizes) / len(sizes)


def test_sketch_keeps_all_repeated_windows(spark, monkeypatch):
    """Also where the sketch is far too small."""
    monkeypatch.setattr(substrings, "MOST_BITS", 9)
    monkeypatch.setattr(substrings, "LEAST_BITS", 9)
    monkeypatch.setattr(substrings, "RANGES", 4)
    rows = made(60, 5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_substrings(rows)


def test_substrings_of_repeated_ids(spark):
    w = " ".join(f"v{i}" for i in range(25))
    rows = [(1, w), (2, f"x {w}"), (2, f"x y {w}"), (2, f"x {w}"), (3, "z " * 10)]
    got = sorted((r.doc_id, r.n_removed, r.text) for r in substrings.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, w), (2, 25, "x"), (2, 25, "x"), (2, 25, "x y"), (3, 0, "z " * 9 + "z")]


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = words(lower(text or ""))
        sets[i] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard(rows, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    want = brute_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_jaccard_large_family(spark):
    """More near copies of one text than a block holds, some too far from every other."""
    rng = random.Random(9)
    base = ["t%d" % i for i in range(150)]
    rows = []
    for i in range(180):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 1, 2, 3, 6])):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lines.dedup_lines(empty).count() == substrings.dedup_substrings(empty).count() == jaccard.jaccard_components(empty).count() == 0
    rows = [(1, "a b c d e f", "x", 7), (1, "a b c d e f", "x", 7), (None, None, None, 1), (2, "z " * 30, "q", 2), (None, "z " * 30, "q", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n long")
    assert lines.dedup_lines(docs).count() == substrings.dedup_substrings(docs).count() == jaccard.jaccard_components(docs).count() == 5
    assert {r.n_removed for r in substrings.dedup_substrings(docs).filter("doc_id = 2").collect()} == {30}


LIBRARY = pytest.importorskip("sentencepiece")


def test_pieces_equal_the_library(spark, rows):
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary file")
    model = LIBRARY.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    texts = [t for _, t in rows] + ["  a   b ", "日本語 ☃ 😀x", "a" * 300, "\n\n\ta\r\n", "hello world", "aaaa bb" * 20]
    texts += ["ab" * 700, "=-" * 300, "日本語テキスト" * 30, " " * 70 + "x", " " * 17 + "hello" + " " * 33 + "a", "x" + " " * 20]
    parts = ["a", "e", "th", "Qx", " ", "  ", "    ", "http://", "/", "é", "日", "_-", "ing", "0"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(100)]
    texts += ["".join(rng.choice("abcxyzABCXYZ0189+/") for _ in range(rng.randint(40, 2000))) for _ in range(30)]
    texts += ["".join(rng.choice("abcdeth .,\né☃") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    out = {r.doc_id: r for r in pieces.decode(pieces.encode(docs)).collect()}
    for i, t in enumerate(texts):
        assert list(out[i].ids) == model.encode(t or "")
        assert out[i].decoded == (t or "")
    digest = {r.doc_id: r for r in pieces.digest(docs).collect()}
    assert all(r.round_trip and r.n_tokens == len(out[i].ids) for i, r in digest.items())
    assert digest[0].ids_sha256 == hashlib.sha256(np.array(out[0].ids, "<i4").tobytes()).hexdigest()
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_additive_lattice(spark):
    """The unigram rule: the largest sum of scores, against every way of cutting."""
    v = pieces.Vocabulary.__new__(pieces.Vocabulary)
    v.text, v.score = ["a", "b", "ab", "abb", "bb"], np.array([-1.0, -1.2, -1.9, -4.0, -1.5])
    v.longest, v.additive, v.byte = 3, True, np.zeros(256, np.int32)
    v.known = {t: i for i, t in enumerate(v.text)}
    keys = np.array([pieces._key(np.array([ord(c) for c in t])) for t in v.text], np.uint64)
    order = np.argsort(keys)
    v.reach = 5
    v.keys, v.ids = np.append(keys[order], np.zeros(5, np.uint64)), np.append(order.astype(np.int32), np.zeros(5, np.int32))
    v.begin = np.searchsorted(keys[order], np.arange(1 << 17, dtype=np.uint64) << np.uint64(47))

    def best(w):
        if not w:
            return 0.0, []
        return max((best(w[k:])[0] + v.score[v.known[w[:k]]], [v.known[w[:k]]] + best(w[k:])[1]) for k in range(1, 4) if w[:k] in v.known and k <= len(w))

    def best_of_long(w):
        top = [0.0]
        for i in range(1, len(w) + 1):
            top.append(max(top[i - k] + v.score[v.known[w[i - k : i]]] for k in range(1, 4) if k <= i and w[i - k : i] in v.known))
        return top[-1]

    e = pieces.Encoder(v)
    for w in ("a", "abb", "abbabb", "bbbab"):
        ids, _ = e.words([w])
        assert v.score[ids].sum() == pytest.approx(best(w)[0])
    long = ["abb" * 11 + "a" * 20, "ab" * 60, "b" * 49, "abbab" * 200, "bab" * 33, "a" * 400]
    ids, count = e.words(long)
    ends = np.cumsum(count)
    for w, x, y in zip(long, ends - count, ends, strict=True):
        assert "".join(v.text[i] for i in ids[x:y]) == w and v.score[ids[x:y]].sum() == pytest.approx(best_of_long(w))
