"""Quality, language, HTML and vector operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import capfilters, html_text, languages, neighbours, quality

DOCS = "doc_id long, text string, lang string"


def made(n=300, seed=1):
    rng = random.Random(seed)
    kinds = {"en": "the of and in to that is was for with thing other".split(), "de": "der die und das nicht ein zu mit sich auf über schön".split(), "fr": "le la les de et une est dans que élève où très".split()}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(kinds))
        w = rng.choices(kinds[lang], k=rng.randint(8, 90))
        bad = rng.random() < 0.3
        if bad:
            w = [x + rng.choice(["###", "&&&", "$$$"]) for x in w]
        rows.append((i, " ".join(w), lang))
        labels.append((i, int(not bad)))
    return rows, labels


@pytest.fixture(scope="module")
def made_rows():
    return made()


def test_quality_held_out(spark, made_rows):
    rows, labels = made_rows
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.learned(docs, marks)
    odd = [(9001, None, "x"), (9002, "", None), (9003, "a" * 5000, None), (9003, "a" * 5000, None)]
    out = quality.scored(docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("quality", F.lit("clash")), model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    want = dict(labels)
    right = [(r.score >= 0.5) == bool(want[r.doc_id]) for r in out if r.doc_id < 9000 and r.held]
    assert len(out) == len(rows) + 4 and np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in out)
    again = quality.scored(docs, quality.learned(docs, marks)).orderBy("doc_id").collect()
    assert [r.score for r in again] == [r.score for r in sorted(out, key=lambda r: r.doc_id) if r.doc_id < 9000]


def test_quality_gradients():
    rng = np.random.default_rng(0)
    net = quality.Attention(5)
    net.w["o"], net.w["E"] = rng.normal(size=net.w["o"].shape), rng.normal(size=net.w["E"].shape)
    filled = np.array([3, 0, 5, 1, 2, 4, 4, 1, 2])
    bags = quality.Bags(rng.normal(size=(9, 5)), rng.integers(0, 6, quality.GRAMS * filled.sum()), filled, np.array([0, 4, 5, 9]))
    y = np.array([1.0, 0.0, 1.0])
    assert np.allclose(bags.shares(len(net.w["E"])) @ net.w["E"], bags.means(net.w["E"]), atol=1e-5)
    loss = lambda: -np.mean(y * np.log(net.score(bags)) + (1 - y) * np.log(1 - net.score(bags)))
    for name, g in net._gradients(bags, y).items():
        at = tuple(0 for _ in g.shape)
        if name == "E":
            at = (int(bags.tokens[0]), 1)
        net.w[name][at] += 1e-5
        up = loss()
        net.w[name][at] -= 2e-5
        down = loss()
        net.w[name][at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_learns_words(spark):
    """Labels that only the words tell: both kinds look alike."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words[:40] if i % 2 else words[20:], k=150)), "x") for i in range(400)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    out = quality.scored(docs, quality.learned(docs, marks)).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out if r.held]) > 0.95


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.scored(docs, quality.learned(docs, none)).collect()] == [0.5]
    assert quality.scored(docs.limit(0), None).count() == 0


def test_languages(spark, made_rows):
    rows, _ = made_rows
    docs = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "123 !?", "en"), (9003, "", None), (9004, "der der", None)], DOCS)
    model = languages.trained(docs)
    out = {r.doc_id: r for r in languages.identified(docs.drop("lang").withColumn("lang_x", F.lit(1)), model).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows]) > 0.99
    assert {out[i].lang_pred for i in (9001, 9002, 9003)} == {"und"} and out[9004].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in languages.identified(docs, None).collect()} == {"und"}
    assert languages.trained(docs.limit(0)) is None


def brute_model(rows, order=4):
    """Kneser-Ney by dictionaries: log P(c | context) per language."""
    sequences = {}
    for lang, text in rows:
        s = ["^"] * (order - 1)
        for i, ch in enumerate(text):
            if ch.isalpha():
                s.append(ch.lower())
            elif i and text[i - 1].isalpha():
                s.append(" ")
        sequences.setdefault(lang, []).append(s)
    symbols = len({c for group in sequences.values() for s in group for c in s[order - 1 :]})
    models = {}
    for lang, group in sequences.items():
        counts = {order: {}}
        for s in group:
            for i in range(order - 1, len(s)):
                g = tuple(s[i - order + 1 : i + 1])
                counts[order][g] = counts[order].get(g, 0) + 1
        for k in range(order - 1, 0, -1):
            counts[k] = {}
            for g in counts[k + 1]:
                counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
        models[lang] = counts

    def p(lang, g):
        if not g:
            return 1 / (symbols + 1)
        c = models[lang][len(g)]
        once, twice = max(1, sum(v == 1 for v in c.values())), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice)
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not same:
            return p(lang, g[1:])
        return max(c.get(g, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * p(lang, g[1:])

    def entropy(lang, text):
        s = ["^"] * (order - 1)
        for i, ch in enumerate(text):
            if ch.isalpha():
                s.append(ch.lower())
            elif i and text[i - 1].isalpha():
                s.append(" ")
        return -np.mean([np.log(p(lang, tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))])

    return sorted(models), entropy


def test_languages_against_dictionaries(spark):
    rows, _ = made(40, 8)
    docs = spark.createDataFrame(rows, DOCS)
    langs, entropy = brute_model([(lang, text) for i, text, lang in docs.filter(~quality.held_out(F.col("doc_id"))).collect()])
    texts = [t for _, t, _ in rows[:6]] + ["der the le", "Ça va, ok? zzz", "a", "wxyz " * 30]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (languages.MOST, 10):
        out = {r.doc_id: r for r in languages.identified(asked, languages.trained(docs, most)).collect()}
        for i, text in enumerate(texts):
            want = [entropy(lang, text) for lang in langs]
            assert out[i].lang_pred == langs[int(np.argmin(want))] and out[i].entropy == pytest.approx(min(want), abs=1e-4)


def test_language_bounds():
    rng = np.random.default_rng(0)
    values = rng.normal(2, 0.1, 2000)
    low, none = languages.bounds(["en", "xx"], [("en", v) for v in values[:1000]] + [("xx", 1.0)] * 50)
    assert np.isinf(none) and 0 < np.mean(values[1000:] > low) < 0.015


def test_kneser_ney_sums_to_one():
    text = "abab abba baab"
    data = np.frombuffer(text.encode(), np.uint8)
    gram, _, _ = languages.grams(data, np.array([0, len(data)]))
    kinds, n = np.unique(gram, return_counts=True)
    model = languages.Model(["x"], np.zeros(len(kinds), int), kinds, n)
    symbols = model.keys[1]
    for context in np.unique(kinds >> 12)[:5]:
        total = np.exp(model._log((context << 12) | symbols, languages.ORDER)).sum()
        assert total < 1.0001 and total > 0.9  # the rest is for unseen characters


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p><b>One\n two<br><p>Three</p></article><footer>f</footer>", "Head & more\nOne two\nThree"),
    ("<body><div id=sidebar><p>side</div><div><p>long text here and more of it</p></div><form><p>q</form><div class='comments'><p>nice</div>", "long text here and more of it"),
    ("plain", "plain"), ("", ""), (None, ""), ("<p>a<!-- x <p>b", "a"), ("<script>var t='</p>';</script><p>x</p>", "x"), ("<p class=ad>buy<p>text</p>", "text"), ("<nav>only menu", ""),
    ("<ul><li class='ad'>x<li>y</ul>", "y"), ("<p>&lt;b&gt; &#233;&eacute; &unknown;</p>", "<b> éé &unknown;"),
]


def test_html(spark):
    rows = [(i, "u", p, "clash", 1) for i, (p, _) in enumerate(PAGES)]
    out = {r.page_id: r for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert out[i].text == want and out[i].n_chars == len(want)
    assert html_text.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 16))
    near = [x[i] + 0.1 * rng.normal(size=16) for i in range(60)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate([*x, *near])]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    return rows, [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] + [1.0] * 15), (2005, [1.0] * 3)]


def test_cap_filters(spark):
    rows, odd = vectors()
    out = {r.vec_id: r for r in capfilters.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    ids = np.array([i for i, _ in rows])
    part = ids.copy()
    for _ in range(10):
        part = np.array([part[linked[i]].min() for i in range(len(ids))])
    same = [(out[i].n_links, out[i].component_id) == (linked[at].sum() - 1, part[at]) for at, i in enumerate(ids)]
    assert np.mean(same) > 0.97
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True) for i, _ in odd)
    assert capfilters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours(spark):
    rows, odd = vectors()
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    out = neighbours.nearest(frame, frame.filter("vec_id % 20 = 0")).collect()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got, hit, total = {}, 0, 0
    for r in out:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    for i, found in got.items():
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        d[ids == i] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(d[ids == v][0]) for _, v, s in found) and [s for *_, s in found] == sorted(s for *_, s in found)
        hit, total = hit + len(set(want) & {v for _, v, _ in found}), total + 10
    assert hit / total >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few, few).count() == 6
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0
