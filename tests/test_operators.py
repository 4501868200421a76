import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.functions import iri
from kgloom.operators import align, encoders, facts, linkcheck, linking, lookup, pairs, triples
from kgloom.plans import pipelines

T = "s string, s_kind string, p string, o string, o_kind string"


def graph(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_fan_out(spark):
    d = spark.createDataFrame([(1, 10, "0389"), (2, 11, None)], "row_id long, subject_id long, icd9_code string")
    out = got(triples.diagnosis_triples(d))
    assert len(out) == 10 and ("http://example.org/Diagnosis/10/PATIENTS/1", iri.SPHN + "hasCode", "http://example.org/Code/icd9#0389") in out
    assert any(o.endswith("icd9#nan") for _, _, o in out)
    rows = [(1, 10, 5, "7.0 mg/dL", "x-1"), (2, 10, 5, None, "nan"), (3, 10, 5, "1", " "), (None, 10, 5, "1", "x")]
    out = got(triples.lab_triples(spark.createDataFrame(rows, "row_id long, subject_id long, itemid long, value string, loinc_code string")))
    assert len(out) == 24 and any(s.endswith("/5/7.0%20mg%2FdL") for s, _, _ in out) and any(s.endswith("/5/NA") for s, _, _ in out)


def test_graph_sets(spark):
    q = graph(spark, [("a", "ns", "c1"), ("a", "q", "x"), ("b", "ns", "c2")])
    a = graph(spark, [("a", "ns", "k"), ("z", "ns", "k")])
    assert got(triples.transcribe(q, a)) == [("a", "ns", "k"), ("b", "ns", "c2")]
    assert got(triples.merge(q, a)) == sorted([("a", "ns", "c1"), ("a", "q", "x"), ("b", "ns", "c2"), ("a", "ns", "k")])
    assert triples.union(q, q, a).count() == 5 and triples.match(q, p="ns").count() == 2 and triples.match(q, s="a", o="x").count() == 1


def test_bnode_closure(spark):
    rows = [("r", "uri", "p", "b1", "bnode"), ("b1", "bnode", "p", "b2", "bnode"), ("b2", "bnode", "p", "b1", "bnode"), ("b2", "bnode", "p", "b3", "bnode"), ("b3", "bnode", "l", "x", "literal"), ("r", "uri", "p", "b3", "bnode"), ("r", "uri", "q", "u", "uri")]
    out = got(triples.bnode_closure(spark.createDataFrame(rows, T)))
    assert out == [("r", "b1", "b1"), ("r", "b1", "b2"), ("r", "b1", "b3"), ("r", "b3", "b3")]
    e = {r.subject: r for r in encoders.graph_embeddings(spark.createDataFrame(rows, T), encoders.HashedEncoder(8)).collect()}
    assert set(e) == {"r"} and len(e["r"].edge_embedding) == 8


def test_lookup(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, ord long")
    assert got(lookup.first_of(d, ["k"], ["ord"]).select("k", "v")) == [(1, "a"), (2, "c")]
    assert got(lookup.last_of(d, ["k"], ["ord"]).select("k", "v")) == [(1, "b"), (2, "c")]
    ids = spark.range(100).withColumnRenamed("id", "subject_id")
    assert lookup.sampled(ids, 0.05).count() == 5 and got(lookup.sampled(ids, 0.05)) == got(lookup.sampled(ids.repartition(7), 0.05))
    import random

    want = list(range(100))
    random.seed(42)
    random.shuffle(want)
    assert lookup.shuffled_sample(ids.withColumn("ord", F.col("subject_id")), 0.05) == want[:5]
    assert lookup.in_use(d, spark.createDataFrame([(1,), (None,)], "k long"), "k").count() == 2


def test_linking(spark):
    labels = spark.createDataFrame([("1", "Heart block"), ("1", "AV block"), ("2", "Aortic stenosis"), ("3", "Aortic stenosis")], "concept_id string, label string")
    d = spark.createDataFrame([("10", "heart block."), ("11", "aortic stenosis"), ("12", "block of something else entirely"), ("13", "zzz"), ("14", None), ("15", "heart block.")], "id string, description string")
    out = {r.id: (r.matched, round(r.similarity, 3)) for r in linking.best_matches(d, labels).collect()}
    assert out["10"] == out["15"] == ("1", 1.0) and out["11"] == ("2", 1.0) and out["13"] == out["14"] == (None, 0.0)
    assert out["12"][0] is None and 0 < out["12"][1] < 0.7
    index = linking.token_index(labels)
    assert {r.token for r in linking.cleaned(index, 2).collect()} == {"heart", "block", "av", "aortic", "stenosis"} and linking.cleaned(index, 1).count() == 3 and linking.cleaned(index, None).count() == 7
    c = linking.clusters(linking.best_matches(d, labels)).orderBy("first_seen").collect()
    assert [(r.matched, r.cluster_size, r.record_ids) for r in c] == [("1", 2, ["10", "15"]), ("2", 1, ["11"])]


def test_link_check(spark):
    links = spark.createDataFrame([("ICD9#1", "http://snomed.info/id/5"), ("icd9#2", "http://snomed.info/id/6"), ("x", "y")], "icd_raw string, snomed_uri string")
    codes = spark.createDataFrame([("1", "AF", "Atrial fibrillation")], "icd9_code string, short_title string, long_title string")
    labels = spark.createDataFrame([("5", "Atrial fibrillation"), ("5", "Heart"), ("6", "-")], "concept_id string, label string")
    out = {r.icd_raw: r for r in linkcheck.validated(links, codes, labels).collect()}
    assert (out["ICD9#1"].best_label, out["ICD9#1"].verdict) == ("Atrial fibrillation", "OK")
    assert (out["icd9#2"].icd_text, out["icd9#2"].score, out["icd9#2"].verdict) == ("", 0.5, "OK")  # two empty texts are equal
    assert (out["x"].score, out["x"].best_label, out["x"].verdict, out["x"].concept_id) == (0.0, "", "Suspicious", "")


def brute_walks(rows, path, domain, range_, p):
    kinds = {(s, o) for s, q, o in rows if q == iri.RDF_TYPE}
    walks = [(s, o) for s, q, o in rows if q == path[0] and (s, domain) in kinds]
    for step in path[1:]:
        walks = [(s, o) for s, v in walks for x, q, o in rows if x == v and q == step]
    walks = [(s, o) for s, o in walks if (o, range_) in kinds]
    return len(walks), sum((s, p, o) in rows for s, o in walks)


def test_facts(spark):
    import random

    rng = random.Random(2)
    rows = {(f"x{i}", iri.RDF_TYPE, "A") for i in range(6)} | {(f"y{i}", iri.RDF_TYPE, "B") for i in range(6)}
    rows |= {(f"x{rng.randrange(6)}", "p", f"y{rng.randrange(6)}") for _ in range(12)} | {(f"y{rng.randrange(6)}", "q", f"x{rng.randrange(6)}") for _ in range(12)} | {(f"x{rng.randrange(6)}", "r", f"y{rng.randrange(6)}") for _ in range(8)}
    rows |= {("p", iri.RDFS_DOMAIN, "A"), ("p", iri.RDFS_DOMAIN, "Z"), ("p", iri.RDFS_RANGE, "B"), ("q", iri.RDFS_DOMAIN, "B")}
    g = graph(spark, sorted(rows))
    assert {r.p: (r.domain, r.range) for r in facts.domain_range(g).collect()} == {"p": ("A", "B"), "q": ("B", None)}
    wanted = [["p"], ["r"], ["p", "q"], ["p", "q", "p"], ["r", "q", "p"]]
    out = {tuple(r.path): (r.c_path, r.c_both) for r in facts.walk_counts(g, spark.createDataFrame([(w, "p", "A", "B") for w in wanted], "path array<string>, p string, domain string, range string")).collect()}
    assert out == {tuple(w): brute_walks(rows, w, "A", "B", "p") for w in wanted}
    f = graph(spark, [("x0", "p", "y1"), sorted(r for r in rows if r[1] == "p")[0], ("x0", "q", "x1"), ("nobody", "p", "y1")])
    scored = {(r.s, r.p, r.o): r.score for r in facts.scored(g, f).collect()}
    assert len(scored) == 4 and scored[sorted(r for r in rows if r[1] == "p")[0]] == pytest.approx(1.0) and scored[("x0", "q", "x1")] == scored[("nobody", "p", "y1")] == 0.0
    assert facts.scored(g, f.limit(0)).count() == 0


def test_alignment(spark):
    icd = spark.createDataFrame([("412", "Old infarction", 1), ("412", "Later title", 2), ("430", "Bleeding", 3)], "ICD9_CODE string, LONG_TITLE string, ord long")
    lab = spark.createDataFrame([(7, "Glucose")], "ITEMID long, LABEL string")
    modules = {"icd9": icd, "labresults": lab}.__getitem__
    ns = iri.ALIGN_NAMESPACE
    query = spark.createDataFrame([("a", "uri", ns, "http://example.org/Code/icd9#412", "uri"), ("b", "uri", ns, "http://x/9", "uri"), ("c", "uri", ns, "icd9#412", "literal"), ("d", "uri", ns, "http://x/7", "uri")], T)
    targets = spark.createDataFrame([("t1", iri.RDFS_LABEL, "Old infarction", "literal"), ("t2", iri.RDFS_LABEL, "Glucose", "literal"), ("t3", iri.RDFS_LABEL, "Nothing alike", "literal")], "s string, p string, o string, o_kind string")
    vectors = encoders.label_embeddings(targets)
    clusters = spark.createDataFrame([(0, "t1"), (1, "t2"), (1, "t3")], "cluster_id int, subject string")
    a = align.Aligner(vectors, clusters, modules=modules)
    assert got(a.align(query, "icd9tosnomed")) == [("a", ns, "t1")]
    assert got(a.transcribe(query, "icd9tosnomed"))[0] == ("a", ns, "t1") and a.merge(query, "icd9tosnomed").count() == 5
    assert align.invokers.invoke("labresults2snomed", query, ns, None, modules).select("subject").first()[0] == "d"
    assert align.invokers.invoke("snomedtoicd9", query, ns, None, modules).count() == 3
    none = query.filter("s = 'b'")
    assert align.invokers.invoke("icd9tosnomed_old", none, ns, None, modules).count() == 0
    with pytest.raises(ValueError):
        align.invokers.invoke("icd9tosnomed", none, ns, None, modules)
    with pytest.raises(AttributeError):
        align.invokers.invoke("nothing", query)
    with pytest.raises(align.EmptyAlignmentError):
        a.align(none, "icd9tosnomed_old")
    with pytest.raises(ArithmeticError):
        align.checked_centroids(spark.createDataFrame([(9, "zz")], "cluster_id int, subject string"), vectors)
    k = encoders.kmeans(vectors, 2)
    assert k.count() == 3 and encoders.kmeans(vectors.limit(0), 2).count() == 0


def test_schema_mapping(spark):
    patients = spark.range(40).withColumnRenamed("id", "subject_id")
    diagnoses = spark.createDataFrame([(i, i, "1") for i in range(40)], "row_id long, subject_id long, icd9_code string")
    labs = spark.createDataFrame([(i, i, 5, "v") for i in range(40)], "row_id long, subject_id long, itemid long, value string")
    items = spark.createDataFrame([(1, 5, "old"), (2, 5, "new")], "row_id long, itemid long, loinc_code string")
    out = pipelines.schema_mapping(patients, diagnoses, labs, items, 0.1)
    assert out.count() == 4 * 5 + 4 * 10 and out.filter(F.col("s").endswith("loinc#new")).count() == 4


def test_closure_of_a_long_chain_and_a_cycle(spark):
    steps = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(300)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0")], "node string, next string")
    start = spark.createDataFrame([("r", "n0", "n0"), ("r", "n290", "n290"), ("s", "c1", "c1")], "root string, child string, node string")
    got = {tuple(r) for r in triples.closure(start, steps).collect()}
    assert got == {("r", "n0", f"n{i}") for i in range(301)} | {("r", "n290", f"n{i}") for i in range(290, 301)} | {("s", "c1", f"c{i}") for i in range(3)}


def test_graphs_keep_their_kinds(spark):
    schema = "s string, p string, o string, o_kind string"
    q = spark.createDataFrame([("a", "p", "x", "literal"), ("b", "p", "x", "uri")], schema)
    a = spark.createDataFrame([("a", "p", "x", "uri"), ("z", "p", "x", "uri")], schema)
    assert sorted(tuple(r) for r in triples.transcribe(q, a).collect()) == [("a", "p", "x", "uri"), ("b", "p", "x", "uri")]
    assert sorted(tuple(r) for r in triples.merge(q, a).collect()) == [("a", "p", "x", "literal"), ("a", "p", "x", "uri"), ("b", "p", "x", "uri")]


def test_sample_sizes(spark):
    from kgloom.operators import lookup

    for n, share in ((0, 0.5), (1, 0.5), (1000, 0.05), (1000, 0.0), (1000, 1.0), (1000, 0.777)):
        ids = spark.range(n).select(F.col("id"))
        got = [r.id for r in lookup.sampled(ids.union(ids), share).collect()]
        assert len(got) == len(set(got)) == int(n * share)
    small, large = ({r.id for r in lookup.sampled(spark.range(1000), x).collect()} for x in (0.1, 0.3))
    assert small < large


def test_aligned_triples_take_the_kinds_of_the_graph(spark):
    q = spark.createDataFrame([("a", "bnode", "p", "x", "literal", "en"), ("b", "uri", "p", "y", "literal", None)], "s string, s_kind string, p string, o string, o_kind string, o_lang string")
    a = spark.createDataFrame([("a", "n", "t"), ("z", "n", "t")], "s string, p string, o string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    a = triples.like(q, a)
    assert rows(triples.transcribe(q, a)) == [("a", "bnode", "n", "t", "uri", None), ("b", "uri", "p", "y", "literal", None)]
    assert rows(triples.merge(q, a)) == rows(a) + [("a", "bnode", "p", "x", "literal", "en"), ("b", "uri", "p", "y", "literal", None)]


def test_coarse_blocks(spark):
    queries = spark.createDataFrame([(f"q{i}", [1.0, i / 7.0]) for i in range(20)] + [("zero", [0.0, 0.0])], "subject string, embedding array<double>")
    centers = spark.createDataFrame([(i, [1.0, i / 3.0]) for i in range(11)], "cluster_id int, centroid array<double>")
    rows = lambda most: sorted((r.subject, r.cluster_id) for r in align.coarse(queries, centers, most).collect())
    assert rows(2) == rows(11) and len(rows(2)) == 20


def odd_vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5)).round(2)
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(100 + i, i % 2, (3 * v).tolist()) for i, v in enumerate(x[:20])] + [(200 + i, i % 2, v.tolist()) for i, v in enumerate(x[:20])]
    return rows + [(300, 0, None), (301, 0, [0.0] * 5), (302, 0, [None, 1.0, 1.0, 1.0, 1.0]), (303, 0, [1.0, 2.0]), (304, 0, [2.0, 4.0]), (305, 0, [float("nan")] * 5), (5, 1, x[3].tolist()), (306, None, [1.0] * 5), (None, 0, [1.0] * 5)]


def test_pairs_of_blocks_equal_single_pairs(spark):
    from kgloom.functions.vectors import cosine

    v = spark.createDataFrame(odd_vectors(), "id long, label int, embedding array<double>")
    w = v.select(F.col("id").alias("b"), "label", F.col("embedding").alias("w"))
    want = v.join(w, "label").filter("id < b").select("id", "b", F.round(cosine(F.col("embedding"), F.col("w")), 6))
    rows = lambda df: sorted(repr(tuple(r)).replace("-0.0)", "0.0)") for r in df.collect())
    assert rows(pairs.within(v, "label", 7)) == rows(pairs.within(v, "label")) == rows(want)


@pytest.mark.parametrize("side", [8, 4096])
def test_fine_compares_blocks(spark, monkeypatch, side):
    from kgloom.functions.vectors import cosine

    monkeypatch.setattr(pairs, "SIDE", side)
    v = spark.createDataFrame([r for r in odd_vectors() if r[0] is not None], "subject long, cluster_id int, embedding array<double>")
    asked, members = v.filter("subject % 3 = 0"), v.filter("subject % 3 <> 0 and cluster_id is not null")
    members = members.unionByName(spark.createDataFrame([(400, 0, [float("inf")] * 5)], members.schema))
    both = asked.join(members.select("cluster_id", F.col("subject").alias("candidate"), F.col("embedding").alias("other")), "cluster_id").withColumn("c", cosine(F.col("embedding"), F.col("other"))).filter("c > 0")
    best = both.groupBy("subject").agg(F.min(F.struct((-F.round("c", 12)).alias("less"), "candidate", "c")).alias("b")).select("subject", "b.candidate", F.round("b.c", 9))
    got = align.fine(asked, members.select("cluster_id", "subject"), members.select("subject", "embedding"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate(zip_with" not in plan  # no cosine by the pair
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert rows(got.select("subject", "candidate", F.round("similarity", 9))) == rows(best)


def test_aligned_subjects_take_the_first_of_equal_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 6))
    vectors = [(f"t{k}{i:02d}", v.tolist()) for k, by in enumerate((1, 3, 1)) for i, v in enumerate(by * x)]
    asked = [(f"q{i:02d}", v.tolist()) for i, v in enumerate(7 * x)]
    q, v = (spark.createDataFrame(rows, "subject string, embedding array<double>") for rows in (asked, vectors))
    found = align.aligned(q, v.select(F.lit(1).alias("cluster_id"), "subject"), v)
    assert "aggregate(zip_with(transform(embedding" not in found._jdf.queryExecution().executedPlan().toString()
    assert got(found) == [(f"q{i:02d}", iri.ALIGN_NAMESPACE, f"t0{i:02d}") for i in range(12)]


def test_search_in_single_precision_loses_no_best(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    y = rng.normal(size=(5000, 16))
    y[3000:4000] = y[:1000] * (1 + 1e-9 * rng.normal(size=(1000, 16)))  # told apart by double precision only
    x = np.concatenate([y[:300] + 1e-9 * rng.normal(size=(300, 16)), rng.normal(size=(300, 16))])
    x = np.concatenate([x, x, x])
    asked, near = [], pairs._near
    monkeypatch.setattr(pairs, "_near", lambda a, b: asked.append(len(a)) or near(a, b))
    q = pa.table({"subject": pa.array(np.arange(1800)), "embedding": pa.array(x.tolist())})
    m = pa.table({"candidate": pa.array(np.arange(5000)), "other": pa.array(y.tolist())})
    found = pairs._nearest(q, m)
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    c = np.round(unit(x) @ unit(y).T, 12)
    assert found["subject"].to_pylist() == list(range(1800)) and sum(asked) == 600  # equal queries are compared once
    assert found["candidate"].to_pylist() == c.argmax(1).tolist() and np.allclose(found["c"].to_numpy(), c.max(1), atol=1e-11)


def test_coarse_ties_at_twelve_digits(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "subject string, embedding array<double>")
    centers = spark.createDataFrame([(1, [1.0, 1e-7]), (2, [3.0, 0.0]), (3, [0.0, 0.0])], "cluster_id int, centroid array<double>")
    out = align.coarse(queries, centers)
    assert [tuple(r)[0::2] for r in out.collect()] == [("q", 1)]


def test_mapped_triples_are_the_distinct_ones(spark):
    rng = np.random.default_rng(2)
    pick = lambda *of: [None if rng.random() < 0.1 else of[rng.integers(len(of))] for _ in range(200)]
    d = spark.createDataFrame(list(zip(pick(1, 2, 3), pick(7, 8), pick(" 4", "4", "nan", ""), strict=True)), "row_id long, subject_id long, icd9_code string")
    labs = spark.createDataFrame(list(zip(pick(1, 2, 3), pick(7, 8, 9), pick(5, 6), pick("NA", "1 %", "", "a/b"), pick("c", " c", "nan", ""), strict=True)), "row_id long, subject_id long, itemid long, value string, loinc_code string")
    want = triples.diagnosis_triples(d).unionByName(triples.lab_triples(labs)).distinct()
    out = triples.mapped(d, labs)
    assert got(out) == got(want)
    sent = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert sent and not any("o#" in line for line in sent)  # keys are shuffled, no triples
