import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions import iri, scores, text, vectors


def one(spark, row, schema, *cols):
    return tuple(spark.createDataFrame([row], schema).select(*cols).first())


@pytest.mark.parametrize(("a", "b", "ratio", "jaccard", "both"), [
    ("kitten", "sitting", 0.615385, 0.0, 0.307692), ("Atrial fibrillation, unspecified", "Atrial fibrillation", 0.76, 0.666667, 0.713333), ("a a b", "a b b", 0.8, 0.5, 0.65),
    ("Nonrheumatic aortic (valve) stenosis", "aortic stenosis nonrheumatic", 0.483871, 0.75, 0.616935), ("Heart-block", "heart block", 0.952381, 0.0, 0.47619), ("", "-", 1.0, 0.0, 0.5), ("", "abc", 0.0, 0.0, 0.0)])
def test_similarities(spark, a, b, ratio, jaccard, both):
    x, y = text.normalized(F.col("a")), text.normalized(F.col("b"))
    got = one(spark, (a, b), "a string, b string", text.indel_ratio(x, y), text.weighted_jaccard(text.tokens(x), text.tokens(y)), text.composite(F.col("a"), F.col("b")))
    assert got == pytest.approx((ratio, jaccard, both), abs=1e-6)


@settings(max_examples=200, deadline=None)
@given(st.text("abc é", max_size=12), st.text("abc é", max_size=12))
def test_ratio_properties(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 1.0 if not a and not b else 2 * table[-1][-1] / (len(a) + len(b))
    assert text.ratio(a, b) == pytest.approx(want) == pytest.approx(text.ratio(b, a))


def test_tokens_and_normal_forms(spark):
    got = one(spark, ("  A b B, b.", None), "a string, n string", text.normalized(F.col("a")), text.tokens(F.col("a")), text.token_set(F.col("a")), text.normalized(F.col("n")), text.tokens(F.col("n")), text.indel_ratio(F.col("a"), F.col("n")))
    assert got == ("a b b b", ["A", "b", "B,", "b."], ["a", "b"], "", [], None)


def test_sink_numbers(spark):
    assert one(spark, (0.125, 0.705), "a double, b double", text.two_digits(F.col("a")), text.two_digits(F.col("b")), text.three_digits(F.col("a"))) == ("0.12", "0.70", "0.125")


@pytest.mark.parametrize(("uri", "short"), [
    ("http://example.org/Code/icd9#51919", "icd9#51919"), ("http://snomed.info/id/22298006", "snomed#22298006"), ("http://example.org/LabTestEvent/1/PATIENTS/2", "LabTestEvent/1/PATIENTS/2"),
    ("http://example.org/x", "x"), ("urn:y", "urn:y")])
def test_rewrite(spark, uri, short):
    sphn = iri.SPHN + "LabTest"
    got = one(spark, (uri, sphn, iri.RDF_TYPE), "u string, c string, t string", iri.rewrite(F.col("u")), iri.rewrite_type(F.col("c")), iri.rewrite_object(F.col("t"), F.col("c"), F.lit("uri")),
              iri.rewrite_object(F.lit("p"), F.col("c"), F.lit("uri")), iri.rewrite_object(F.lit("p"), F.col("u"), F.lit("literal")), iri.rewrite_predicate(F.col("t")), iri.rewrite_predicate(F.col("c")))
    assert got == (short, "LabTest", "LabTest", sphn, f'"{uri}"', iri.RDF_TYPE, "LabTest")


def test_codes_and_quoting(spark):
    u = F.col("u")
    rows = [("icd9#412", "412", None, "412"), ("ICD10#AB123", "AB123", None, None), ("http://example.org/Code/icd9#412", None, None, "412"), ("http://snomed.info/id/212505002", None, "212505002", None), ("http://snomed.info/id/12x", None, None, None)]
    for raw, icd, concept, graph in rows:
        assert one(spark, (raw,), "u string", iri.icd_code(u), iri.concept_id(u), iri.icd9_of(u)) == (icd, concept, graph)
    for raw, out in (("7.0 mg/dL", "7.0%20mg%2FdL"), ("*<>~-._+%&é", "%2A%3C%3E~-._%2B%25%26%C3%A9"), (None, "NA")):
        assert one(spark, (raw,), "u string", iri.quoted(u)) == (out,)
    assert one(spark, ("<<a>b>",), "u string", iri.bare(u), iri.trailing_number(F.lit("x/7"))) == ("a>b", "7")


@pytest.mark.parametrize(("args", "want"), [
    ((300, 300, 300, 1500, 5), 1.0), ((1500, 300, 300, 1500, 5), 0.5), ((1500, 215, 215, 1500, 5), 0.453105), ((40, 10, 5, 10, 10), 0.69897), ((10, 0, 5, 10, 10), 0.0), ((5, 5, 5, 0, 10), 0.0), ((100, 100, 100, 10, 10), 0.0), ((90, 10, 50, 10, 10), 0.0)])
def test_npmi(spark, args, want):
    assert one(spark, args, "a long, b long, c long, d long, e long", scores.npmi(*[F.col(c) for c in "abcde"]))[0] == pytest.approx(want, abs=1e-6)


def test_veracity(spark):
    v = lambda xs, **k: spark.createDataFrame([(x,) for x in xs], "x double").agg(scores.veracity(F.col("x"), **k)).first()[0]
    assert v([0.5, 0.6]) == pytest.approx(0.8) and v([]) == 0.0 and v([1.0, 0.3]) == 1.0
    assert v([1.5, 2.0]) == pytest.approx(0.5) and v([3.0], clamp=True) == 1.0


def test_vectors(spark):
    got = one(spark, ([3.0, 4.0], [0.0, 0.0], "[1 2.5\n-3e1]", "[1 x]"), "a array<float>, z array<float>, t string, b string", vectors.cosine(F.col("a"), F.col("a")), vectors.cosine(F.col("a"), F.col("z")), vectors.parsed(F.col("t")), vectors.parsed(F.col("b")))
    assert got[0] == pytest.approx(1.0) and got[1:] == (None, [1.0, 2.5, -30.0], None)
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "k string, v array<double>")
    assert {r.k: r.m for r in vectors.mean_by(df, ["k"], "v", "m").collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
    assert math.isclose(text.ratio("", ""), 1.0)
