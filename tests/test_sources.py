import pytest
from pyspark.sql import functions as F

from kgloom.functions import iri
from kgloom.plans import pipelines
from kgloom.sources import lines, rdf, sinks, tables
from kgloom.streaming.facts import validate_stream

TURTLE = '''@prefix ex: <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
PREFIX sk: <http://www.w3.org/2004/02/skos/core#>
# a comment
<http://snomed.info/id/5> rdfs:label "Heart \\"block\\""@en , "plain" ; sk:altLabel """long
text""" ; a ex:Thing .
ex:a.b ex:p [ ex:q 5 , 1.5 , 1e3 ; ex:r true ] , ( 1 _:z ) .
_:z ex:s 'x'^^ex:t . [] ex:p ex:c. ex:d ex:p 7 .
'''


def files(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def test_turtle(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TURTLE)
    out = {(r.s, r.p, r.o, r.o_kind, r.o_datatype, r.o_lang) for r in rdf.read(spark, str(tmp_path / "g.ttl")).collect()}
    assert ("http://snomed.info/id/5", iri.RDFS_LABEL, 'Heart "block"', "literal", None, "en") in out
    assert ("http://snomed.info/id/5", iri.SKOS_ALT, "long\ntext", "literal", None, None) in out
    assert ("http://snomed.info/id/5", iri.RDF_TYPE, "http://x/Thing", "uri", None, None) in out
    assert {(o, t.rpartition("#")[2]) for _, p, o, _, t, _ in out if p in ("http://x/q", "http://x/r")} == {("5", "integer"), ("1.5", "decimal"), ("1e3", "double"), ("true", "boolean")}
    assert any(s == "http://x/a.b" for s, *_ in out) and any(p.endswith("#first") for _, p, *_ in out) and ("http://x/d", "http://x/p", "7", "literal", "http://www.w3.org/2001/XMLSchema#integer", None) in out
    names = rdf.labels(rdf.read(spark, str(tmp_path / "g.ttl"))).collect()
    assert sorted(r.label for r in names) == ['Heart "block"', "long\ntext", "plain"] and {r.concept_id for r in names} == {"5"}
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", "<a> <b> ^ ."):
        with pytest.raises(rdf.TurtleError):
            rdf.parse_turtle(bad)
    with pytest.raises(ValueError, match="unknown format"):
        rdf.read(spark, "x.csv")


def test_ntriples_round_trip(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TURTLE)
    g = rdf.read(spark, str(tmp_path / "g.ttl"))
    sinks.ntriples(g, str(tmp_path / "out.nt"))
    back = rdf.read(spark, str(tmp_path / "out.nt"))
    pick = lambda df: sorted((r.p, r.o if r.o_kind != "bnode" else "", r.o_kind, r.o_datatype or "", r.o_lang or "") for r in df.collect())
    assert pick(back) == pick(g)
    assert rdf.ntriples(spark.createDataFrame([("# x",), ("<a> <b> .",), ("",), (None,)], "value string")).count() == 0


def test_rdf_xml_and_links(spark, tmp_path):
    xml = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/"><r:Description r:about="http://a"><x:p r:resource="http://b"/><x:q xml:lang="en">t</x:q><x:n><x:K r:nodeID="m"/></x:n></r:Description></r:RDF>'
    (tmp_path / "g.rdf").write_text(xml)
    out = {(r.s.split("-")[-1], r.p, r.o.split("-")[-1], r.o_kind, r.o_lang) for r in rdf.read(spark, str(tmp_path / "g.rdf")).collect()}
    assert out == {("http://a", "http://x/p", "http://b", "uri", None), ("http://a", "http://x/q", "t", "literal", "en"), ("http://a", "http://x/n", "m", "bnode", None), ("m", iri.RDF_TYPE, "http://x/K", "uri", None)}
    links = '<A xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><B><r:Description><hasCode> icd9#1 </hasCode><Linked r:resource="http://snomed.info/id/2"/></r:Description></B><r:Description><hasCode/></r:Description></A>'
    assert [tuple(r) for r in rdf.link_results(spark.createDataFrame([(links,)], "value string")).collect()] == [("icd9#1", "http://snomed.info/id/2")]


def test_lines(spark):
    rows = spark.createDataFrame([(1, "<a>  <b>\t<c>"), (2, ""), (3, "a b"), (4, "a b c d"), (5, None)], "line_no long, value string")
    assert [(r.line_no, r.s, r.p, r.o) for r in lines.facts(rows).collect()] == [(1, "a", "b", "c")]
    assert sorted(tuple(r) for r in lines.triples(rows).collect()) == [("<a>", "<b>", "<c>"), ("a", "b", "c d")]
    bad = spark.createDataFrame([("s", "p", "a\nb")], "s string, p string, o string")
    assert bad.select(lines.joined("\t", "s", "p", "o")).first()[0] == "s\tp\ta b"


def test_tables_and_modules(spark, tmp_path):
    (tmp_path / "d.csv").write_text('ROW_ID,SUBJECT_ID,ICD9_CODE\n1,2,0389\n2,3,\n')
    assert [(r.row_id, r.icd9_code, r.hadm_id) for r in tables.csv(spark, str(tmp_path / "d.csv"), "diagnoses").collect()] == [(1, "0389", None), (2, None, None)]
    (tmp_path / "x.csv").write_text('id,description\n1," a, ""b"" "\n')
    assert tables.descriptions(spark, str(tmp_path / "x.csv")).first().description == 'a, "b"'
    titles = spark.createDataFrame([(1, " 1 ", "s", "old"), (2, "1", "s", "new ")], "row_id long, icd9_code string, short_title string, long_title string")
    assert [tuple(r) for r in tables.icd_descriptions(titles).collect()] == [("1", "s", "new")]
    (tmp_path / "e.csv").write_text("a,b\n")
    m = tables.Modules(spark, {"ok": str(tmp_path / "d.csv"), "gone": str(tmp_path / "gone.csv"), "empty": str(tmp_path / "e.csv")})
    assert m("ok").count() == 2
    for name, error in (("what", ValueError), ("gone", FileNotFoundError), ("empty", ValueError)):
        with pytest.raises(error):
            m(name)


def test_pipelines_to_files(spark, tmp_path):
    (tmp_path / "c.ttl").write_text('<http://snomed.info/id/5> <http://www.w3.org/2000/01/rdf-schema#label> "Heart block" .')
    (tmp_path / "d.csv").write_text("id,description\n1,heart block\n2,nothing\n3,Heart block!\n")
    pipelines.entity_linking(spark, str(tmp_path / "d.csv"), str(tmp_path / "c.ttl"), str(tmp_path / "m"), str(tmp_path / "k"))
    assert [x for x in files(tmp_path / "m") if not x.startswith("id,")] == ["1,heart block,5,1.00", "2,nothing,No match,0.00", "3,Heart block!,5,1.00"]
    assert files(tmp_path / "k")[-1] == "5,2,1;3,heart block;Heart block!,1.00;1.00"
    pipelines.ontology_text(spark, str(tmp_path / "c.ttl"), str(tmp_path / "s"), str(tmp_path / "t"))
    assert files(tmp_path / "t") == ['snomed#5\thttp://www.w3.org/2000/01/rdf-schema#label\t"Heart block"']
    g = spark.createDataFrame([("a", iri.RDF_TYPE, "A"), ("a2", iri.RDF_TYPE, "A"), ("b", iri.RDF_TYPE, "B"), ("a", "p", "b"), ("p", iri.RDFS_DOMAIN, "A"), ("p", iri.RDFS_RANGE, "B")], "s string, p string, o string")
    (tmp_path / "f.txt").write_text("<a>  <p>  <b>\n<z> <p> <b>\nbroken\n")
    pipelines.fact_validation(spark, str(tmp_path / "f.txt"), g, str(tmp_path / "v"))
    assert files(tmp_path / "v") == ["<a> <p> <b>"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("<a> <p> <b>\n<z> <p> <b>\n")
    validate_stream(spark, str(tmp_path / "in"), g, str(tmp_path / "stream"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.s for r in spark.read.parquet(str(tmp_path / "stream")).select(F.col("s")).collect()] == ["a"]


def test_escapes_are_undone_once(spark):
    rows = [r'<a> <p> "back\\n slash" .', r'<b> <p> "tab\tline\nquote\"ué \U0001F600 \\u0041" .', "# a comment", "", "broken", None]
    lines_ = spark.createDataFrame([(x,) for x in rows], "value string")
    out = {r.s: r.o for r in rdf.ntriples(lines_).collect()}
    assert out == {"a": "back\\n slash", "b": 'tab\tline\nquote"ué \U0001f600 \\u0041'}
    assert rdf.malformed(lines_) == 1


def test_graphs_are_kept_by_path(spark, tmp_path):
    (tmp_path / "g.nt").write_text("<a> <p> <b> .\n")
    assert rdf.cached(spark, str(tmp_path / "g.nt")) is rdf.cached(spark, str(tmp_path / "g.nt"))
    rdf.cached(spark, str(tmp_path / "g.nt")).unpersist()
