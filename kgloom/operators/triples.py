"""Triples (s, s_kind, p, o, o_kind): building, set operations and blank-node closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iri
from .lineage import cut

TRIPLE = ("s", "p", "o")


def triple(s: Column, p, o: Column) -> Column:
    p = p if isinstance(p, Column) else F.lit(p)
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))


def typed(s: Column, name: str) -> Column:
    return triple(s, iri.RDF_TYPE, F.lit(iri.SPHN + name))


def related(s: Column, name: str, o: Column) -> Column:
    return triple(s, iri.SPHN + name, o)


def fan_out(df: DataFrame, always: list[Column], optional: list[Column] = (), when: Column | None = None) -> DataFrame:
    """Several triples per row in one scan; the optional ones where `when` holds."""
    many = F.array(*always)
    if optional:
        many = F.when(when, F.concat(many, F.array(*optional))).otherwise(many)
    return df.select(F.explode(many).alias("t")).select("t.*")


def diagnosis_triples(df: DataFrame) -> DataFrame:
    """diagnoses (row_id, subject_id, icd9_code) -> five triples a row; a null code is the text nan."""
    row, subject = F.col("row_id"), F.col("subject_id")
    d, who = iri.local("Diagnosis", subject, "PATIENTS", row), iri.local("PATIENTS", subject)
    code = iri.coded("icd9", F.coalesce(F.trim(F.col("icd9_code").cast("string")), F.lit("nan")))
    return fan_out(df, [typed(d, "Diagnosis"), typed(who, "SubjectPseudoIdentifier"), related(d, "hasSubjectPseudoIdentifier", who), typed(code, "Code"), related(d, "hasCode", code)])


def lab_triples(df: DataFrame) -> DataFrame:
    """lab events (row_id, subject_id, itemid, value, loinc_code) -> seven triples a row, ten with a code; rows with a null key drop out."""
    df = df.dropna(subset=["row_id", "subject_id", "itemid"])
    whole = lambda c: F.col(c).cast("long")
    event, who = iri.local("LabTestEvent", whole("subject_id"), "PATIENTS", whole("row_id")), iri.local("PATIENTS", whole("subject_id"))
    test = iri.local("LabTest", whole("subject_id"), "PATIENTS", whole("itemid"))
    result = iri.local("LabResult", whole("subject_id"), "PATIENTS", whole("itemid"), iri.quoted(F.col("value")))
    text = F.trim(F.col("loinc_code").cast("string"))
    loinc = iri.coded("loinc", text)
    always = [typed(event, "LabTestEvent"), typed(who, "SubjectPseudoIdentifier"), related(event, "hasSubjectPseudoIdentifier", who), typed(test, "LabTest"),
              related(event, "hasLabTest", test), typed(result, "LabResult"), related(test, "hasResult", result)]
    known = F.coalesce(~text.isin("", "nan"), F.lit(False))
    return fan_out(df, always, [typed(loinc, "Code"), related(test, "hasCode", loinc), related(result, "hasCode", loinc)], known)


def mapped(diagnoses: DataFrame, labs: DataFrame) -> DataFrame:
    """The distinct triples of diagnosis_triples() and lab_triples(), for keys that are numbers.

    Each kind of triple is made from the distinct values of the columns that it names, so short keys are shuffled and no triple is.
    """
    text = lambda c: F.trim(F.col(c).cast("string"))
    d = diagnoses.select(F.col("row_id"), F.col("subject_id"), F.coalesce(text("icd9_code"), F.lit("nan")).alias("code"))
    whole = [F.col(c).cast("long").alias(c) for c in ("row_id", "subject_id", "itemid")]
    lab = labs.dropna(subset=["row_id", "subject_id", "itemid"]).select(*whole, iri.quoted(F.col("value")).alias("result"), text("loinc_code").alias("code"))
    known = F.coalesce(~F.col("code").isin("", "nan"), F.lit(False))
    who, diagnosis = iri.local("PATIENTS", F.col("subject_id")), iri.local("Diagnosis", F.col("subject_id"), "PATIENTS", F.col("row_id"))
    event = iri.local("LabTestEvent", F.col("subject_id"), "PATIENTS", F.col("row_id"))
    test = iri.local("LabTest", F.col("subject_id"), "PATIENTS", F.col("itemid"))
    result = F.concat(iri.local("LabResult", F.col("subject_id"), "PATIENTS", F.col("itemid")), F.lit("/"), F.col("result"))
    icd9, loinc = iri.coded("icd9", F.col("code")), iri.coded("loinc", F.col("code"))
    of = lambda df, *keys: df.select(*keys).distinct()
    parts = [
        fan_out(of(d.select("subject_id").unionByName(lab.select("subject_id")), "subject_id"), [typed(who, "SubjectPseudoIdentifier")]),
        fan_out(of(d, "row_id", "subject_id"), [typed(diagnosis, "Diagnosis"), related(diagnosis, "hasSubjectPseudoIdentifier", who)]),
        fan_out(of(d, "row_id", "subject_id", "code"), [related(diagnosis, "hasCode", icd9)]),
        fan_out(of(d, "code"), [typed(icd9, "Code")]),
        fan_out(of(lab, "row_id", "subject_id"), [typed(event, "LabTestEvent"), related(event, "hasSubjectPseudoIdentifier", who)]),
        fan_out(of(lab, "row_id", "subject_id", "itemid"), [related(event, "hasLabTest", test)]),
        fan_out(of(lab, "subject_id", "itemid"), [typed(test, "LabTest")]),
        fan_out(of(lab, "subject_id", "itemid", "result"), [typed(result, "LabResult"), related(test, "hasResult", result)]),
        fan_out(of(lab.filter(known), "subject_id", "itemid", "code"), [related(test, "hasCode", loinc)]),
        fan_out(of(lab.filter(known), "subject_id", "itemid", "result", "code"), [related(result, "hasCode", loinc)]),
        fan_out(of(lab.filter(known), "code"), [typed(loinc, "Code")]),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def rewritten(triples: DataFrame) -> DataFrame:
    """IRI subjects' triples with shortened terms; triples of blank nodes drop out."""
    kept = triples.filter("s_kind = 'uri'")
    return kept.select(iri.rewrite(F.col("s")).alias("s"), iri.rewrite_predicate(F.col("p")).alias("p"), iri.rewrite_object(F.col("p"), F.col("o"), F.col("o_kind")).alias("o"))


def union(*graphs: DataFrame) -> DataFrame:
    """The triples of all graphs, each once."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out.distinct()


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    """The columns that both graphs have: at least s, p, o, and the kinds where both know them."""
    return [c for c in a.columns if c in b.columns]


def transcribe(query: DataFrame, aligned: DataFrame) -> DataFrame:
    """The query graph with the triples of aligned subjects replaced by the aligned ones; one plan, two shuffles on s."""
    columns = _shared(query, aligned)
    q, a = query.select(*columns), aligned.select(*columns)
    return q.join(a.select("s"), "s", "left_anti").unionByName(a.join(q.select("s"), "s", "left_semi")).select(*columns).distinct()


def merge(query: DataFrame, aligned: DataFrame) -> DataFrame:
    """The query graph and the aligned triples of its subjects."""
    columns = _shared(query, aligned)
    q, a = query.select(*columns), aligned.select(*columns)
    return q.unionByName(a.join(q.select("s"), "s", "left_semi").select(*columns)).distinct()


def like(query: DataFrame, aligned: DataFrame) -> DataFrame:
    """The aligned triples of the query's subjects, with the query's columns: kinds of subjects as the query has them, other kinds that are not given are IRIs."""
    known = ["s_kind"] if "s_kind" in query.columns and "s_kind" not in aligned.columns else []
    found = aligned.join(query.select("s", *known).distinct(), "s")
    missing = lambda c: F.lit("uri") if c.endswith("_kind") else F.lit(None).cast(query.schema[c].dataType)
    return found.select(*[F.col(c) if c in found.columns else missing(c).alias(c) for c in query.columns])


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given positions; the filters reach the scan."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.filter(F.col(name) == value)
    return triples


def bnode_closure(triples: DataFrame) -> DataFrame:
    """(root, child, node): all blank nodes reachable from each blank-node object `child` of a non-blank subject `root`."""
    links = triples.filter("o_kind = 'bnode'").select("s", "s_kind", "o").distinct()
    inner = links.filter("s_kind = 'bnode'").select(F.col("s").alias("node"), F.col("o").alias("next"))
    frontier = links.filter("s_kind <> 'bnode'").select(F.col("s").alias("root"), F.col("o").alias("child"), F.col("o").alias("node"))
    return closure(frontier, inner)


def closure(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(root, child, node) closed under steps (node, next).

    Distances double: round k knows the nodes less than 2**k steps away and the pairs of nodes exactly 2**k steps apart, so a chain of n
    nodes takes log2(n) rounds.  A round that finds no new node ends it, on cycles too; lineage is cut every round.
    """
    seen, jump = cut(start.distinct()), cut(steps.distinct())
    while True:
        reached = seen.join(jump, "node").select("root", "child", F.col("next").alias("node")).distinct()
        new = cut(reached.join(seen, ["root", "child", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))
        further = jump.select(F.col("node").alias("next"), F.col("next").alias("last"))
        jump = cut(jump.join(further, "next").select("node", F.col("last").alias("next")).distinct())


def count_of(rows: DataFrame) -> int:
    """A count query's answer: the first row's first present one of count, sum, b1, b2, b3, else 0."""
    names = [c for c in ("count", "sum", "b1", "b2", "b3") if c in rows.columns]
    row = rows.select(F.coalesce(*names, F.lit(0)).cast("long").alias("n")).first() if names else None
    return row.n if row is not None else 0


def counts(triples: DataFrame) -> DataFrame:
    """One row: n_triples, the distinct triples, and n_subjects, their subjects."""
    return triples.select(*TRIPLE).distinct().agg(F.count(F.lit(1)).alias("n_triples"), F.count_distinct("s").alias("n_subjects"))
