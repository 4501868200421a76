"""The operators bound to the driver's tables, each with the SQL of the same result.

Every query reads its whole tables.  Numbers are rounded to six digits on both sides where they are sums or ratios of doubles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iri, text
from ..functions.scores import npmi
from ..functions.vectors import mean_by, parsed
from ..operators import align, encoders, facts, linkcheck, linking, lookup, pairs, triples
from ..operators.lineage import cut, folder
from ..sources import lines, rdf, sinks, tables
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PUNCT = r"!\"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(c) -> F.Column:
    return F.round(c, 6)


# ---- IRIs and triples -------------------------------------------------------------------------


@query("""SELECT o_orderkey, 'http://example.org/Order/' || o_custkey || '/CUSTOMER/' || o_orderkey AS iri,
  'http://example.org/Priority/' || coalesce(url_encode(o_orderpriority), 'NA') AS value_iri FROM orders""")
def iri_template(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", iri.local("Order", F.col("o_custkey"), "CUSTOMER", F.col("o_orderkey")).alias("iri"), iri.local("Priority", iri.quoted(F.col("o_orderpriority"))).alias("value_iri"))


_DIAGNOSES = """SELECT unnest([
  {{'s': d, 'p': '{T}', 'o': '{S}Diagnosis'}}, {{'s': w, 'p': '{T}', 'o': '{S}SubjectPseudoIdentifier'}}, {{'s': d, 'p': '{S}hasSubjectPseudoIdentifier', 'o': w}},
  {{'s': c, 'p': '{T}', 'o': '{S}Code'}}, {{'s': d, 'p': '{S}hasCode', 'o': c}}]) AS x
  FROM (SELECT 'http://example.org/Diagnosis/' || o_custkey || '/PATIENTS/' || o_orderkey AS d, 'http://example.org/PATIENTS/' || o_custkey AS w,
    'http://example.org/Code/icd9#' || trim(o_orderpriority) AS c FROM orders)""".format(T=iri.RDF_TYPE, S=iri.SPHN)


def _diagnoses(spark, d):
    return triples.diagnosis_triples(t(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("icd9_code")))


@query(f"SELECT x.s AS s, x.p AS p, x.o AS o FROM ({_DIAGNOSES})")
def triple_fanout_orders(spark, d):
    return _diagnoses(spark, d)


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_size::VARCHAR END AS code FROM part),
r AS (SELECT 'http://example.org/LabTestEvent/' || l_suppkey || '/PATIENTS/' || l_orderkey AS e, 'http://example.org/PATIENTS/' || l_suppkey AS w,
  'http://example.org/LabTest/' || l_suppkey || '/PATIENTS/' || l_partkey AS t,
  'http://example.org/LabResult/' || l_suppkey || '/PATIENTS/' || l_partkey || '/' || l_linenumber AS r, 'http://example.org/Code/loinc#' || code AS k
  FROM lineitem LEFT JOIN c ON p_partkey = l_partkey),
x AS (SELECT unnest([{{'s': e, 'p': '{T}', 'o': '{S}LabTestEvent'}}, {{'s': w, 'p': '{T}', 'o': '{S}SubjectPseudoIdentifier'}}, {{'s': e, 'p': '{S}hasSubjectPseudoIdentifier', 'o': w}},
  {{'s': t, 'p': '{T}', 'o': '{S}LabTest'}}, {{'s': e, 'p': '{S}hasLabTest', 'o': t}}, {{'s': r, 'p': '{T}', 'o': '{S}LabResult'}}, {{'s': t, 'p': '{S}hasResult', 'o': r}}]
  || CASE WHEN k IS NULL THEN [] ELSE [{{'s': k, 'p': '{T}', 'o': '{S}Code'}}, {{'s': t, 'p': '{S}hasCode', 'o': k}}, {{'s': r, 'p': '{S}hasCode', 'o': k}}] END) AS x FROM r)
SELECT x.s AS s, x.p AS p, x.o AS o FROM x""".format(T=iri.RDF_TYPE, S=iri.SPHN))
def triple_fanout_lineitem(spark, d):
    codes = t(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.when(F.col("p_size") <= 20, F.col("p_size").cast("string")).alias("loinc_code"))
    labs = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("itemid"), F.col("l_linenumber").alias("value"))
    return triples.lab_triples(labs.join(codes, "itemid", "left"))


@query("""WITH keep AS (SELECT c_custkey FROM customer WHERE (c_custkey * 7919) % 100 < 5),
  o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM keep)),
  p AS (SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)))
SELECT 'order' AS kind, o_orderkey AS id FROM o UNION ALL SELECT 'part', p_partkey FROM p""")
def sample_semi_join(spark, d):
    keep = t(spark, d, "customer").filter((F.col("c_custkey") * 7919) % 100 < 5).select(F.col("c_custkey").alias("o_custkey"))
    o = lookup.of_sample(t(spark, d, "orders").select("o_orderkey", "o_custkey"), keep, "o_custkey")
    used = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(o.select("o_orderkey"), "o_orderkey", "left_semi")
    p = lookup.in_use(t(spark, d, "part").select("p_partkey"), used, "p_partkey")
    return o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(p.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")))


@query("SELECT floor(count(DISTINCT c_custkey) * 0.05)::BIGINT AS n, floor(count(DISTINCT c_custkey) * 0.05)::BIGINT AS n_known FROM customer")
def sample_subjects(spark, d):
    """SMP-01: how many distinct ids are sampled and how many of them the table has; which ones is fixed by Spark's hash, which SQL elsewhere lacks."""
    c = t(spark, d, "customer").select("c_custkey")
    keep = lookup.sampled(c, 0.05).distinct()
    known = keep.join(c.distinct().withColumn("known", F.lit(1)), "c_custkey", "left")
    return known.agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"))


_SHORT = "CASE " + " ".join(f"WHEN starts_with({{x}}, '{p}') THEN '{s}' || substr({{x}}, {len(p) + 1})" for p, s in iri.PREFIXES) + " ELSE {x} END"


def _short(x: str, schema: bool = False) -> str:
    out = _SHORT.replace("{x}", x)
    return f"CASE WHEN starts_with({x}, '{iri.SPHN}') THEN replace({x}, '{iri.SPHN}', '') ELSE {out} END" if schema else out


_REWRITTEN = f"""SELECT {_short('x.s')} AS s, CASE WHEN x.p = '{iri.RDF_TYPE}' THEN x.p ELSE {_short('x.p', True)} END AS p,
  CASE WHEN x.p = '{iri.RDF_TYPE}' THEN {_short('x.o', True)} ELSE {_short('x.o')} END AS o FROM ({_DIAGNOSES})"""


@query(_REWRITTEN + """
UNION ALL SELECT 'Diagnosis/' || doc_id, 'label', '"' || coalesce(lang, '?') || '"' FROM documents""")
def rewrite_triples(spark, d):
    a = _diagnoses(spark, d).select(F.lit("uri").alias("s_kind"), "s", "p", "o", F.lit("uri").alias("o_kind"))
    docs = t(spark, d, "documents")
    b = docs.select(F.lit("uri").alias("s_kind"), iri.local("Diagnosis", F.col("doc_id")).alias("s"), F.lit(iri.LOCAL + "label").alias("p"), F.coalesce("lang", F.lit("?")).alias("o"), F.lit("literal").alias("o_kind"))
    c = docs.select(F.lit("bnode").alias("s_kind"), F.col("doc_id").cast("string").alias("s"), F.lit("x").alias("p"), F.lit("y").alias("o"), F.lit("uri").alias("o_kind"))
    return triples.rewritten(a.unionByName(b).unionByName(c))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS k FROM l)
SELECT k[1] || chr(9) || k[2] || chr(9) || array_to_string(k[3:], ' ') AS line FROM w WHERE len(k) >= 3""")
def format_triples_tsv(spark, d):
    rows = t(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return lines.triples(rows).select(lines.joined("\t", "s", "p", "o").alias("line"))


@query("SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 100 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def lookup_first_wins(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return lookup.first_of(rows, ["l_partkey"], ["ord"]).select("l_partkey", "l_suppkey")


@query("SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 100 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def lookup_last_wins(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return lookup.last_of(rows, ["l_partkey"], ["ord"]).select("l_partkey", "l_suppkey")


# ---- text ------------------------------------------------------------------------------------

_NORM = f"regexp_replace(translate(lower({{x}}), '{PUNCT.replace(chr(92) + chr(34), chr(34))}', ''), '^\\s+|\\s+$', '', 'g')"
_TOKENS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"


def _norm(x: str) -> str:
    return _NORM.replace("{x}", x)


def _tokens(x: str) -> str:
    return _TOKENS.replace("{x}", x)


def _ratio(a: str, b: str) -> str:
    lcs = (f"(list_reduce(string_split({a}, ''), lambda prev, ca: list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur, greatest(cur[j], prev[j + 1], "
           f"prev[j] + (CASE WHEN substring({b}, j, 1) = ca THEN 1 ELSE 0 END)::BIGINT)), [0::BIGINT]), list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)))[-1]")
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 2.0 * {lcs} / (length({a}) + length({b})) END)"


def _jaccard(a: str, b: str) -> str:
    low = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0)"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {low} / (len({a}) + len({b}) - {low}) END)"


@query(f"SELECT item_id, {_norm('text')} AS norm, len(list_distinct({_tokens(_norm('text'))})) AS n_tokens FROM benchmark")
def normalize_text(spark, d):
    b = t(spark, d, "benchmark")
    return b.select("item_id", text.normalized(F.col("text")).alias("norm"), F.size(text.token_set(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, len({_tokens('text')})::BIGINT AS n, len(list_distinct({_tokens(_norm('text'))}))::BIGINT AS n_distinct FROM documents")
def tokenize_distinct(spark, d):
    docs = t(spark, d, "documents")
    return docs.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"), F.size(text.token_set(F.col("text"))).cast("long").alias("n_distinct"))


@query(f"SELECT token, count(DISTINCT doc_id)::BIGINT AS n FROM (SELECT doc_id, unnest({_tokens(_norm('text'))}) AS token FROM documents) GROUP BY token")
def token_index(spark, d):
    index = linking.token_index(t(spark, d, "documents").select(F.col("doc_id").alias("concept_id"), F.col("text").alias("label")))
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH i AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({_tokens(_norm('text'))}) AS token FROM documents))
SELECT token, doc_id FROM i WHERE token IN (SELECT token FROM i GROUP BY token HAVING count(*) <= 2000)""")
def block_cleaning(spark, d):
    index = linking.token_index(t(spark, d, "documents").select(F.col("doc_id").alias("concept_id"), F.col("text").alias("label")))
    return linking.cleaned(index).select("token", F.col("concept_id").alias("doc_id"))


@query(f"""WITH n AS (SELECT DISTINCT {_norm('p_name')} AS name FROM part) SELECT a.name AS a, b.name AS b, round({_ratio('a.name', 'b.name')}, 6) AS ratio FROM n a, n b WHERE a.name < b.name""")
def indel_ratio(spark, d):
    n = t(spark, d, "part").select(text.normalized(F.col("p_name")).alias("a")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return pairs.withColumn("ratio", _six(text.indel_ratio(F.col("a"), F.col("b"))))


@query(f"""WITH n AS (SELECT DISTINCT p_type, p_brand FROM part), w AS (SELECT *, {_tokens(_norm("p_type || ' ' || p_brand || ' ' || p_brand"))} AS x, {_tokens(_norm("p_brand || ' ' || p_type"))} AS y FROM n)
SELECT p_type, p_brand, round({_jaccard('x', 'y')}, 6) AS score FROM w""")
def weighted_jaccard(spark, d):
    n = t(spark, d, "part").select("p_type", "p_brand").distinct()
    x, y = F.concat_ws(" ", "p_type", "p_brand", "p_brand"), F.concat_ws(" ", "p_brand", "p_type")
    return n.select("p_type", "p_brand", _six(text.weighted_jaccard(text.tokens(text.normalized(x)), text.tokens(text.normalized(y)))).alias("score"))


@query(f"""WITH n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT p_name AS a, p_name || ', ' || upper(split_part(p_name, ' ', 1)) AS b FROM n),
y AS (SELECT *, {_norm('a')} AS na, {_norm('b')} AS nb FROM x), w AS (SELECT *, {_tokens('na')} AS ta, {_tokens('nb')} AS tb FROM y)
SELECT a, b, round(0.5 * {_jaccard('ta', 'tb')} + 0.5 * {_ratio('na', 'nb')}, 6) AS score FROM w""")
def composite_similarity(spark, d):
    n = t(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    n = n.withColumn("b", F.concat("a", F.lit(", "), F.upper(F.split_part("a", F.lit(" "), F.lit(1)))))
    return n.withColumn("score", _six(text.composite(F.col("a"), F.col("b"))))


# ---- linking -----------------------------------------------------------------------------------

_LINKED = f"""WITH x AS (SELECT p_partkey AS id, p_name AS description, {_norm('p_name')} AS text FROM part),
l AS (SELECT min(p_partkey) AS concept_id, {_norm("p_name || ' ' || p_type")} AS name FROM part GROUP BY p_name, p_type),
i AS (SELECT DISTINCT concept_id, unnest({_tokens('name')}) AS token FROM l),
k AS (SELECT * FROM i WHERE token IN (SELECT token FROM i GROUP BY token HAVING count(*) <= 2000)),
w AS (SELECT DISTINCT text, unnest({_tokens('text')}) AS token FROM x),
c AS (SELECT DISTINCT text, concept_id FROM w JOIN k USING (token)),
s AS (SELECT text, concept_id, max({_ratio('text', 'name')}) AS sim FROM c JOIN l USING (concept_id) GROUP BY ALL),
b AS (SELECT text, concept_id, sim FROM s QUALIFY row_number() OVER (PARTITION BY text ORDER BY sim DESC, concept_id) = 1),
m AS (SELECT id, description, CASE WHEN sim >= 0.7 THEN concept_id END AS matched, coalesce(sim, 0.0)::DOUBLE AS similarity FROM x LEFT JOIN b USING (text))"""


def _linked(spark, d):
    p = t(spark, d, "part")
    concepts = p.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("concept_id")).select("concept_id", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return linking.best_matches(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description")), concepts)


@query(_LINKED + " SELECT id, description, matched, round(similarity, 6) AS similarity FROM m")
def entity_link_best(spark, d):
    return _linked(spark, d).withColumn("similarity", _six("similarity"))


@query(_LINKED + """ SELECT matched, count(*)::BIGINT AS cluster_size, string_agg(id::VARCHAR, ';' ORDER BY id) AS record_ids, min(id) AS first_seen FROM m
WHERE matched IS NOT NULL GROUP BY matched""")
def entity_link_clusters(spark, d):
    out = linking.clusters(_linked(spark, d))
    return out.select("matched", "cluster_size", F.array_join(F.transform("record_ids", lambda x: x.cast("string")), ";").alias("record_ids"), "first_seen")


@query(f"""WITH k AS (SELECT DISTINCT p_brand, p_type, p_name FROM part), n AS (SELECT p_brand, min(p_name) AS name FROM part GROUP BY p_brand),
r AS (SELECT DISTINCT k.p_brand, k.p_type, n.name AS icd_text FROM k JOIN n USING (p_brand)), l AS (SELECT DISTINCT p_type, p_name AS label FROM part),
u AS (SELECT DISTINCT icd_text, label, {_norm('icd_text')} AS na, {_norm('label')} AS nb FROM r JOIN l USING (p_type)),
v AS (SELECT *, {_tokens('na')} AS ta, {_tokens('nb')} AS tb FROM u), w AS (SELECT icd_text, label, 0.5 * {_jaccard('ta', 'tb')} + 0.5 * {_ratio('na', 'nb')} AS score FROM v),
b AS (SELECT p_brand, p_type, icd_text, label, score FROM r JOIN l USING (p_type) JOIN w USING (icd_text, label) QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, label) = 1)
SELECT p_brand, p_type, icd_text, label AS best_label, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'OK' ELSE 'Suspicious' END AS verdict FROM b""")
def link_validation(spark, d):
    p = t(spark, d, "part")
    types = p.select("p_type").distinct().withColumn("n", F.pmod(F.xxhash64("p_type"), F.lit(2**40)))
    links = p.select("p_brand", "p_type").distinct().join(types, "p_type").select(F.concat(F.lit("ICD9#"), "p_brand").alias("icd_raw"), F.concat(F.lit("http://snomed.info/id/"), "n").alias("snomed_uri"), "p_type")
    codes = p.groupBy("p_brand").agg(F.min("p_name").alias("long_title")).select(F.col("p_brand").alias("icd9_code"), F.lit("").alias("short_title"), "long_title")
    labels = p.select("p_type", F.col("p_name").alias("label")).distinct().join(types, "p_type").select(F.col("n").cast("string").alias("concept_id"), "label")
    out = linkcheck.validated(links.select("icd_raw", "snomed_uri"), codes, labels).join(links, ["icd_raw", "snomed_uri"])
    return out.select(F.col("icd_code").alias("p_brand"), "p_type", "icd_text", "best_label", _six("score").alias("score"), "verdict")


@query("SELECT 'icd9#' || n_nationkey AS icd_raw, 'http://snomed.info/id/' || n_regionkey AS snomed_uri FROM nation WHERE n_name <> ''")
def xml_links(spark, d):
    one = F.format_string('<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="urn:x"><r:Description><x:hasCode> icd9#%d </x:hasCode><x:Linked r:resource="http://snomed.info/id/%d"/></r:Description>'
                          '<g><r:Description><x:hasCode></x:hasCode><x:Linked r:resource="http://snomed.info/id/1"/></r:Description></g></r:RDF>', "n_nationkey", "n_regionkey")
    return rdf.link_results(t(spark, d, "nation").select(one.alias("value")))


# ---- vectors and alignment ---------------------------------------------------------------------

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_CENTERS = "c AS (SELECT label, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) r(i) WHERE vec_id % 10 <> 0 GROUP BY label, i) GROUP BY label)"
_PLACED = "p AS (SELECT vec_id, e, label AS cluster_id FROM (SELECT v.vec_id, v.e, c.label, list_cosine_similarity(v.e, c.center) AS k FROM v, c WHERE v.vec_id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(k, 12) DESC, cluster_id) = 1)"
_FINE = "f AS (SELECT p.vec_id AS subject, w.vec_id AS candidate, list_cosine_similarity(p.e, w.e) AS similarity FROM p JOIN v w ON w.label = p.cluster_id AND w.vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY round(similarity, 12) DESC, candidate) = 1)"


def _vectors(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), "embedding", F.col("label").alias("cluster_id"))
    asked, given = v.filter("subject % 10 = 0").select("subject", "embedding"), v.filter("subject % 10 <> 0")
    return asked, given.select("cluster_id", "subject"), given.select("subject", "embedding")


@query(f"WITH {_V}, m AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY label, i) SELECT label, (i - 1)::INT AS pos, round(x, 6) AS x FROM m")
def mean_embedding(spark, d):
    m = mean_by(t(spark, d, "embeddings"), ["label"], "embedding", "m")
    return m.select("label", F.posexplode("m").alias("pos", "x")).withColumn("x", _six("x"))


@query(f"WITH {_V}, {_CENTERS} SELECT label AS cluster_id, round(list_sum(center), 6) AS total, round(list_dot_product(center, center), 6) AS square FROM c")
def centroids(spark, d):
    _, clusters, vectors = _vectors(spark, d)
    c = align.checked_centroids(clusters, vectors)
    add = lambda f: _six(F.aggregate("centroid", F.lit(0.0), f))
    return c.select("cluster_id", add(lambda s, x: s + x).alias("total"), add(lambda s, x: s + x * x).alias("square"))


@query(f"WITH {_V}, {_CENTERS}, {_PLACED} SELECT vec_id AS subject, cluster_id FROM p")
def align_coarse(spark, d):
    asked, clusters, vectors = _vectors(spark, d)
    return align.coarse(asked, align.centroids(clusters, vectors)).select("subject", "cluster_id")


@query(f"WITH {_V}, {_CENTERS}, {_PLACED}, {_FINE} SELECT subject, candidate, round(similarity, 6) AS similarity FROM f WHERE similarity > 0")
def align_fine(spark, d):
    asked, clusters, vectors = _vectors(spark, d)
    return align.fine(align.coarse(asked, align.centroids(clusters, vectors)), clusters, vectors).withColumn("similarity", _six("similarity"))


@query(f"WITH {_V}, {_CENTERS}, {_PLACED}, {_FINE} SELECT subject AS s, '{iri.ALIGN_NAMESPACE}' AS p, candidate AS o FROM f WHERE similarity >= 0.4")
def align_threshold(spark, d):
    return align.aligned(*_vectors(spark, d), threshold=0.4)


@query(f"WITH {_V} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine_pairs(spark, d):
    return pairs.within(t(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding"), "label")


@query(f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(e, lambda x: round(x, 3))), 6) AS total FROM v")
def vector_text(spark, d):
    """SC-14: vectors written as text and read back."""
    v = t(spark, d, "embeddings")
    as_text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("string")), " "), F.lit("]"))
    return v.select("vec_id", parsed(as_text).alias("e")).select("vec_id", _six(F.aggregate("e", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query()
def kmeans_clusters(spark, d):
    return encoders.kmeans(t(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), "embedding"), 5)


@query()
def label_embeddings(spark, d):
    n = t(spark, d, "nation")
    return encoders.label_embeddings(n.select(iri.local("nation", F.col("n_nationkey")).alias("s"), F.lit(iri.RDFS_LABEL).alias("p"), F.col("n_name").alias("o"), F.lit("literal").alias("o_kind")))


@query()
def graph_embeddings(spark, d):
    """GR-01..03 over conversation turns as chained blank nodes."""
    return encoders.graph_embeddings(_turns(spark, d))


@query("SELECT s_suppkey AS id, round(-sqrt(pow(s_acctbal + n_regionkey - n_nationkey, 2)), 6) AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def translation_scores(spark, d):
    """GR-15: -||h + r - t|| over given vectors of one dimension."""
    one = lambda c: F.array(F.col(c).cast("double"))
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    both = s.join(n, s.s_nationkey == n.n_nationkey)
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    found = both.select(name("s", "s_suppkey").alias("s"), name("r", "n_regionkey").alias("p"), name("n", "n_nationkey").alias("o"))
    entities = s.select(name("s", "s_suppkey").alias("id"), one("s_acctbal").alias("embedding")).unionByName(n.select(name("n", "n_nationkey").alias("id"), one("n_nationkey").alias("embedding")))
    relations = n.select(name("r", "n_regionkey").alias("id"), one("n_regionkey").alias("embedding")).distinct()
    return align.translation_scores(found, entities, relations).select(F.expr("substr(s, 2)").cast("long").alias("id"), _six("score").alias("score"))


_GRAPHS = """q AS (SELECT 'c' || c_custkey AS s, 'nation' AS p, 'n' || c_nationkey AS o FROM customer UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer),
a AS (SELECT 'c' || c_custkey AS s, 'nation' AS p, 'r' || n_regionkey AS o FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'x', 'nation', 'y')"""


def _graphs(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    s = F.concat(F.lit("c"), "c_custkey").alias("s")
    q = c.select(s, F.explode(F.array(F.struct(F.lit("nation").alias("p"), F.concat(F.lit("n"), "c_nationkey").alias("o")), F.struct(F.lit("segment").alias("p"), F.col("c_mktsegment").alias("o")))).alias("t")).select("s", "t.*")
    a = c.filter("c_mktsegment <> 'BUILDING'").join(n, c.c_nationkey == n.n_nationkey).select(s, F.lit("nation").alias("p"), F.concat(F.lit("r"), "n_regionkey").alias("o"))
    return q, a.unionByName(spark.createDataFrame([("x", "nation", "y")], "s string, p string, o string"))


@query(f"WITH {_GRAPHS} SELECT * FROM q WHERE s NOT IN (SELECT s FROM a) UNION SELECT * FROM a WHERE s IN (SELECT s FROM q)")
def transcribe(spark, d):
    return triples.transcribe(*_graphs(spark, d))


@query(f"WITH {_GRAPHS} SELECT * FROM q UNION SELECT * FROM a WHERE s IN (SELECT s FROM q)")
def merge(spark, d):
    return triples.merge(*_graphs(spark, d))


@query(f"WITH {_GRAPHS} SELECT * FROM q UNION SELECT * FROM a")
def graph_union(spark, d):
    return triples.union(*_graphs(spark, d))


# ---- facts -------------------------------------------------------------------------------------

_KG = f"""g AS (
  SELECT 'c' || c_custkey AS s, '{iri.RDF_TYPE}' AS p, 'Customer' AS o FROM customer UNION SELECT 'n' || n_nationkey, '{iri.RDF_TYPE}', 'Nation' FROM nation
  UNION SELECT 'r' || r_regionkey, '{iri.RDF_TYPE}', 'Region' FROM region UNION SELECT 'o' || o_orderkey, '{iri.RDF_TYPE}', 'Order' FROM orders
  UNION SELECT 'o' || o_orderkey, 'orderedBy', 'c' || o_custkey FROM orders UNION SELECT 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'inRegion', 'r' || n_regionkey FROM nation
  UNION SELECT 'c' || c_custkey, 'customerRegion', 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'
  UNION SELECT * FROM (VALUES ('orderedBy', '{iri.RDFS_DOMAIN}', 'Order'), ('orderedBy', '{iri.RDFS_RANGE}', 'Customer'), ('inNation', '{iri.RDFS_DOMAIN}', 'Customer'), ('inNation', '{iri.RDFS_RANGE}', 'Nation'),
    ('inRegion', '{iri.RDFS_DOMAIN}', 'Nation'), ('inRegion', '{iri.RDFS_RANGE}', 'Region'), ('customerRegion', '{iri.RDFS_DOMAIN}', 'Customer'), ('customerRegion', '{iri.RDFS_RANGE}', 'Region'), ('loose', '{iri.RDFS_DOMAIN}', 'Order'))),
dr AS (SELECT s AS p, min(CASE WHEN p = '{iri.RDFS_DOMAIN}' THEN o END) AS dom, min(CASE WHEN p = '{iri.RDFS_RANGE}' THEN o END) AS rng FROM g WHERE p IN ('{iri.RDFS_DOMAIN}', '{iri.RDFS_RANGE}') GROUP BY s),
ty AS (SELECT s AS node, o AS class FROM g WHERE p = '{iri.RDF_TYPE}'), ic AS (SELECT class, count(*)::BIGINT AS n FROM ty GROUP BY class),
tc AS (SELECT dr.p, count(e.s)::BIGINT AS n FROM dr LEFT JOIN (SELECT g.* FROM g JOIN dr USING (p) JOIN ty a ON a.node = g.s AND a.class = dom JOIN ty b ON b.node = g.o AND b.class = rng) e ON e.p = dr.p GROUP BY dr.p)"""

_EDGES = f"e AS (SELECT DISTINCT s, p, o FROM g WHERE p NOT IN ('{iri.RDF_TYPE}'))"
# order -> region pairs over three hops and customer -> region pairs over up to three
_FACTS = "fx AS (SELECT 'c' || c_custkey AS s, 'customerRegion' AS p, 'r' || (c_custkey % 5) AS o FROM customer UNION ALL SELECT 'o' || o_orderkey, 'orderedBy', 'c' || o_custkey FROM orders)"
_PATHS = """pa AS (SELECT DISTINCT fx.s, fx.o, [a.p] AS path FROM fx JOIN g a ON a.s = fx.s AND a.o = fx.o
  UNION SELECT DISTINCT fx.s, fx.o, [a.p, b.p] FROM fx JOIN g a ON a.s = fx.s JOIN g b ON b.s = a.o AND b.o = fx.o
  UNION SELECT DISTINCT fx.s, fx.o, [a.p, b.p, c.p] FROM fx JOIN g a ON a.s = fx.s JOIN g b ON b.s = a.o JOIN g c ON c.s = b.o AND c.o = fx.o)"""
_WALKS = """wp AS (SELECT DISTINCT pa.path, fx.p, dom, rng FROM fx JOIN pa ON pa.s = fx.s AND pa.o = fx.o JOIN dr ON dr.p = fx.p WHERE dom IS NOT NULL AND rng IS NOT NULL),
wk AS (SELECT wp.path, wp.p, dom, rng, a.s AS s, a.o AS o FROM wp JOIN g a ON a.p = path[1] WHERE len(path) = 1
  UNION ALL SELECT wp.path, wp.p, dom, rng, a.s, b.o FROM wp JOIN g a ON a.p = path[1] JOIN g b ON b.p = path[2] AND b.s = a.o WHERE len(path) = 2
  UNION ALL SELECT wp.path, wp.p, dom, rng, a.s, c.o FROM wp JOIN g a ON a.p = path[1] JOIN g b ON b.p = path[2] AND b.s = a.o JOIN g c ON c.p = path[3] AND c.s = b.o WHERE len(path) = 3),
wc AS (SELECT wk.path, wk.p, dom, rng, count(*)::BIGINT AS c_path, count(h.s)::BIGINT AS c_both FROM wk JOIN ty x ON x.node = wk.s AND x.class = dom JOIN ty y ON y.node = wk.o AND y.class = rng
  LEFT JOIN g h ON h.s = wk.s AND h.p = wk.p AND h.o = wk.o GROUP BY ALL),
wf AS (SELECT wp.path, wp.p, wp.dom, wp.rng, coalesce(c_path, 0) AS c_path, coalesce(c_both, 0) AS c_both FROM wp LEFT JOIN wc ON wc.path = wp.path AND wc.p = wp.p)"""
_SCORES = """sc AS (SELECT fx.s, fx.p, fx.o, 1.0 - product(1.0 - v) AS score FROM fx JOIN pa ON pa.s = fx.s AND pa.o = fx.o JOIN (
    SELECT wf.path, wf.p, CASE WHEN c_both = 0 OR c_path = 0 OR tc.n = 0 OR c_both = a.n * b.n THEN 0.0
      ELSE greatest(0.0, ln((c_both / (a.n * b.n)) / ((c_path / (a.n * b.n)) * (tc.n / (a.n * b.n)))) / -ln(c_both / (a.n * b.n))) END AS v
    FROM wf JOIN tc ON tc.p = wf.p JOIN ic a ON a.class = wf.dom JOIN ic b ON b.class = wf.rng WHERE c_both > 0 AND tc.n > 0) w ON w.path = pa.path AND w.p = fx.p GROUP BY fx.s, fx.p, fx.o)"""


def _kg(spark, d):
    c, n, r, o = (t(spark, d, x) for x in ("customer", "nation", "region", "orders"))
    at = lambda prefix, col: F.concat(F.lit(prefix), F.col(col))
    row = lambda df, s, p, x: df.select(s.alias("s"), F.lit(p).alias("p"), x.alias("o"))
    parts = [row(df, at(k, key), iri.RDF_TYPE, F.lit(name)) for df, k, key, name in ((c, "c", "c_custkey", "Customer"), (n, "n", "n_nationkey", "Nation"), (r, "r", "r_regionkey", "Region"), (o, "o", "o_orderkey", "Order"))]
    parts += [row(o, at("o", "o_orderkey"), "orderedBy", at("c", "o_custkey")), row(c, at("c", "c_custkey"), "inNation", at("n", "c_nationkey")), row(n, at("n", "n_nationkey"), "inRegion", at("r", "n_regionkey"))]
    parts.append(row(c.filter("c_mktsegment = 'BUILDING'").join(n, c.c_nationkey == n.n_nationkey), at("c", "c_custkey"), "customerRegion", at("r", "n_regionkey")))
    schema = [("orderedBy", "Order", "Customer"), ("inNation", "Customer", "Nation"), ("inRegion", "Nation", "Region"), ("customerRegion", "Customer", "Region")]
    rows = [(p, which, x) for p, a, b in schema for which, x in ((iri.RDFS_DOMAIN, a), (iri.RDFS_RANGE, b))] + [("loose", iri.RDFS_DOMAIN, "Order")]
    # a graph that several joins read is kept once; a stored graph would be a table
    return triples.union(*parts, spark.createDataFrame(rows, "s string, p string, o string")).persist()


def _facts(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    a = c.select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.lit("customerRegion").alias("p"), F.concat(F.lit("r"), F.col("c_custkey") % 5).alias("o"))
    return a.unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("s"), F.lit("orderedBy").alias("p"), F.concat(F.lit("c"), "o_custkey").alias("o")))


@query(f"WITH {_KG} SELECT class, n FROM ic")
def instance_count(spark, d):
    return facts.instance_counts(_kg(spark, d))


@query(f"WITH {_KG} SELECT p, dom AS domain, rng AS range FROM dr")
def domain_range(spark, d):
    return facts.domain_range(_kg(spark, d))


@query(f"WITH {_KG} SELECT p, n FROM tc")
def typed_predicate_count(spark, d):
    g = _kg(spark, d)
    return facts.typed_predicate_counts(g, facts.domain_range(g))


@query(f"WITH {_KG}, {_FACTS}, {_PATHS} SELECT s, o, array_to_string(path, '>') AS path FROM pa")
def discover_paths(spark, d):
    return facts.discover_paths(_kg(spark, d), _facts(spark, d)).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {_KG}, {_FACTS}, {_PATHS}, {_WALKS} SELECT array_to_string(path, '>') AS path, p, c_path, c_both FROM wf")
def path_counts(spark, d):
    g, f = _kg(spark, d), _facts(spark, d)
    asked = cut(f.join(facts.domain_range(g).filter("domain is not null and range is not null"), "p").join(facts.discover_paths(g, f), ["s", "o"]))
    return facts.walk_counts(g, asked).select(F.array_join("path", ">").alias("path"), "p", "c_path", "c_both")


@query("""SELECT l_linenumber, l_returnflag, count(*)::BIGINT AS n, round(1.0 - product(1.0 - v), 6) AS score FROM (SELECT l_linenumber, l_returnflag,
  CASE WHEN l_linenumber = 1 THEN 0.0 ELSE greatest(0.0, ln((1.0 / 64) / ((l_linenumber / 64.0) * (2.0 / 64))) / -ln(1.0 / 64)) END AS v
  FROM (SELECT DISTINCT l_linenumber, l_returnflag, l_linestatus FROM lineitem)) GROUP BY ALL""")
def npmi_veracity(spark, d):
    from ..functions.scores import veracity

    rows = t(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus").distinct()
    v = F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(npmi(F.col("l_linenumber"), F.lit(1), F.lit(2), F.lit(8), F.lit(8)))
    return rows.withColumn("v", v).groupBy("l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), _six(veracity(F.col("v"))).alias("score"))


@query(f"WITH {_KG}, {_FACTS}, {_PATHS}, {_WALKS}, {_SCORES} SELECT fx.s, fx.p, fx.o, round(coalesce(score, 0.0), 6) AS score FROM fx LEFT JOIN sc ON sc.s = fx.s AND sc.p = fx.p AND sc.o = fx.o")
def fact_scores(spark, d):
    return facts.scored(_kg(spark, d), _facts(spark, d)).select("s", "p", "o", _six("score").alias("score"))


@query(f"WITH {_KG}, {_FACTS}, {_PATHS}, {_WALKS}, {_SCORES} SELECT '<' || s || '> <' || p || '> <' || o || '>' AS line FROM sc WHERE score >= 0.5")
def fact_filter(spark, d):
    """Facts as text lines with malformed ones among them, read, scored, filtered and rendered."""
    term = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    f = _facts(spark, d)
    text_lines = f.select(F.concat_ws("  ", term("s"), term("p"), term("o")).alias("value")).unionByName(f.select(F.concat_ws(" ", term("s"), term("p")).alias("value")))
    kept = facts.accepted(facts.scored(_kg(spark, d), lines.facts(text_lines).drop("value")))
    return kept.select(F.concat_ws(" ", term("s"), term("p"), term("o")).alias("line"))


# ---- graphs ------------------------------------------------------------------------------------


def _turns(spark, d):
    c = t(spark, d, "conversations")
    node = lambda turn: F.concat(F.lit("b"), "conv_id", F.lit("_"), turn)
    step = c.select(node(F.col("turn")).alias("s"), F.lit("bnode").alias("s_kind"), F.lit("next").alias("p"), node(F.col("turn") + 1).alias("o"), F.lit("bnode").alias("o_kind"))
    role = c.select(node(F.col("turn")).alias("s"), F.lit("bnode").alias("s_kind"), F.lit("role").alias("p"), F.col("role").alias("o"), F.lit("literal").alias("o_kind"))
    first = c.select("conv_id").distinct().withColumn("turn", F.lit(0))
    root = first.select(F.concat(F.lit("conv"), "conv_id").alias("s"), F.lit("uri").alias("s_kind"), F.lit("starts").alias("p"), node(F.col("turn")).alias("o"), F.lit("bnode").alias("o_kind"))
    return step.unionByName(role).unionByName(root)


@query("""WITH RECURSIVE r(conv_id, turn) AS (SELECT DISTINCT conv_id, 0::BIGINT FROM conversations UNION SELECT r.conv_id, c.turn + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT 'conv' || conv_id AS root, 'b' || conv_id || '_0' AS child, 'b' || conv_id || '_' || turn AS node FROM r""")
def bnode_closure(spark, d):
    return triples.bnode_closure(_turns(spark, d))


@query("SELECT c_custkey, 'C' || c_custkey AS concept, NULLIF(regexp_extract('icd9#' || c_custkey, '^(?:icd9#|icd10#)(.*)', 1), '') AS icd, c_custkey::VARCHAR AS trailing, c_name AS bare FROM customer")
def code_extraction(spark, d):
    c = t(spark, d, "customer")
    concept = iri.concept_id(F.concat(F.lit("http://snomed.info/id/"), "c_custkey"))
    return c.select("c_custkey", F.concat(F.lit("C"), concept).alias("concept"), iri.icd_code(F.concat(F.lit("ICD9#"), "c_custkey")).alias("icd"),
                    iri.trailing_number(F.concat(F.lit("http://x/LabTest/"), "c_custkey")).alias("trailing"), iri.bare(F.concat(F.lit("<"), "c_name", F.lit(">"))).alias("bare"))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer))::BIGINT AS n_triples, (SELECT count(DISTINCT c_nationkey) FROM customer)::BIGINT AS n_subjects""")
def counters(spark, d):
    c = t(spark, d, "customer")
    return triples.counts(c.select(F.col("c_nationkey").cast("string").alias("s"), F.lit("of").alias("p"), F.col("c_custkey").cast("string").alias("o")))


@query("SELECT 's' || n_nationkey AS s, 'uri' AS s_kind, 'http://x/name' AS p, n_name || ' \"q\"' AS o, 'literal' AS o_kind FROM nation")
def ntriples_source(spark, d):
    line = F.concat(F.lit("<s"), "n_nationkey", F.lit('> <http://x/name> "'), "n_name", F.lit(' \\"q\\"" .'))
    return rdf.ntriples(t(spark, d, "nation").select(line.alias("value"))).select("s", "s_kind", "p", "o", "o_kind")


# ---- sources and sinks: written to the shared folder and read back -----------------------------


def _path(spark, name: str) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}-{name}"


_NAMED = """SELECT 'http://x/c' || c_custkey AS s, 'http://x/name' AS p, c_name || ' "\\n" ' || chr(10) || c_mktsegment AS o FROM customer
UNION ALL SELECT 'http://x/c' || c_custkey, 'http://x/nation', 'http://x/n' || c_nationkey FROM customer"""


def _named(spark, d):
    c = t(spark, d, "customer")
    one = lambda p, o, kind: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    name = F.concat("c_name", F.lit(' "\\n" \n'), "c_mktsegment")
    both = F.array(one("http://x/name", name, "literal"), one("http://x/nation", F.concat(F.lit("http://x/n"), "c_nationkey"), "uri"))
    return c.select(F.concat(F.lit("http://x/c"), "c_custkey").alias("s"), F.lit("uri").alias("s_kind"), F.explode(both).alias("x")).select("s", "s_kind", "x.*")


@query(f"SELECT s, 'uri' AS s_kind, p, o, CASE WHEN p = 'http://x/name' THEN 'literal' ELSE 'uri' END AS o_kind FROM ({_NAMED})")
def sink_ntriples(spark, d):
    path = _path(spark, "graph.nt")
    sinks.ntriples(_named(spark, d), path)
    return rdf.read(spark, path).select("s", "s_kind", "p", "o", "o_kind")


_ONE_LINE = "regexp_replace(o, '[\r\n]+', ' ', 'g')"


@query(f"SELECT s || ' ' || p || ' ' || {_ONE_LINE} AS line FROM ({_NAMED})")
def sink_spaced(spark, d):
    path = _path(spark, "spaced")
    sinks.spaced(_named(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"SELECT s || chr(9) || p || chr(9) || {_ONE_LINE} AS line FROM ({_NAMED})")
def sink_tabbed(spark, d):
    path = _path(spark, "tabbed")
    sinks.tabbed(_named(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(_LINKED + """ SELECT id::VARCHAR AS id, description, coalesce(matched::VARCHAR, 'No match') AS matched_snomed, printf('%.2f', similarity) AS similarity_score FROM m""")
def sink_matches(spark, d):
    path = _path(spark, "matches")
    sinks.matches(_linked(spark, d), path)
    return tables.csv(spark, path, "matches")


@query(_LINKED + """ SELECT matched::VARCHAR AS snomed_code, count(*)::VARCHAR AS cluster_size, string_agg(id::VARCHAR, ';' ORDER BY id) AS record_ids,
  string_agg(description, ';' ORDER BY id) AS descriptions, string_agg(printf('%.2f', similarity), ';' ORDER BY id) AS similarities FROM m WHERE matched IS NOT NULL GROUP BY matched""")
def sink_clusters(spark, d):
    path = _path(spark, "clusters")
    sinks.clusters(linking.clusters(_linked(spark, d)), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("""SELECT 'icd9#' || n_nationkey AS icd_raw, 'http://snomed.info/id/' || n_regionkey AS snomed_uri, n_nationkey::VARCHAR AS icd_code, n_regionkey::VARCHAR AS concept_id,
  n_name AS icd_text, n_name AS best_label, '1.000' AS score, 'OK' AS verdict FROM nation""")
def sink_verdicts(spark, d):
    n = t(spark, d, "nation")
    links = n.select(F.concat(F.lit("icd9#"), "n_nationkey").alias("icd_raw"), F.concat(F.lit("http://snomed.info/id/"), "n_regionkey").alias("snomed_uri"))
    codes = n.select(F.col("n_nationkey").cast("string").alias("icd9_code"), F.lit("").alias("short_title"), F.col("n_name").alias("long_title"))
    labels = n.select(F.col("n_regionkey").cast("string").alias("concept_id"), F.col("n_name").alias("label"))
    path = _path(spark, "verdicts")
    sinks.verdicts(linkcheck.validated(links, codes, labels), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT '<o' || o_orderkey || '> <by> <c' || o_custkey || '>' AS line FROM orders")
def sink_facts(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("o"), "o_orderkey").alias("s"), F.lit("by").alias("p"), F.concat(F.lit("c"), "o_custkey").alias("o"))
    path = _path(spark, "facts")
    sinks.facts(o, path)
    return lines.facts(spark.read.text(path)).select(F.concat_ws(" ", *[F.concat(F.lit("<"), c, F.lit(">")) for c in "spo"]).alias("line"))


def _csv_of(spark, df, name):
    path = _path(spark, name)
    df.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return path


@query("SELECT c_custkey AS row_id, c_nationkey AS itemid, c_name AS label, NULL::VARCHAR AS fluid, c_mktsegment AS category, '0' || c_custkey AS loinc_code FROM customer")
def csv_source(spark, d):
    """SRC-01: a header in another case, a column that is missing, a code with a leading zero."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("ROW_ID"), F.col("c_nationkey").alias("ItemId"), F.col("c_name").alias("LABEL"), F.col("c_mktsegment").alias("Category"), F.concat(F.lit("0"), "c_custkey").alias("LOINC_CODE"))
    return tables.csv(spark, _csv_of(spark, c, "items"), "lab_items")


@query("SELECT trim(c_mktsegment) AS icd9_code, max_by(c_name, c_custkey) AS long_title FROM customer GROUP BY 1")
def icd_source(spark, d):
    """SRC-03: the last row of a code wins."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.concat(F.lit(" "), "c_mktsegment").alias("icd9_code"), F.lit("x").alias("short_title"), F.col("c_name").alias("long_title"))
    return tables.icd_descriptions(tables.csv(spark, _csv_of(spark, c, "titles"), "icd_titles")).select("icd9_code", "long_title")


@query("SELECT c_custkey::VARCHAR AS id, c_name || ', \"' || c_mktsegment || '\"' AS description FROM customer")
def description_source(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit(', "'), "c_mktsegment", F.lit('" ')).alias("description"))
    return tables.descriptions(spark, _csv_of(spark, c, "descriptions"))


@query("SELECT n_nationkey::VARCHAR AS concept_id, n_name AS label FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'also ' || n_name FROM nation")
def turtle_source(spark, d):
    """SRC-05, SRC-06: labels of concepts from a Turtle file with prefixes and lists of objects."""
    one = F.format_string('@prefix k: <http://www.w3.org/2004/02/skos/core#> . <http://snomed.info/id/%d> k:prefLabel "%s"@en ; k:altLabel "also %s", 5 ; a k:Concept .', "n_nationkey", "n_name", "n_name")
    path = _path(spark, "concepts.ttl")
    t(spark, d, "nation").select(one.alias("value")).write.text(path)
    rows = rdf.labels(rdf.read(spark, path))
    return rows.filter("label <> '5'")


@query("SELECT n_nationkey::VARCHAR AS subject, (n_regionkey + 0.5)::DOUBLE AS x FROM nation")
def embedding_source(spark, d):
    """FLT-07: vectors stored as literals; IRIs and texts that are no vector are skipped."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("s"), F.lit("e").alias("p"), F.concat(F.lit("[0.25 "), F.col("n_regionkey") + 0.25, F.lit("]")).alias("o"))
    g = n.withColumn("o_kind", F.lit("literal")).unionByName(n.withColumn("o_kind", F.lit("uri"))).unionByName(n.withColumn("o", F.lit("[a b]")).withColumn("o_kind", F.lit("literal")))
    return rdf.embeddings(g).select("subject", (F.col("embedding")[0] + F.col("embedding")[1]).alias("x"))


@query("SELECT (SELECT count(*) FROM orders)::BIGINT AS n, 0::BIGINT AS none")
def count_reader(spark, d):
    """SRC-09: the answer of a count query over the stored graph, and of one without rows."""
    o = t(spark, d, "orders")
    n = triples.count_of(o.agg(F.lit(None).cast("long").alias("count"), F.count(F.lit(1)).alias("sum")))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(triples.count_of(o.limit(0).select(F.lit(1).alias("b1")))).cast("long").alias("none"))


def _invoked(spark, d, name, objects, module, columns):
    """The subjects that an invoker embeds, with the size of their vectors."""
    n = t(spark, d, "nation")
    q = n.select(F.concat(F.lit("s"), "n_nationkey").alias("s"), F.lit(iri.ALIGN_NAMESPACE).alias("p"), objects.alias("o"), F.when(F.col("n_nationkey") == 3, "literal").otherwise("uri").alias("o_kind"))
    rows = n.filter("n_regionkey <> 1").select(F.col("n_nationkey").alias(columns[0]), F.col("n_name").alias(columns[1]))
    modules = tables.Modules(spark, {module: _csv_of(spark, rows, module)}) if module else None
    return align.invokers.invoke(name, q, iri.ALIGN_NAMESPACE, None, modules).select("subject", (F.size("embedding") > 0).alias("embedded"))


_INVOKED = "SELECT 's' || n_nationkey AS subject, true AS embedded FROM nation WHERE n_nationkey <> 3"


@query(_INVOKED + " AND n_regionkey <> 1")
def invoker_icd9(spark, d):
    return _invoked(spark, d, "icd9tosnomed", F.concat(F.lit("http://example.org/Code/icd9#"), "n_nationkey"), "icd9", ("ICD9_CODE", "LONG_TITLE"))


@query(_INVOKED + " AND n_regionkey <> 1")
def invoker_lab(spark, d):
    return _invoked(spark, d, "labresults2snomed", F.concat(F.lit("http://example.org/LabTest/1/PATIENTS/"), "n_nationkey"), "labresults", ("ITEMID", "LABEL"))


@query(_INVOKED)
def invoker_concepts(spark, d):
    return _invoked(spark, d, "snomedtoicd9", F.concat(F.lit("http://snomed.info/id/"), "n_nationkey"), None, ("a", "b"))


@query(f"SELECT s, p, o FROM ({SQL['triple_fanout_orders']}) UNION SELECT s, p, o FROM ({SQL['triple_fanout_lineitem']})")
def schema_mapping_files(spark, d):
    """SNK-01, PRJ-02, PRJ-03 from CSV files to a Turtle file, with all subjects sampled."""
    o, line, part = (t(spark, d, name) for name in ("orders", "lineitem", "part"))
    diagnoses = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("icd9_code"))
    labs = line.select(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("itemid"), F.col("l_linenumber").alias("value"))
    items = part.select(F.col("p_partkey").alias("itemid"), F.col("p_partkey").alias("row_id"), F.when(F.col("p_size") <= 20, F.col("p_size")).alias("loinc_code"))
    patients = diagnoses.select("subject_id").union(labs.select("subject_id")).distinct()
    out = _path(spark, "mapped.ttl")
    files = [_csv_of(spark, df, name) for df, name in ((patients, "patients"), (diagnoses, "diagnoses"), (labs, "labs"), (items, "items"))]
    pipelines.schema_mapping_files(spark, *files, out, fraction=1.0, compression="gzip")
    return rdf.ntriples(spark.read.text(out)).select("s", "p", "o")


@query("SELECT CASE WHEN n_nationkey = 3 THEN 'http://x/s3' ELSE 'http://x/s' || n_nationkey END AS s, "
       f"'{iri.ALIGN_NAMESPACE}' AS p, CASE WHEN n_nationkey = 3 THEN n_name ELSE 'http://x/t' || n_nationkey END AS o, "
       "CASE WHEN n_nationkey = 3 THEN 'literal' ELSE 'uri' END AS o_kind FROM nation")
def alignment_files(spark, d):
    """GR-10, GR-11 from files to a Turtle file: each concept is its own nearest, a subject with a literal stays as it is."""
    n = t(spark, d, "nation")
    concept, of = F.concat(F.lit("http://snomed.info/id/"), "n_nationkey"), lambda c: F.concat(F.lit(f"http://x/{c}"), "n_nationkey")
    literal = F.col("n_nationkey") == 3
    asked = n.select(of("s").alias("s"), F.lit(iri.ALIGN_NAMESPACE).alias("p"), F.when(literal, F.col("n_name")).otherwise(concept).alias("o"),
                     F.when(literal, "literal").otherwise("uri").alias("o_kind"))
    vector = F.concat(F.lit("["), F.array_join(F.transform(encoders.encoded(concept), lambda x: x.cast("string")), " "), F.lit("]"))
    held = n.select(of("t").alias("s"), F.lit("http://x/vector").alias("p"), vector.alias("o"), F.lit("literal").alias("o_kind"))
    query_path, vectors_path, out = (_path(spark, name) for name in ("query.nt", "vectors.nt", "aligned.ttl"))
    sinks.ntriples(asked, query_path)
    sinks.ntriples(held, vectors_path)
    clusters = _csv_of(spark, n.select(F.lit("0").alias("cluster_id"), of("t").alias("subject")), "clusters")
    pipelines.alignment(spark, query_path, vectors_path, clusters, out, "snomedtoicd9")
    return rdf.ntriples(spark.read.text(out)).select("s", "p", "o", "o_kind")
