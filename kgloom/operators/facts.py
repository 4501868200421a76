"""Validation of predicted facts by typed predicate paths, all facts in one plan.

Walks are counted hop by hop: after each hop the weights of equal (path, start, end) are summed,
so no walk is ever materialised.  Type triples are semi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iri
from ..functions.scores import npmi, veracity
from .lineage import cut

MAX_LENGTH, THRESHOLD = 3, 0.5


def instances(triples: DataFrame) -> DataFrame:
    """(node, class) of all type triples."""
    return triples.filter(F.col("p") == iri.RDF_TYPE).select(F.col("s").alias("node"), F.col("o").alias("class")).distinct()


def instance_counts(triples: DataFrame) -> DataFrame:
    return instances(triples).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def domain_range(triples: DataFrame) -> DataFrame:
    """(p, domain, range): the smallest declared ones, null where none is."""
    rows = triples.filter(F.col("p").isin(iri.RDFS_DOMAIN, iri.RDFS_RANGE))
    pick = lambda which: F.min(F.when(F.col("p") == which, F.col("o")))
    return rows.groupBy(F.col("s").alias("predicate")).agg(pick(iri.RDFS_DOMAIN).alias("domain"), pick(iri.RDFS_RANGE).alias("range")).withColumnRenamed("predicate", "p")


def typed_pairs(triples: DataFrame, declared: DataFrame) -> DataFrame:
    """Triples (s, p, o) whose ends are instances of the predicate's domain and range."""
    kinds = instances(triples)
    edges = triples.select("s", "p", "o").join(declared.filter("domain is not null and range is not null"), "p")
    edges = edges.join(kinds.select(F.col("node").alias("s"), F.col("class").alias("domain")), ["s", "domain"], "left_semi")
    return edges.join(kinds.select(F.col("node").alias("o"), F.col("class").alias("range")), ["o", "range"], "left_semi").select("s", "p", "o")


def typed_predicate_counts(triples: DataFrame, declared: DataFrame) -> DataFrame:
    """(p, n) of the typed triples; predicates without domain or range count 0."""
    n = typed_pairs(triples, declared).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return declared.join(n, "p", "left").select("p", F.coalesce("n", F.lit(0)).alias("n"))


def discover_paths(triples: DataFrame, ends: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """ends (s, o) -> distinct (s, o, path): the chains of 1..max_length predicates from s to o.

    The last hop is an equi-join on both of its nodes, so the frontier never grows by it.
    """
    edges = triples.select(F.col("s").alias("a"), F.col("p").alias("via"), F.col("o").alias("b")).distinct()
    frontier = ends.select("s", "o").distinct().withColumn("v", F.col("s")).withColumn("path", F.array().cast("array<string>"))
    found = None
    for length in range(1, max_length + 1):
        last = frontier.join(edges, (F.col("v") == F.col("a")) & (F.col("o") == F.col("b")))
        last = last.select("s", "o", F.array_append("path", F.col("via")).alias("path"))
        found = last if found is None else found.unionByName(last)
        if length < max_length:
            frontier = frontier.join(edges, F.col("v") == F.col("a")).select("s", "o", F.col("b").alias("v"), F.array_append("path", F.col("via")).alias("path"))
            frontier = cut(frontier.distinct())
    return found.distinct()


def walk_counts(triples: DataFrame, paths: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """paths (path, p, domain, range) -> with c_path, the typed walks along the path, and c_both, those whose ends p joins."""
    kinds = instances(triples)
    edges = triples.select(F.col("s").alias("a"), F.col("p").alias("via"), F.col("o").alias("b")).distinct()
    keys = ["path", "p", "domain", "range"]
    wanted = paths.select(*keys).distinct()
    walks = wanted.withColumn("via", F.get("path", F.lit(0))).join(edges, "via")
    walks = walks.join(kinds.select(F.col("node").alias("a"), F.col("class").alias("domain")), ["a", "domain"], "left_semi")
    walks = cut(walks.groupBy(*keys, F.col("a").alias("s"), F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("w")))
    done = None
    for length in range(1, max_length + 1):
        full = walks.filter(F.size("path") == length)
        done = full if done is None else done.unionByName(full)
        if length < max_length:
            more = walks.filter(F.size("path") > length).withColumn("via", F.get("path", F.lit(length))).withColumnRenamed("v", "a")
            walks = cut(more.join(edges, ["via", "a"]).groupBy(*keys, "s", F.col("b").alias("v")).agg(F.sum("w").alias("w")))
    done = done.join(kinds.select(F.col("node").alias("v"), F.col("class").alias("range")), ["v", "range"], "left_semi")
    joined = edges.select(F.col("a").alias("s"), F.col("via").alias("p"), F.col("b").alias("v"), F.lit(1).alias("hit"))
    sums = done.join(joined, ["s", "p", "v"], "left").groupBy(*keys).agg(F.sum("w").alias("c_path"), F.sum(F.when(F.col("hit") == 1, F.col("w"))).alias("c_both"))
    out = wanted.join(sums, keys, "left")
    return out.fillna(0, ["c_path", "c_both"])


def scored(triples: DataFrame, facts: DataFrame, max_length: int = MAX_LENGTH, clamp: bool = False) -> DataFrame:
    """facts (s, p, o, ...) with `score`: 0 without domain, range, instances or typed triples, else the veracity of the paths that meet the predicate."""
    declared = domain_range(triples).filter("domain is not null and range is not null")
    used = declared.join(facts.select("p").distinct(), "p", "left_semi")
    n = instance_counts(triples)
    counts = used.join(typed_predicate_counts(triples, used).withColumnRenamed("n", "c_p"), "p")
    counts = counts.join(n.select(F.col("class").alias("domain"), F.col("n").alias("c_domain")), "domain").join(n.select(F.col("class").alias("range"), F.col("n").alias("c_range")), "range")
    asked = cut(facts.select("s", "p", "o").distinct().join(counts.filter("c_p > 0"), "p"))
    asked = cut(asked.join(discover_paths(triples, asked, max_length), ["s", "o"]))
    walks = walk_counts(triples, asked, max_length)
    value = npmi(F.col("c_path"), F.col("c_both"), F.col("c_p"), F.col("c_domain"), F.col("c_range"))
    rows = asked.join(walks, ["path", "p", "domain", "range"]).filter("c_both > 0").withColumn("npmi", value)
    per_fact = rows.groupBy("s", "p", "o").agg(veracity(F.col("npmi"), clamp).alias("score"))
    return facts.join(per_fact, ["s", "p", "o"], "left").fillna(0.0, ["score"])


def accepted(scored_facts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored_facts.filter(F.col("score") >= threshold)
