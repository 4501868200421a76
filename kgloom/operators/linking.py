"""Entity linking: descriptions to concepts by token blocking and string similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import indel_ratio, normalized, token_set
from .lineage import cut

THRESHOLD, MAX_BLOCK, NO_MATCH = 0.7, 2000, "No match"


def token_index(labels: DataFrame) -> DataFrame:
    """labels (concept_id, label) -> distinct (token, concept_id)."""
    return labels.select(F.explode(token_set(F.col("label"))).alias("token"), "concept_id").distinct()


def cleaned(index: DataFrame, max_size: int | None = MAX_BLOCK) -> DataFrame:
    """The index without tokens of more than max_size concepts; None keeps all."""
    if max_size is None:
        return index
    index = cut(index)  # made once: it is counted and filtered
    rare = index.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_size).select("token")
    return index.join(rare, "token", "left_semi")


def candidates(descriptions: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (text, concept_id) that share a token; equal descriptions are looked up once."""
    texts = descriptions.select(normalized(F.col("description")).alias("text")).distinct()
    words = texts.select("text", F.explode(token_set(F.col("text"))).alias("token"))
    return words.join(index, "token").select("text", "concept_id").distinct()


def best_matches(descriptions: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_size: int | None = MAX_BLOCK) -> DataFrame:
    """descriptions (id, description) -> id, description, matched (null if none reaches the threshold), similarity (of the best, 0 without candidates).

    All labels of a candidate count.  Distinct (text, label) pairs are scored once.  Ties go to the smallest concept_id.
    """
    pairs = candidates(descriptions, cleaned(token_index(labels), max_size))
    names = labels.select("concept_id", normalized(F.col("label")).alias("name")).distinct()
    named = pairs.join(names, "concept_id")
    scores = named.select("text", "name").distinct().withColumn("similarity", indel_ratio(F.col("text"), F.col("name")))
    per_concept = named.join(scores, ["text", "name"]).groupBy("text", "concept_id").agg(F.max("similarity").alias("similarity"))
    top = per_concept.groupBy("text").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "concept_id")).alias("b"))
    best = top.select("text", F.col("b.concept_id").alias("concept_id"), (-F.col("b.less")).alias("similarity"))
    out = descriptions.withColumn("text", normalized(F.col("description"))).join(best, "text", "left")
    accepted = F.when(F.col("similarity") >= threshold, F.col("concept_id"))
    return out.select("id", "description", accepted.alias("matched"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def clusters(matches: DataFrame, order: str = "id") -> DataFrame:
    """Matched rows by concept: matched, cluster_size, record_ids, descriptions, similarities in the order of `order`, and first_seen."""
    rows = matches.filter(F.col("matched").isNotNull() & (F.col("matched").cast("string") != NO_MATCH))
    grouped = rows.groupBy("matched").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "id", "description", "similarity"))).alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    return grouped.select("matched", F.size("r").cast("long").alias("cluster_size"), pick("id").alias("record_ids"), pick("description").alias("descriptions"),
                          pick("similarity").alias("similarities"), F.col("r")[0]["_o"].alias("first_seen"))
