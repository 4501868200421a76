"""Validation of existing code-to-concept links by the agreement of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iri
from ..functions.text import composite

THRESHOLD, ALPHA = 0.5, 0.5


def validated(links: DataFrame, codes: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, alpha: float = ALPHA) -> DataFrame:
    """links (icd_raw, snomed_uri), codes (icd9_code, short_title, long_title), labels (concept_id, label) ->
    icd_raw, snomed_uri, icd_code, concept_id, icd_text, best_label, score, verdict.

    Unknown codes have an empty text.  The best label is the one of the highest score above zero (ties to the smallest label), else empty with score 0.
    """
    text = F.trim(F.concat_ws(" ", F.col("short_title"), F.col("long_title")))
    titles = codes.select(F.col("icd9_code").alias("icd_code"), text.alias("icd_text")).dropDuplicates(["icd_code"])
    rows = links.distinct().withColumn("icd_code", iri.icd_code(F.col("icd_raw"))).withColumn("concept_id", iri.concept_id(F.col("snomed_uri")))
    rows = rows.join(titles, "icd_code", "left").withColumn("icd_text", F.coalesce("icd_text", F.lit("")))
    rows = rows.join(labels.select("concept_id", "label"), "concept_id", "left")
    # each distinct pair of texts is scored once
    scores = rows.filter("label is not null").select("icd_text", "label").distinct().withColumn("score", composite(F.col("icd_text"), F.col("label"), alpha))
    rows = rows.join(scores, ["icd_text", "label"], "left")
    best = rows.groupBy("icd_raw", "snomed_uri", "icd_code", "concept_id", "icd_text").agg(
        F.min(F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("less"), "label"))).alias("b"))
    score = F.coalesce(-F.col("b.less"), F.lit(0.0))
    return best.select("icd_raw", "snomed_uri", F.coalesce("icd_code", F.lit("")).alias("icd_code"), F.coalesce("concept_id", F.lit("")).alias("concept_id"), "icd_text",
                       F.coalesce("b.label", F.lit("")).alias("best_label"), score.alias("score"), F.when(score >= threshold, "OK").otherwise("Suspicious").alias("verdict"))
