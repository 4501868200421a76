"""A training corpus from `documents`: five stages, each written and read again by the next.

quality        drops documents that the classifier rejects (score under 0.3)
line_dedup     drops lines that five or more documents hold, but in the largest doc_id
near_copies    keeps one document of each group with Jaccard 0.8 or more, that of the smallest doc_id
mixing         takes whole documents, once or twice each, until every source meets its target
sentencepiece  encodes the texts: doc_id, source, n_tokens, ids

Null texts are empty ones throughout; an empty table passes every stage; further columns pass whatever their names.
The tables written between the stages are removed when the next stage has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import jaccard, lines, mixing, pieces, quality
from kgloom.llm._stage import removed, table, written


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, source, text and the whole rest as one column, so that no name of an operator's meets one of the table's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    return docs.select("doc_id", "source", "text", (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"))


def _unpacked(packed: DataFrame, names: list[str]) -> DataFrame:
    return packed.select(*[F.col(c) if c in ("doc_id", "source", "text") else F.col("rest").getField(c).alias(c) for c in names])


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learned(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _unpacked(quality.scored(_packed(docs), model).filter(F.col("score") >= quality.THRESHOLD), docs.columns)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _unpacked(lines.dedup_lines(_packed(docs)), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.whole_documents(docs)


def _sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", _quality),
    ("line_dedup", _line_dedup),
    ("near_copies", _near_copies),
    ("mixing", _mixing),
    ("sentencepiece", _sentencepiece),
]

#: Learned scores and subword encoding have no SQL; the tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        docs, before = written(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        if at:
            removed(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
