"""Validation of facts as they arrive in a folder of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts
from ..sources import lines


def validate_stream(spark: SparkSession, folder: str, graph: DataFrame, out: str, checkpoint: str, threshold: float = 0.5):
    """A query that scores each micro-batch of new files against the graph and appends accepted facts (s, p, o, score)
    to Parquet under a folder per batch, so a batch that runs again overwrites itself."""

    def batch(rows: DataFrame, at: int) -> None:
        kept = facts.accepted(facts.scored(graph, lines.facts(rows).select("s", "p", "o").distinct()), threshold)
        kept.write.mode("overwrite").parquet(f"{out}/batch={at}")

    source = spark.readStream.text(folder).select(F.col("value"))
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
