"""Cutting the lineage of tables that a plan reads several times or an iteration builds on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, by its setting or the context's; a folder of this machine only where neither is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kgloom-"))
        found = spark._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder; a folder of this machine is only set where the session names none (tests)."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark._jsc.sc().getCheckpointDir().isDefined()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kgloom-"))
    return df.checkpoint()


def kept(df: DataFrame, label: str) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder as Parquet, which is smaller than a checkpoint."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
