"""Line-oriented triple and fact texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iri
from ..functions.text import tokens


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): a rising number over the lines of the files in order; not consecutive across splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def facts(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with s, p, o of those that have exactly three terms; angle brackets are taken off."""
    t = tokens(F.col(line))
    rows = lines.withColumn("_t", t).filter(F.size("_t") == 3)
    return rows.select(*lines.columns, *[iri.bare(F.col("_t")[i]).alias(c) for i, c in enumerate("spo")])


def triples(lines: DataFrame, line: str = "value") -> DataFrame:
    """(s, p, o) of the lines with three terms or more; the object is the rest joined by single blanks."""
    rows = lines.select(tokens(F.col(line)).alias("t")).filter(F.size("t") >= 3)
    return rows.select(F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.array_join(F.slice("t", F.lit(3), F.size("t")), " ").alias("o"))


def joined(separator: str, *columns: str, one_line: bool = True) -> Column:
    """Columns as one line; line breaks inside a term become blanks, as a reader would otherwise split the record."""
    clean = [F.regexp_replace(F.col(c), r"[\r\n]+", " ") if one_line else F.col(c) for c in columns]
    return F.concat_ws(separator, *clean)
