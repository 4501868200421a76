"""Written intermediate tables and input access shared by the operators of this package.

Lineage is cut by writing Parquet into the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a reread, not a rerun of the whole plan.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of Arrow data in one batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, by its setting or the context's; where neither is set (tests on one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_by_hand = spark._jsc.sc().getCheckpointDir()
        found = set_by_hand.get() if set_by_hand.isDefined() else f"file://{tempfile.mkdtemp(prefix='kgloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, run once: written to the shared folder and read back with its schema."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *dfs: DataFrame) -> None:
    """Deletes the files of tables made by written() that nothing reads any more."""
    for name in {f.rpartition("/")[0] for df in dfs for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def passing(df: DataFrame, *made: str) -> list[str]:
    """The columns that an operator hands on: an input column named like one that it makes is replaced."""
    return [c for c in df.columns if c.lower() not in {m.lower() for m in made}]


def schema_of(df: DataFrame, names: list[str], more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names), more])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def for_python(spark: SparkSession) -> None:
    """Gives Python workers this package, and bounds the session's Arrow batches by rows and bytes since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.sparkContext.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(made, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(made))
        _shipped.add(spark.sparkContext.applicationId)


def words_of(text):
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
