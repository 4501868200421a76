"""Mixing sources to target weights along a time-varying curriculum (native).

Every source has a weight and a ramp: its weight at training time t in [0, 1] is
``weight * (start*(1-t) + end*t)`` with ``start + end = 2``, so the integral over the whole run
is the weight.  Targets are the weights' shares of the run, stopped at a source's ceiling with
the excess reshared by weight.  Within a source the documents follow the md5 of doc_id; a
document stands at the source's cumulative tokens before its middle, and inverting the source's
cumulative demand ``target * (t + (end-1) * (t*t - t))`` there gives its training time.  The
result is range-sorted by that time.

Prefix sums are taken in two levels: about sqrt(n) hash ranges per source, summed first, so a
source that holds a third of all rows is never ordered by one task.

Defined cases: null text has size 0 and is taken 0 words; null source is a source of its own
(last); a null doc_id orders by the md5 of nothing; equal doc_ids are separate rows whose order
is by size, then by a hash of the row; an empty table gives an empty result; further columns of the input are ignored.  There is one row a
source in `targets`, which one task puts in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import table, words_of, written

WEIGHTS = (3, 1, 2)
#: (start, end) of each source's ramp, repeating like the weights.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE, CEILING = 1.5, 2


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING,
            ramps: Sequence[tuple[float, float]] = RAMPS) -> DataFrame:
    """One row per source of `totals` (source, source_size, n): adds weight, target, start.

    Water filling in closed form: sources sorted by ceiling/weight; the first ones stop at their
    ceiling, and the level of the others is what is left over their weights.
    """
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), ((F.col("at") - 1) % len(xs) + 1).cast("int"))
    t = totals.withColumn("at", F.row_number().over(by_name))
    t = t.withColumn("weight", pick(weights)).withColumn("start", pick([r[0] for r in ramps]))
    t = t.withColumn("top", F.lit(float(ceiling)) * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("weight"), "at")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("budget", F.least(F.lit(float(share)) * F.sum("source_size").over(every), F.sum("top").over(every)))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.col("level"))).over(every))
    t = t.withColumn("target", F.least(F.col("top"), F.coalesce(F.col("level") * F.col("weight"), F.col("top"))))
    return t.select("source", "source_size", "n", "weight", "start", "target")


def time_of(cum: Column, target: Column, start: Column) -> Column:
    """Training time at which a source's demand reaches `cum`: the root of g*t*t + (1-g)*t = cum/target, g = 1-start."""
    y, g = F.least(F.lit(1.0), cum / target), F.lit(1.0) - start
    root = (F.sqrt((1 - g) * (1 - g) + 4 * g * y) - (1 - g)) / (2 * g)
    return F.when(F.abs(g) < 1e-9, y).otherwise(root)


def assigned(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING,
             ramps: Sequence[tuple[float, float]] = RAMPS, own: Sequence[Column] = ()) -> DataFrame:
    """The columns of `own`, by which rows of equal doc_id and size are ordered, and doc_id, source, size, source_size, target, start, first (its source's words before it), taken.

    The mix reads a source's documents in order, again from the first when they end, until the
    target: `taken` counts the words of a document within it, the last one's in part.
    """
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), *own)
    own = sized.columns[3:]
    sized = written(sized, "mix-sizes")
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = written(targets(totals, weights, share, ceiling, ramps), "mix-targets")
    rows = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # 52 bits of the hash, cut into about sqrt(n) ranges
    rows = rows.withColumn("key", key).withColumn("bin", F.floor(F.col("key") / F.lit(float(2**52)) * F.ceil(F.sqrt("n"))))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    rows = rows.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal, size, taken = F.floor(F.col("target") + 0.5), F.col("size"), F.lit(0)
    for turn in range(int(ceiling)):
        taken = taken + F.greatest(F.lit(0), F.least(size, goal - F.lit(turn) * F.col("source_size") - F.col("first")))
    return rows.withColumn("taken", taken.cast("long")).drop("key", "bin", "offset", "n")


def position() -> Column:
    """When the mix first meets a document; null if it never does."""
    middle = F.least(F.col("first") + F.col("size") / 2.0, F.col("target"))
    return F.when(F.col("taken") > 0, time_of(middle, F.col("target"), F.col("start")))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The assignment with `position`, range-sorted by it (documents never met last)."""
    out = assigned(docs, **settings).withColumn("position", position())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.xxhash64("doc_id", "source")
    out = out.repartitionByRange(parts, F.col("position").asc_nulls_last(), salt)
    return out.sortWithinPartitions(F.col("position").asc_nulls_last(), salt, "doc_id")


def whole_documents(docs: DataFrame, ceiling: int = CEILING, **settings) -> DataFrame:
    """The mixed documents themselves, whole and repeated as often as the mix reads them.

    A reading counts if its middle lies within the target, so a source's words miss its target by
    half a document at most.  Readings are range-sorted by their training time.
    """
    # a row is known by two hashes of all that it holds
    own = [F.xxhash64(F.lit(seed), *docs.columns).alias(f"row{seed}") for seed in (1, 2)]
    plan = assigned(docs, ceiling=ceiling, own=own, **settings)
    middles = F.array(*[F.col("first") + F.lit(turn) * F.col("source_size") + F.col("size") / 2.0 for turn in range(ceiling)])
    times = F.transform(F.filter(middles, lambda m: m < F.col("target")), lambda m: time_of(m, F.col("target"), F.col("start")))
    picked = plan.groupBy("row1", "row2").agg(F.count(F.lit(1)).alias("copies"), F.array_sort(F.flatten(F.collect_list(times))).alias("times"))
    picked = written(picked.filter(F.size("times") > 0), "mix-picked")
    rows = docs.select(*own, F.struct(*docs.columns).alias("row"))
    out, again = rows.join(picked.filter("copies = 1"), ["row1", "row2"]), picked.filter("copies > 1")
    if not again.isEmpty():  # equal rows share their readings
        out = out.unionByName(rows.join(again, ["row1", "row2"]).dropDuplicates(["row1", "row2"]))
    out = out.select("row", "row1", "row2", F.explode("times").alias("time"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "time", "row1").sortWithinPartitions("time", "row1", "row2").select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[((pos - 1) % 3 + 1)::INT]::DOUBLE AS weight, ([1.5, 1.0, 0.5])[((pos - 1) % 3 + 1)::INT]::DOUBLE AS start, 2.0::DOUBLE * source_size AS top FROM s
), l AS (
  SELECT *, least(1.5::DOUBLE * sum(source_size) OVER (), sum(top) OVER ()) AS budget,
    coalesce(sum(top) OVER (ORDER BY top / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS stopped,
    sum(weight) OVER (ORDER BY top / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), m AS (
  SELECT *, max(CASE WHEN (budget - stopped) / rest * weight <= top THEN (budget - stopped) / rest END) OVER () AS level FROM l
), t AS (
  SELECT source, source_size, start, least(top, coalesce(level * weight, top)) AS target FROM m
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, 1.0::DOUBLE - t.start AS g,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN abs(g) < 1e-9 THEN y
    ELSE (sqrt((1.0::DOUBLE - g) * (1.0::DOUBLE - g) + 4.0::DOUBLE * g * y) - (1.0::DOUBLE - g)) / (2.0::DOUBLE * g) END END AS position
FROM (SELECT *, least(1.0::DOUBLE, least(first + size / 2.0::DOUBLE, target) / target) AS y,
  (greatest(0, least(size, floor(target + 0.5)::BIGINT - first))
   + greatest(0, least(size, floor(target + 0.5)::BIGINT - source_size - first)))::BIGINT AS taken
  FROM c)
"""
