"""Line dedup over levelled sorted runs of line hashes (native).

The keys of long enough lines are hashed once, to 128 bits, and written with their place.  Documents are
dealt by id into batches of about BATCH_ROWS lines (at most MOST_BATCHES).  A batch's keys (h1, h2, n, keeper), n the documents
that hold the key and keeper the largest doc_id among them, are merge-anti-joined with the runs: keys that no run
holds become a run of their own, counts of known keys become a delta.  Runs and deltas are tables bucketed
and sorted by the hash, so no join moves them.  When a level has `fanout` runs they are compacted
into one of the next level.  At the end the runs are merge-joined with the deltas; keys in at least `least` documents lose
their lines everywhere but in the keeper.

The hot keys of boilerplate lines cost one row per document before the first partial sum and one
per task after it; the final join of lines with the repeated keys is a plain equi-join whose hot
partitions AQE splits.

Defined cases: a null or empty text is one empty line; keys under `min_chars` code points never
count; rows of one doc_id are one document, and all of them keep the line if theirs is the largest;
rows without a doc_id are one document, below every other; an empty table gives an empty result; other columns pass through, but
for columns named n_lines or n_dropped, which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import passing, removed, shared_dir, table, written

MIN_CHARS, LEAST_DOCS, FANOUT = 40, 5, 3
BATCH_ROWS, MOST_BATCHES = 1_000_000, 8
_NONE = -(2**63)
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (lower() does the same where all is ASCII)."""
    bare = F.trim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashed(line: Column) -> Column:
    """struct(h1, h2) of a line's key, null for keys that are too short.  The length is tested first: most short lines need no key."""
    key = line_key(line)
    long_enough = (F.length(line) >= MIN_CHARS) & (F.length(key) >= MIN_CHARS)
    return F.when(long_enough, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(2166136261), key).alias("h2")))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _own(docs: DataFrame) -> list[Column]:
    """What tells a document's rows apart: its id and a hash of the text, since rows of one id may differ."""
    return [F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.xxhash64("text").alias("version")]


def long_lines(docs: DataFrame) -> DataFrame:
    """(id, version, at, h1, h2) of the lines that may count."""
    places = F.posexplode(F.transform(split_lines(F.col("text")), _hashed)).alias("at", "h")
    return docs.select(*_own(docs), places).filter(F.col("h").isNotNull()).select("id", "version", "at", "h.h1", "h.h2")


class Run:
    """A table bucketed and sorted by (h1, h2) in the shared folder."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", f"{shared_dir(self.spark)}/{self.name}").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        removed(self.spark, self.rows)
        self.spark.sql(f"DROP TABLE {self.name}")


def _together(runs: list[Run]) -> DataFrame:
    out = runs[0].rows
    for run in runs[1:]:
        out = out.unionByName(run.rows)
    return out


def _added(deltas: list[Run]) -> DataFrame:
    """The deltas as one.  By joins: Spark 4.1 takes a union of bucketed tables for bucketed after it has given up their buckets, and sums it wrongly."""
    out = deltas[0].rows
    for delta in deltas[1:]:
        more = delta.rows.select("h1", "h2", F.col("n").alias("m"), F.col("keeper").alias("k"))
        n, m = (F.coalesce(c, F.lit(0)) for c in ("n", "m"))
        out = out.join(more.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", (n + m).alias("n"), F.greatest("keeper", "k").alias("keeper"))
    return out


class LineRuns:
    """Levels of runs whose keys are disjoint, and deltas of counts for keys of the runs."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels, self.deltas = fanout, [], []

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """keys: (id, h1, h2) of documents that no earlier batch held."""
        counted = keys.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
        if not self.runs():
            self._put(Run(counted, "line_run"), 0)
            return
        batch = Run(counted, "line_batch")
        new = batch.rows
        for run in self.runs():
            new = new.join(run.rows.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        new = Run(new, "line_run")
        self.deltas.append(Run(batch.rows.join(new.rows.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), "line_delta"))
        batch.drop()
        self._put(new, 0)
        if len(self.deltas) >= self.fanout:
            self.deltas = [self._compacted(self.deltas, _added(self.deltas), "line_delta")]

    def _put(self, run: Run, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(self._compacted(old, _together(old), "line_run"), level + 1)

    def _compacted(self, old: list[Run], rows: DataFrame, label: str) -> Run:
        out = Run(rows, label)
        for run in old:
            run.drop()
        return out

    def index(self, least: int = 1) -> DataFrame:
        """(h1, h2, n, keeper) of the keys of at least `least` documents: every run joined with the deltas."""
        found = []
        for run in self.runs():
            rows, n, keeper = run.rows, F.col("n"), [F.col("keeper")]
            for at, delta in enumerate(self.deltas):
                more = delta.rows.select("h1", "h2", F.col("n").alias(f"n{at}"), F.col("keeper").alias(f"keeper{at}"))
                rows = rows.join(more.hint("merge"), ["h1", "h2"], "left")
                n, keeper = n + F.coalesce(f"n{at}", F.lit(0)), [*keeper, F.col(f"keeper{at}")]
            found.append(rows.select("h1", "h2", n.alias("n"), (F.greatest(*keeper) if len(keeper) > 1 else keeper[0]).alias("keeper")).filter(F.col("n") >= least))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def drop(self) -> None:
        for run in self.runs() + self.deltas:
            run.drop()


def repeated_keys(lines: DataFrame, least: int = LEAST_DOCS, batches: int | None = None) -> DataFrame:
    """lines (id, h1, h2, ...) -> (h1, h2, keeper) of the keys that at least `least` documents hold."""
    batches = batches or max(1, min(MOST_BATCHES, -(-lines.count() // BATCH_ROWS)))
    runs = LineRuns()
    for at in range(batches):
        runs.add(lines.filter(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(batches)) == at) if batches > 1 else lines)
    out = written(runs.index(least).select("h1", "h2", "keeper"), "line-repeated")
    runs.drop()
    return out


def dedup_lines(docs: DataFrame, least: int = LEAST_DOCS, batches: int | None = None) -> DataFrame:
    """docs with `text` made of the kept lines, and n_lines, n_dropped."""
    lines = written(long_lines(docs), "line-keys")
    found = repeated_keys(lines, least, batches)
    drops = lines.join(found, ["h1", "h2"]).filter(F.col("id") < F.col("keeper"))
    drops = written(drops.groupBy("id", "version").agg(F.collect_set("at").alias("drop")), "line-drops")
    removed(docs.sparkSession, lines, found)
    names = passing(docs, "n_lines", "n_dropped")
    rows = docs.select(*_own(docs), F.struct(*names).alias("row")).join(drops.hint("merge"), ["id", "version"], "left")  # drops grow with the table: one plan at every size
    rows = rows.select("row", "drop", split_lines(F.col("row.text")).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")  # by a hash set, so in proportion to the lines
    text = F.when(F.col("drop").isNotNull(), F.array_join(F.transform(places, lambda i: F.col("lines")[i]), "\n")).otherwise(F.coalesce("row.text", F.lit("")))
    n_dropped = F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    own = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return rows.select(*own, F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), b AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), r AS (
  SELECT k, max(doc_id) AS keeper FROM b WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT b.*, r.k IS NOT NULL AND b.doc_id < r.keeper AS gone FROM b LEFT JOIN r ON b.k = r.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
