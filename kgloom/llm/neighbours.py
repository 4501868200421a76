"""Approximate nearest neighbours: a forest of random-projection trees with one shared priority queue.

Every tree splits space by hyperplanes between two random points of the node (the midpoint
between them is the split).  The trees are fitted on at most SAMPLE vectors, those of the smallest hashes; every vector is then
put into its leaf of each tree.  A query goes down all trees at once: one priority queue over
all of them holds the branches not taken, by the squared distances to the hyperplanes on the way, summed, and the search
goes on with the best branch of any tree until the leaves taken hold enough distinct vectors (`budget`), as the sample tells.
The budget grows more slowly than the table, since the nearest of more vectors lie nearer.
Candidates of these leaves are ranked by exact distance in double precision.

Equal vectors are one class that keeps its k + 1 smallest vec_ids, which is all that ties to
smaller vec_id can ask for, so a vector that a third of all rows share is one candidate.  Leaves
meet their queries in groups of bounded size, leaves and queries dealt into blocks by hash.

Defined cases: queries and candidates that are null, zero, of another length than most or hold
null or non-finite components take no part, nor do rows without a vec_id; rows equal in vec_id and vector are one row; rows of
one vec_id with different vectors are candidates each, and the one of the smallest hash asks; rows with the
query's vec_id are no candidates; fewer than k candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import for_python, removed, table, written
from ._vectors import matrix as _matrix, usable, vector_key

TREES, LEAF, SAMPLE, NEIGHBOURS, QUERY_BLOCK, LEAF_BLOCK, SEED = 16, 48, 20_000, 10, 256, 4096, 5
#: Distinct vectors that a query looks at: at least LEAST, and HALF of 10,000, growing with the power SLOWER of the table.
LEAST, HALF, SLOWER = 4000, 5500, 0.9


def budget(n: int) -> float:
    """Distinct vectors of n that a query looks at."""
    return min(n, max(LEAST, HALF * (n / 10_000) ** SLOWER))


class Tree:
    """Nodes as arrays: plane and offset, children (negative: leaf number - 1), and the rows of the sample in each leaf."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.planes, self.offsets, self.children, self.held = [], [], [], []
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        self.planes = np.array(self.planes, np.float32).reshape(len(self.offsets), x.shape[1])
        self.offsets, self.children = np.array(self.offsets, np.float32), np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, x, rows, leaf, rng) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = a - b
                norm = np.linalg.norm(plane)
                if norm == 0:
                    continue
                plane = plane / norm
                offset = plane @ (a + b) / 2
                left = x[rows] @ plane < offset
                if 0.1 < left.mean() < 0.9:
                    at = len(self.offsets)
                    self.planes.append(plane)
                    self.offsets.append(offset)
                    self.children.append((0, 0))
                    self.children[at] = (self._grow(x, rows[left], leaf, rng), self._grow(x, rows[~left], leaf, rng))
                    return at
        self.held.append(rows.astype(np.int32))
        return -len(self.held)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner].astype(np.float32), self.planes[node]) >= self.offsets[node]
            at[inner] = self.children[node, right.astype(int)]
        return -at - 1


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        self.sample = len(x)
        self.trees = [Tree(x, leaf, rng) for _ in range(trees)]

    def search(self, q: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) to look into, best first, until they hold `share` of the sample's vectors, each counted once."""
        margins = [np.square(m) * np.sign(m) for m in (t.planes @ q - t.offsets for t in self.trees)]
        queue = [(0.0, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found, seen, left = [], np.zeros(self.sample, bool), share * self.sample
        while queue and (left > 0 or not found):
            far, i, node = heapq.heappop(queue)
            t, margin = self.trees[i], margins[i]
            while node >= 0:
                d = float(margin[node])
                near = int(d >= 0)
                heapq.heappush(queue, (far + abs(d), i, int(t.children[node, 1 - near])))
                node = int(t.children[node, near])
            found.append((i, -node - 1))
            held = t.held[-node - 1]
            left -= len(held) - int(seen[held].sum())
            seen[held] = True
        return found


def _placed(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for i, t in enumerate(forest.value.trees if len(x) else []):
                leaf = t.leaves(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), i, np.int32)), pa.array(leaf.astype(np.int32))], ["cid", "tree", "leaf"])

    return run


def _asked(forest, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_id, q in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)).astype(np.float32), strict=True):
                found = np.array(forest.value.search(q, share), np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query_id, np.int64)), pa.array(found[:, 0]), pa.array(found[:, 1])], ["query_id", "tree", "leaf"])

    return run


def _ranked(k: int):
    """The k + 1 nearest classes of a block of a leaf (and those as near as the last) for each query of a block."""

    def run(t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(zero_copy_only=False), t.column("id").to_numpy()
        x = _matrix(t.column("vector"))
        asked, given = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(asked) or not len(given):
            return pa.table({"query_id": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        cid = ids[given]
        y, keep = x[given], min(k + 1, len(given))
        square = (y * y).sum(1)
        out = []
        for i in asked:
            rough = square - 2 * (y @ x[i])
            # rounding of the expanded form must not drop a tie: some more, then exactly
            some = np.argpartition(rough, keep - 1)[: keep] if keep < len(given) else np.arange(len(given))
            edge = rough[some].max() + 1e-9 * (abs(rough[some]).max() + x[i] @ x[i])
            some = np.flatnonzero(rough <= edge)
            score = np.sqrt(((y[some] - x[i]) ** 2).sum(1))
            near = score <= np.partition(score, keep - 1)[keep - 1]  # with all that tie with the last
            out.append((np.full(int(near.sum()), ids[i]), cid[some][near], score[near]))
        q, c, s = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"query_id": q, "cid": c, "score": s})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, share: float | None = None) -> DataFrame:
    """queries and vectors (vec_id, embedding) -> (query_id, rank, vec_id, score); share of the vectors to look at, by default that of budget()."""
    spark = vectors.sparkSession
    for_python(spark)
    clean = lambda df: df.select("vec_id", F.col("embedding").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = clean(vectors)
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    rows = rows.filter(F.size("vector") == dim).withColumn("key", vector_key(F.col("vector"))).dropDuplicates(["key", "vec_id"])
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    members = written(rows.withColumn("at", first).filter(F.col("at") <= k + 1), "ann-members")
    # a class is known by a number of its own: ids may repeat
    classes = written(members.filter("at = 1").select(F.monotonically_increasing_id().alias("cid"), "key", "vector"), "ann-classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toArrow().column(0)
    forest = spark.sparkContext.broadcast(Forest(_matrix(sample) if len(sample) else np.zeros((0, dim))))
    asks = clean(queries).filter(F.size("vector") == dim).withColumn("key", vector_key(F.col("vector")))
    asks = written(asks.groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("vector", "key").alias("vector")), "ann-queries")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asks = asks.repartition(parts, "query_id")
    share = budget(n) / max(1, n) if share is None else share
    leaves = asks.select("query_id", "vector").mapInArrow(_asked(forest, share), "query_id long, tree int, leaf int")
    places = classes.select("cid", "vector").mapInArrow(_placed(forest), "cid long, tree int, leaf int")
    leaves, places = written(leaves, "ann-asked"), written(places, "ann-places")
    # blocks of queries by blocks of the leaf's classes
    blocks = lambda df, size, name: df.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    many = written(blocks(leaves, QUERY_BLOCK, "nq").join(blocks(places, LEAF_BLOCK, "nc"), ["tree", "leaf"]), "ann-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q = leaves.join(many, ["tree", "leaf"]).withColumn("i", own("query_id", "nq")).withColumn("j", every("nc")).join(asks, "query_id")
    c = places.join(many, ["tree", "leaf"]).withColumn("j", own("cid", "nc")).withColumn("i", every("nq")).join(classes.select("cid", "vector"), "cid")
    cols = ["tree", "leaf", "i", "j", "vector"]
    both = q.select(*cols, F.col("query_id").alias("id"), F.lit(True).alias("asks")).unionByName(c.select(*cols, F.col("cid").alias("id"), F.lit(False).alias("asks")))
    near = both.groupBy("tree", "leaf", "i", "j").applyInArrow(_ranked(k), "query_id long, cid long, score double").distinct()
    # the classes as near as the k + 1 nearest: members of equal distance come from all of them
    best = Window.partitionBy("query_id").orderBy("score")
    near = near.withColumn("r", F.rank().over(best)).filter(F.col("r") <= k + 1).drop("r")
    named = near.join(classes.select("cid", "key"), "cid").join(members.select("key", "vec_id"), "key").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = named.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = written(out, "ann-nearest")
    removed(spark, members, classes, asks, leaves, places, many)
    return out


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
