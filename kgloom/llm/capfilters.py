"""Embedding near-dedup with spherical-cap filters (structured random product codes).

Vectors are turned by a fixed random rotation, so that no direction is special.  A filter is a
direction made of one unit code vector per block of dimensions: with m blocks and k code vectors each there are
k**m directions without storing them.  A vector passes every filter whose direction it reaches the cap height
with; one height holds for all vectors and no list is cut.  List decoding goes block by block: a
partial sum is kept while the best scores of the blocks to come can still lift it to the height.  Codes and turned vectors
lie on a grid, so scores are whole numbers that floats hold exactly, and every task finds the same lists.

The height follows from the threshold, the dimension and the number of directions (one for each distinct
vector): it is the one at which, of TRIED random pairs exactly at the threshold, MISSED share no
filter (`needed`), whatever the number of vectors.  Pairs above the threshold share one more often.

Equal vectors are one class.  The filters that differ in their last code vector only (or in a range of it, so that a slice
has about TARGET rows) are one slice: a vector goes there once, with the codes of the filters it passes.  Slices come in
rounds by their first code vector; a round sends each vector SENT times or so, and its shuffle files go before
the next.  A slice much larger than most is compared in square blocks dealt by hash.  Within a slice the vectors of each
filter are compared tile by tile.  A pair counts at one filter (`Codes.at`): the one that its midpoint reaches best if both pass it, else the first
that both pass.  Pairs never leave their block: it gives the number of links of each vector and a forest of its components.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components link with nothing; rows that share a vec_id are rows of their own; a row without a vec_id
takes part, its component's id being the smallest one there is (null without any), and it is kept only if there is none; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components, forest
from ._stage import for_python, removed, table, written
from ._text import mix
from ._vectors import matrix, unit, usable, vector_key

THRESHOLD, MOST_CODES, SEED = 0.9, 16_384, 11
MISSED, TRIED, FIRST, MORE = 0.004, 6000, 256, 3
#: Rows of a slice; of one that is cut into blocks, at least and at most; rows of a round, and how often it sends each vector beyond that.
TARGET, LARGE, LARGEST, ROUND, SENT = 50_000, 8192, 65_536, 2_000_000, 4
#: Rows of decoded scores held at once, side of a tile, pairs held at once, pairs whose filter is sought at once.
ROWS, TILE, HELD, SOUGHT = 250, 1024, 1_000_000, 2000
#: Units a length of 1 is divided into, for scores and for the rotation; what 32-bit floats may err in a cosine.
GRID, FINE, NEAR = 1 << 10, 1 << 20, 1e-5


class Codes:
    """k unit code vectors for each of m blocks of rotated dimensions, and the cap height in units of GRID**2."""

    def __init__(self, dim: int, n: int, seed: int = SEED):
        self.m = next((m for m in (2, 3, 4) if n ** (1 / m) <= MOST_CODES), 5)
        self.m = max(1, min(self.m, dim // 2))
        self.k = max(64, int(np.ceil(max(n, 1) ** (1 / self.m)))) if self.m > 1 else 1
        self.height = -np.inf
        rng = np.random.default_rng(seed)
        self.rotation = np.rint(np.linalg.qr(rng.normal(size=(dim, dim)))[0] * FINE)
        self.cuts = np.linspace(0, dim, self.m + 1).astype(int)
        self.codes = []
        for a, z in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.normal(size=(self.k, z - a))
            self.codes.append(np.rint(c / np.linalg.norm(c, axis=1, keepdims=True) * GRID).astype(np.float32))

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Unit rows in the rotated dimensions, on the grid; sums of whole numbers are exact in any order."""
        return np.rint(np.rint(x * FINE) @ self.rotation * (GRID / FINE**2)).astype(np.float32)

    def decode(self, x: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter, score) of all filters that unit rows reach the height with, by row and filter; those of first codes low..high-1."""
        found = [self._decode(x[a : a + ROWS], a, low, high) for a in range(0, len(x), ROWS)] or [self._decode(x, 0, low, high)]
        row, own, score = (np.concatenate(f) for f in zip(*found, strict=True))
        return row, own, score

    def _decode(self, x: np.ndarray, first: int, low: int, high: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.turned(x)
        codes = [self.codes[0][low:high], *self.codes[1:]]
        scores = [x[:, a:z] @ c.T for c, a, z in zip(codes, self.cuts[:-1], self.cuts[1:], strict=True)]
        top = np.array([s.max(1, initial=-np.inf) for s in scores])
        row, total, own = np.arange(len(x)), np.zeros(len(x), np.float32), np.zeros(len(x), np.int64)
        for at, s in enumerate(scores):
            rest = top[at + 1 :].sum(0)
            # the codes of the row that can be part of a filter at the height at all
            who, code = np.nonzero(s >= (self.height - rest - top[:at].sum(0))[:, None])
            many = np.bincount(who, minlength=len(x))
            begin, own_many = (np.cumsum(many) - many)[row], many[row]
            of = np.repeat(np.arange(len(row)), own_many)
            place = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(own_many) - own_many, own_many)
            sums = total[of] + s[who[place], code[place]]
            keep = sums + rest[row[of]] >= self.height
            of, place = of[keep], place[keep]
            row, total, own = row[of], sums[keep], own[of] * self.k + code[place] + (0 if at else low)
        return row + first, own, total  # rows and codes were gone through in order

    def at(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The one filter that each pair of unit rows x[a], x[b] counts at; they share some filter."""
        out = [np.empty(0, np.int64)]
        for p in range(0, len(a), SOUGHT):
            out.append(self._at(x, a[p : p + SOUGHT], b[p : p + SOUGHT]))
        return np.concatenate(out)

    def _at(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        who, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, a, b = x[who], place[: len(a)], place[len(a) :]
        z = self.turned(x)
        out, of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(a), np.float32), np.zeros(len(a), np.float32)
        for c, p, q in zip(self.codes, self.cuts[:-1], self.cuts[1:], strict=True):
            best = ((z[a, p:q] + z[b, p:q]) @ c.T).argmax(1)
            out = out * self.k + best
            of_a += np.einsum("ij,ij->i", z[a, p:q], c[best])
            of_b += np.einsum("ij,ij->i", z[b, p:q], c[best])
        rest = np.flatnonzero((of_a < self.height) | (of_b < self.height))
        if len(rest):
            asked, place = np.unique(np.concatenate((a[rest], b[rest])), return_inverse=True)
            row, own, _ = self.decode(x[asked])
            first = np.searchsorted(row, np.arange(len(asked) + 1))
            left, right = place[: len(rest)], place[len(rest) :]
            many = np.diff(first)[left]
            of = np.repeat(np.arange(len(rest)), many)
            entry = first[left][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            every = row * self.k**self.m + own
            key = right[of] * self.k**self.m + own[entry]
            hit = every[np.minimum(np.searchsorted(every, key), len(every) - 1)] == key
            pair, where = np.unique(of[hit], return_index=True)
            out[rest[pair]] = own[entry[hit][where]]
        return out


def _pairs(dim: int, n: int, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors of cosine exactly `threshold`."""
    x, y = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, threshold * x + np.sqrt(1 - threshold**2) * y


def shared_heights(codes: Codes, dim: int, threshold: float, tried: int = TRIED, seed: int = SEED + 1) -> np.ndarray:
    """For random pairs at the threshold the largest height at which they share a filter; -inf if they share none at the codes' height."""
    rng, out = np.random.default_rng(seed), []
    for at in range(0, tried, ROWS):
        n = min(ROWS, tried - at)
        (a, f, s), (b, g, t) = (codes.decode(x) for x in _pairs(dim, n, threshold, rng))
        _, i, j = np.intersect1d(a * codes.k**codes.m + f, b * codes.k**codes.m + g, assume_unique=True, return_indices=True)
        best = np.full(n, -np.inf)
        np.maximum.at(best, a[i], np.minimum(s[i], t[j]))
        out.append(best)
    return np.concatenate(out)


def missed(codes: Codes, dim: int, threshold: float, tried: int = TRIED, seed: int = SEED + 3) -> float:
    """The share of random pairs at the threshold that share no filter."""
    return float((shared_heights(codes, dim, threshold, tried, seed) == -np.inf).mean())


def needed(dim: int, n: int, threshold: float = THRESHOLD) -> Codes:
    """Codes for n vectors with the height that the threshold asks for."""
    codes, listed = Codes(dim, n), float(FIRST)
    while codes.m > 1 and 0 < threshold < 1 and listed < codes.k**codes.m / 4:
        codes.height = _height(codes, listed)
        if missed(codes, dim, threshold, TRIED // 10) <= MISSED:
            codes.height = float(np.quantile(shared_heights(codes, dim, threshold), MISSED, method="lower"))
            if codes.height > -np.inf:  # else the few pairs tried first were lucky
                return codes
        listed *= MORE
    return _one(dim)


def _one(dim: int) -> Codes:
    """A single filter that every vector passes."""
    codes = Codes(dim, 1)
    codes.m, codes.k, codes.cuts, codes.codes, codes.height = 1, 1, np.array([0, dim]), [np.zeros((1, dim), np.float32)], -np.inf
    return codes


def _height(codes: Codes, listed: float) -> float:
    """A height that about `listed` directions exceed, if their scores were normal."""
    low, high = 0.0, 2.0
    while high - low > 1e-4:
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(codes, mid) > listed else (low, mid)
    return float(np.floor(high * GRID**2))


def _tail(codes: Codes, height: float) -> float:
    """Directions expected above a height if their scores were normal."""
    spread = sqrt(codes.m / codes.rotation.shape[0])
    return codes.k**codes.m * erfc(height / spread / sqrt(2)) / 2


class Slices:
    """Slices of the filters: those that differ in their last code only, in `parts` ranges of it; the large ones have blocks."""

    def __init__(self, codes: Codes, n: int):
        x = np.random.default_rng(SEED + 5).normal(size=(ROWS, codes.rotation.shape[0]))
        row, own, _ = codes.decode(unit(x))
        each = len(np.unique(row * codes.k**codes.m + own // codes.k)) / ROWS
        self.codes = codes
        self.parts = min(codes.k, max(1, int(np.ceil(n * each / codes.k ** (codes.m - 1) / TARGET))))
        self.count = codes.k ** (codes.m - 1) * self.parts
        self.large, self.blocks = np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, own: np.ndarray) -> np.ndarray:
        k = self.codes.k
        return own // k * self.parts + own % k * self.parts // k

    def cut(self, sizes: list[tuple[int, int]], mean: float) -> None:
        most = min(LARGEST, max(LARGE, int(2 * mean)))
        found = sorted((s, -(-n // most)) for s, n in sizes if n > most)
        self.large, self.blocks = np.array([s for s, _ in found], np.int64), np.array([b for _, b in found], np.int64)

    def blocks_of(self, of: np.ndarray) -> np.ndarray:
        if not len(self.large):
            return np.ones(len(of), np.int64)
        at = np.minimum(np.searchsorted(self.large, of), len(self.large) - 1)
        return np.where(self.large[at] == of, self.blocks[at], 1)


def _runs(row: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where a row's filters of a slice begin."""
    begins = np.ones(len(row), bool)
    begins[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    return np.flatnonzero(begins)


def _sized(slices: Slices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(slices.count, np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            for a in range(0, len(x), ROWS):
                row, own, _ = slices.codes.decode(unit(x[a : a + ROWS]))
                part = slices.of(own)
                sizes += np.bincount(part[_runs(row, part)], minlength=slices.count)
        found = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sizes[found])], ["slice", "m"])

    return run


def _sent(slices: Slices, low: int, high: int):
    names = ["slice", "i", "j", "side", "id", "members", "vector", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, members = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            x = matrix(vectors)
            for a in range(0, len(x), ROWS):
                row, own, _ = slices.codes.decode(unit(x[a : a + ROWS]), low, high)
                part = slices.of(own)
                begin = _runs(row, part)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array((own % slices.codes.k).astype(np.int16)))
                at, part = a + row[begin], part[begin]
                blocks = slices.blocks_of(part)
                block = (mix(ids[at].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                of = np.repeat(np.arange(len(at)), blocks)
                other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine, at = block[of], at[of]
                columns = [part[of], np.minimum(mine, other), np.maximum(mine, other), (mine > other).astype(np.int64), ids[at], members[at]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), vectors.take(pa.array(at)), lists.take(pa.array(of))], names)

    return run


def _compared(slices: Slices, threshold: float):
    codes = slices.codes

    def run(t: pa.Table) -> pa.Table:
        """Of a block of a slice: (a, b) edges of a forest with n null, and (a) with n, the rows linked with a."""
        ids, members, side = (t.column(c).to_numpy() for c in ("id", "members", "side"))
        x = unit(matrix(t.column("vector")))
        y = x.astype(np.float32)
        first = t.column("slice")[0].as_py() // slices.parts * codes.k
        square = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        lists = t.column("codes").combine_chunks()
        code = lists.flatten().to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        order = np.argsort(code, kind="stable")
        code, rows = code[order], rows[order]
        near, held, size = np.zeros(len(ids), np.int64), [], 0
        low = high = np.empty(0, np.int64)

        def counted() -> None:
            nonlocal low, high, size
            a, b, own = (np.concatenate(f) for f in zip(*held, strict=True))
            held.clear()
            size = 0
            pairs, place = np.unique(a * len(ids) + b, return_inverse=True)
            keep = codes.at(x, pairs // len(ids), pairs % len(ids))[place] == own
            a, b = a[keep], b[keep]
            np.add.at(near, a, members[b])
            np.add.at(near, b, members[a])
            low, high = forest(np.concatenate((low, ids[a])), np.concatenate((high, ids[b])))

        cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = rows[p:q]
            left, right = (mine, mine) if square else (mine[side[mine] == 0], mine[side[mine] == 1])
            for u in range(0, len(left), TILE):
                for v in range(u if square else 0, len(right), TILE):
                    cosines = y[left[u : u + TILE]] @ y[right[v : v + TILE]].T
                    i, j = np.nonzero(cosines >= threshold - NEAR)
                    if square and u == v:
                        i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    a, b, c = left[u + i], right[v + j], cosines[i, j]
                    close = np.flatnonzero(c < threshold + NEAR)
                    if len(close):  # by doubles
                        keep = np.ones(len(a), bool)
                        keep[close] = np.einsum("ij,ij->i", x[a[close]], x[b[close]]) >= threshold
                        a, b = a[keep], b[keep]
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    held.append((a, b, np.full(len(a), first + code[p])))
                    size += len(a)
                    if size > HELD:
                        counted()
        if held:
            counted()
        who = np.flatnonzero(near)
        n = pa.array(np.concatenate((np.zeros(len(low), np.int64), near[who])), mask=np.arange(len(low) + len(who)) < len(low))
        return pa.table({"a": np.concatenate((low, ids[who])), "b": np.concatenate((high, ids[who])), "n": n})

    return run


def links(classes: DataFrame, codes: Codes, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """n classes (id, vector, members) -> by block the edges (a, b, null) of a forest of the classes linked there, and (a, a, n): n rows are linked with a."""
    spark, slices = classes.sparkSession, Slices(codes, n)
    sizes = written(classes.select("vector").mapInArrow(_sized(slices), "slice long, m long").groupBy("slice").agg(F.sum("m").alias("m")), "cap-sizes")
    per = slices.count // codes.k if codes.m > 1 else 1
    by_first = sorted((r["c"], r["m"]) for r in sizes.groupBy(F.expr(f"slice div {per}").alias("c")).agg(F.sum("m").alias("m")).collect())
    total = sum(m for _, m in by_first)
    mean = total / slices.count
    slices.cut([(r["slice"], r["m"]) for r in sizes.filter(F.col("m") > min(LARGEST, max(LARGE, int(2 * mean)))).collect()], mean)
    removed(spark, sizes)
    # first codes of each round
    rounds = max(1, -(-total // max(ROUND, SENT * n)))
    ends, sent = [], 0
    for c, m in by_first:
        sent += m
        if sent * rounds >= total * (len(ends) + 1):
            ends.append(c + 1)
    out = None
    for low, high in zip([0, *ends[:-1]], [*ends[:-1], codes.k], strict=True) if ends else [(0, codes.k)]:
        sent = classes.select("id", "vector", "members").mapInArrow(_sent(slices, low, high), f"slice long, i long, j long, side long, id long, members long, vector {classes.schema['vector'].dataType.simpleString()}, codes array<short>")
        found = written(sent.groupBy("slice", "i", "j").applyInArrow(_compared(slices, threshold), "a long, b long, n long"), "cap-links")
        out = found if out is None else out.unionByName(found)
        _reclaimed(spark)
    return out


def _reclaimed(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of what has been written: it does so when the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding) -> one row each: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    for_python(spark)
    rows = vectors.select("vec_id", F.col("embedding").alias("vector")).withColumn("fine", usable(F.col("vector")))
    most = rows.filter("fine").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    key = F.when(F.col("fine") & (F.size("vector") == dim), vector_key(F.col("vector")))
    full = written(rows.select("vec_id", "vector", key.alias("key")), "cap-vectors")
    classes = full.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"), F.any_value("vector").alias("vector"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "cap-classes")
    rows = written(full.select("vec_id", "key"), "cap-rows")
    removed(spark, full)
    _reclaimed(spark)
    n = classes.count()
    codes = needed(dim, n, threshold)  # copies need no directions of their own
    found = links(classes, codes, n, threshold)
    near = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("near"))
    groups = components(found.filter("n is null").select("a", "b")).withColumnRenamed("node", "id")
    named = classes.select("key", "id", "least", "members").join(near, "id", "left").join(groups, "id", "left")
    named = written(named.select("key", "least", (F.coalesce("near", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "cap-named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.select("vec_id", "key").join(named.join(ids, "component").select("key", "n_links", "component_id"), "key", "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r(vec_id, seen) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.seen
), c AS (
  SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""
