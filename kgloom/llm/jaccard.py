"""N-gram Jaccard join: documents whose sets of 5-word shingles have Jaccard 0.8 or more.

1. Counting: every distinct shingle of every document is counted in 2**21 cells.  The array has a fixed size, so it may
   be collected and sent to all tasks.  It only orders tokens: any common order gives the same links.
2. Prefixes: a document's shingles in rising (cell count, hash) order; the first
   n - ceil(0.8 n) + 1 of them are its prefix.  Linked sets share a token of their prefixes.
   Equal sets are one class, known by a hash of the set, and send their prefix once per task.
3. Postings meet by token in slices of the hash space; those of tokens that one class holds go.  Postings of very
   frequent tokens (by the counts) are not gathered: they go on as rows, whose token is split below.
4. Prefix join, first turn: in each token's postings, in order of size, neighbours make a pair if it passes the length and
   positional filters (tokens of more than BLOCK classes are dealt into blocks, twice).  Verified, these
   pairs join most of what hangs together, at a cost in proportion to the postings.
5. Second turn: pairs of postings of one token in different components, by the same filters: classes outside the token's
   largest component meet all its classes, frequent tokens in square blocks.  No pair inside a component is made, and
   what is found travels as one list for each such class, so that no table has a row for a pair.
6. Each distinct pair is verified once: the suffix filter (a bound on the symmetric difference from shingle counts
   in hash ranges), then the intersection.  Pairs are gathered in groups of bounded bytes: in the first turn by a token that both hold,
   in the second by the component that their token mostly belongs to.
7. Components of the verified links give component_id.

Defined cases: null or wordless texts have the empty set and link with nothing; fewer than five
words are one shingle; rows of one doc_id are told apart by their texts; a row without a doc_id takes part, its component's id being the
smallest one there is (null without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._components import components, forest
from ._stage import for_python, removed, table, written
from ._text import Words, bytes_of, mix, ngrams, pieces

SHINGLE, PERCENT = 5, 80
CELLS, PARTS, PIECE, SEGMENT = 1 << 21, 64, 1 << 20, 500_000
#: Classes of a token's block, documents of a frequent token, postings of a slice, bytes of sets in a group of pairs.
BLOCK, FREQUENT, SLICE, GROUP = 256, 20_000, 1_000_000, 32 << 20
RANGES = 16
_NONE = -(2**63)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = bytes_of(texts)
    for a, z in pieces(np.diff(offsets), PIECE):
        at = offsets[a : z + 1]
        words = Words(data[at[0] : at[-1]], at - at[0], lower=True)
        grams = ngrams(words.hash, n)
        for i in range(z - a):
            first, last = words.first[i], words.first[i + 1]
            if last - first >= n:
                s = np.sort(grams[first : last - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif last > first:
                yield mix(ngrams(words.hash[first:last], int(last - first)) ^ np.uint64(last - first))
            else:
                yield np.empty(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed long."""
    x = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return int(mix(x).view(np.int64)[0])


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1  # n - ceil(percent/100 * n) + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    held: list[np.ndarray] = []
    for batch in batches:
        for s in shingle_sets(batch.column(0)):
            held.append((s >> np.uint64(43)).astype(np.int64))
            if len(held) == 2000:
                counts += np.bincount(np.concatenate(held), minlength=CELLS)
                held = []
    if held:
        counts += np.bincount(np.concatenate(held), minlength=CELLS)
    for part, own in enumerate(counts.reshape(PARTS, -1)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "counts"])


def _add(t: pa.Table) -> pa.Table:
    total = np.minimum(sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("counts")), 2**31 - 1).astype(np.int32)
    return pa.table({"part": t.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Documents per cell of the shingle hashes: CELLS numbers whatever the table's size."""
    parts = docs.select("text").mapInArrow(_count, "part int, counts binary")
    rows = parts.groupBy("part").applyInArrow(_add, "part int, counts binary").collect()
    out = np.zeros((PARTS, CELLS // PARTS), np.int32)
    for row in rows:
        out[row.part] = np.frombuffer(row.counts, np.int32)
    return out.reshape(-1)


POSTINGS = "slice int, tokens binary, classes binary, sizes binary, places binary, ids binary, versions binary"
SHARED = "token long, class long, size int, place int"


def _postings(counts, slices: int, frequent: int):
    """Rows of postings by slice of the token hashes; slice -1 has (class, size, id, version) of every document, slice -2 the frequent tokens."""

    def pack(at, *cols):
        names = ["slice", "tokens", "classes", "sizes", "places", "ids", "versions"]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names)

    def flush(tokens, classes, sizes, ids, versions, mine, n):
        none, count = np.empty(0, np.int32), counts.value
        yield pack(-1, none, np.array(mine, np.int64), np.array(n, np.int32), none, np.array(ids, np.int64), np.array(versions, np.int64))
        if not tokens:
            return
        length = np.array([len(t) for t in tokens])
        token, cls = np.concatenate(tokens), np.repeat(np.array(classes, np.int64), length)
        size, place = np.repeat(np.array(sizes, np.int32), length), np.concatenate([np.arange(k, dtype=np.int32) for k in length])
        own = (token % np.uint64(slices)).astype(np.int64)
        own[count[(token >> np.uint64(43)).astype(np.int64)] > frequent] = -2
        order = np.argsort(own, kind="stable")
        own = own[order]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        for a, z in zip(edge, np.append(edge[1:], len(own)), strict=True):
            o = order[a:z]
            yield pack(int(own[a]), token[o], cls[o], size[o], place[o], none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen, total = counts.value, set(), 0
        state: tuple[list, ...] = ([], [], [], [], [], [], [])
        tokens, classes, sizes, ids, versions, mine, n = state
        for batch in batches:
            for doc_id, version, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2)), strict=True):
                cls = class_of(s) if len(s) else 0
                ids.append(doc_id)
                versions.append(version)
                mine.append(cls)
                n.append(len(s))
                if len(s) and cls not in seen:
                    seen.add(cls)
                    rank = np.sort((count[(s >> np.uint64(43)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | np.arange(len(s), dtype=np.uint64))
                    prefix = s[(rank[: prefix_length(len(s))] & np.uint64(2**32 - 1)).astype(np.int64)]
                    tokens.append(prefix)
                    classes.append(cls)
                    sizes.append(len(s))
                    total += len(prefix)
                if total >= SEGMENT or len(ids) >= SEGMENT:
                    yield from flush(*state)
                    total = 0
                    seen.clear()
                    for part in state:
                        part.clear()
        if ids:
            yield from flush(*state)

    return run


def _column(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(name)])


def _shared(t: pa.Table) -> pa.Table:
    """The postings of a slice, each (token, class) once, without the tokens of one class."""
    token, cls = _column(t, "tokens", np.uint64), _column(t, "classes", np.int64)
    order = np.lexsort((cls, token))
    token, cls = token[order], cls[order]
    once = np.ones(len(token), bool)
    once[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    order, token = order[once], token[once]
    same = token[1:] == token[:-1]
    kept = np.zeros(len(token), bool)
    kept[1:] |= same
    kept[:-1] |= same
    return _rows(t, order[kept])


def _rows(t: pa.Table, order: np.ndarray | slice) -> pa.Table:
    kinds = {"token": ("tokens", np.int64), "class": ("classes", np.int64), "size": ("sizes", np.int32), "place": ("places", np.int32)}
    return pa.table({name: _column(t, column, kind)[order] for name, (column, kind) in kinds.items()})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _rows(pa.Table.from_batches([batch]), slice(None)).to_batches()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in shingle_sets(batch.column(0)) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"])


def _numbers(t: pa.Table) -> pa.Table:
    return pa.table({"id": _column(t, "ids", np.int64), "version": _column(t, "versions", np.int64), "class": _column(t, "classes", np.int64), "n": _column(t, "sizes", np.int32).astype(np.int64)})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _numbers(pa.Table.from_batches([batch])).to_batches()


def _may_link(a: Column, b: Column, of) -> Column:
    """The length and the positional filter for postings a and b; of(x, name) is a column of theirs."""
    size, place = (lambda x: of(x, "size")), (lambda x: of(x, "place"))
    long_enough = 100 * F.least(size(a), size(b)) >= PERCENT * F.greatest(size(a), size(b))
    left = F.least(size(a) - place(a), size(b) - place(b))
    return long_enough & ((100 + PERCENT) * left >= PERCENT * (size(a) + size(b)))


def _distinct(pairs: DataFrame) -> DataFrame:
    """(a, b, bytes, by): each pair of classes once, a < b, with the smallest token it was met by."""
    low = F.col("class") < F.col("other")
    named = pairs.select(F.when(low, F.col("class")).otherwise(F.col("other")).alias("a"), F.when(low, F.col("other")).otherwise(F.col("class")).alias("b"), "bytes", "token")
    return named.groupBy("a", "b").agg(F.max("bytes").alias("bytes"), F.min("token").alias("by"))


def neighbour_pairs(shared: DataFrame) -> DataFrame:
    """First turn: neighbours by size among a token's classes."""
    many = shared.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows, out = shared.join(many, "token"), None
    for deal in range(2):
        dealt = rows.filter("blocks > 1") if deal else rows
        order = Window.partitionBy("token", "block").orderBy("size", "class")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(deal), "class"), "blocks")).withColumn("next", F.lead(F.struct("class", "size", "place")).over(order))
        of = lambda x, name: x[name]
        dealt = dealt.withColumn("own", F.struct("size", "place"))
        fits = F.col("next").isNotNull() & _may_link(F.col("own"), F.col("next"), of)
        found = dealt.filter(fits).select("class", F.col("next.class").alias("other"), (8 * (F.col("size") + F.col("next.size"))).cast("long").alias("bytes"), "token")
        out = found if out is None else out.unionByName(found)
    return _distinct(out)


def _lists(t: pa.Table) -> pa.Table:
    """(a, core, others) for the classes a outside the core of each token of a group: those of other components that may be linked with a through the token."""
    col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("token", "class", "size", "place", "part", "core", "asks", "given")}
    order = np.argsort(col["token"], kind="stable")
    col = {c: x[order] for c, x in col.items()}
    cut = np.flatnonzero(np.concatenate(([True], col["token"][1:] != col["token"][:-1], [True])))
    out: list[tuple[int, int, bytes]] = []
    for p, q in zip(cut[:-1], cut[1:], strict=True):
        own = {c: x[p:q] for c, x in col.items()}
        asks, given = np.flatnonzero(own["asks"]), np.flatnonzero(own["given"])
        size, left = own["size"].astype(np.int64), (own["size"] - own["place"]).astype(np.int64)
        a, b = asks[:, None], given[None, :]
        may = 100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b])
        may &= (100 + PERCENT) * np.minimum(left[a], left[b]) >= PERCENT * (size[a] + size[b])
        may &= (own["part"][a] != own["part"][b]) & ((own["part"][b] == own["core"][0]) | (own["class"][a] < own["class"][b]))
        for at in np.flatnonzero(may.any(1)):
            out.append((int(own["class"][asks[at]]), int(own["core"][0]), own["class"][given[may[at]]].tobytes()))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "core": pa.array([x[1] for x in out], pa.int64()), "others": pa.array([x[2] for x in out], pa.binary())})


def _once(t: pa.Table) -> pa.Table:
    """(a, core, others) with each pair once: lists of many tokens become one for each core; a pair goes with the smallest core, and lists without a core hold pairs already seen."""
    a, core = t.column("a").to_numpy(), t.column("core").fill_null(0).to_numpy()
    seen = t.column("core").is_null().to_numpy(zero_copy_only=False)
    lists = [np.frombuffer(x.as_py(), np.int64) for x in t.column("others")]
    out: list[tuple[int, int, bytes]] = []
    for who in np.unique(a[~seen]).tolist():
        rows = sorted(np.flatnonzero(a == who).tolist(), key=lambda i: (not seen[i], 0 if seen[i] else core[i]))
        b = np.concatenate([lists[i] for i in rows])
        of = np.repeat(np.arange(len(rows)), [len(lists[i]) for i in rows])
        b, first = np.unique(b, return_index=True)  # the first list that holds it
        of = of[first]
        by: dict[int, list[np.ndarray]] = {}
        for k in np.unique(of).tolist():
            if not seen[rows[k]]:
                by.setdefault(int(core[rows[k]]), []).append(b[of == k])
        out += [(who, c, np.concatenate(x).tobytes()) for c, x in by.items()]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "core": pa.array([x[1] for x in out], pa.int64()), "others": pa.array([x[2] for x in out], pa.binary())})


LISTS = "a long, core long, others binary"


def apart_lists(shared: DataFrame, parts: DataFrame, seen: DataFrame) -> DataFrame:
    """Second turn: (a, core, others), each pair once and none of `seen` (a, b)."""
    spark = shared.sparkSession
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = shared.join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    counted = rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"))
    core = counted.groupBy("token").agg(F.max_by("part", F.struct("k", "part")).alias("core"), F.sum("k").alias("m"), F.max("k").alias("most")).filter("most < m")
    core = core.select("token", "core", F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("ask_blocks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("all_blocks"))
    core = written(core, "ngram-cores")
    rows = written(rows.join(core, "token"), "ngram-apart")
    many = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("class"), F.col(c)).cast("int")
    outside = F.col("part") != F.col("core")
    column = ["token", "class", "size", "place", "part", "core"]
    slice_of = F.pmod(F.xxhash64("token"), F.lit(slices)).alias("slice")
    # a token of one block holds both sides at once; of a frequent one those that ask and those that are asked are dealt into blocks
    few = rows.filter("all_blocks = 1").select(*column, slice_of, F.lit(0).alias("i"), F.lit(0).alias("j"), outside.alias("asks"), F.lit(True).alias("given"))
    row = F.xxhash64("token").alias("slice")
    asks = rows.filter((F.col("all_blocks") > 1) & outside).select(*column, row, own("ask_blocks").alias("i"), many("all_blocks").alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("given"))
    given = rows.filter("all_blocks > 1").select(*column, row, many("ask_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("given"))
    found = few.unionByName(asks).unionByName(given).groupBy("slice", "i", "j").applyInArrow(lambda t: _lists(t), LISTS)
    before = seen.select("a", "b").union(seen.select("b", "a"))
    packed = before.groupBy("a").applyInArrow(lambda t: _packed(t), LISTS)
    lists = found.unionByName(packed).groupBy("a").applyInArrow(lambda t: _once(t), LISTS)
    lists = written(lists, "ngram-lists")
    removed(spark, core, rows)
    return lists


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, class): the classes of a task's lists, once for each batch and core."""
    for batch in batches:
        core, lists = batch.column(0).to_numpy(), batch.column(1)
        for c in np.unique(core):
            cls = np.unique(np.concatenate([np.frombuffer(lists[i].as_py(), np.int64) for i in np.flatnonzero(core == c).tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), c)), pa.array(cls)], ["core", "class"])


def _packed(t: pa.Table) -> pa.Table:
    return pa.table({"a": t.column("a").slice(0, 1), "core": pa.nulls(1, pa.int64()), "others": pa.array([t.column("b").to_numpy().tobytes()], pa.binary())})


def verified_lists(lists: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of the linked pairs of apart_lists(); sizes (class, size)."""
    spark = lists.sparkSession
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = written(lists.select("core", "others").mapInArrow(_held, "core long, class long").distinct().join(sizes, "class"), "ngram-held")
    asks = lists.join(sizes.select(F.col("class").alias("a"), "size"), "a")
    blocks = lambda df, name: df.groupBy("core").agg(F.ceil(8 * F.sum("size") / GROUP).cast("int").alias(name))
    many = written(blocks(asks, "ask_blocks").join(blocks(held, "all_blocks"), "core"), "ngram-blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda of, c: F.pmod(F.xxhash64(of), F.col(c)).cast("int")
    small = (F.col("ask_blocks") == 1) & (F.col("all_blocks") == 1)
    slice_of = F.when(small, F.pmod(F.xxhash64("core"), F.lit(slices))).otherwise(F.xxhash64("core"))
    left = lists.join(many, "core").select(slice_of.alias("slice"), own("a", "ask_blocks").alias("i"), every("all_blocks").alias("j"), "core", "a", "others")
    left = left.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("own")).hint("merge"), "a")
    right = held.join(many, "core").select(slice_of.alias("in_slice"), every("ask_blocks").alias("in_i"), own("class", "all_blocks").alias("in_j"), "class").distinct()
    right = right.join(sets.select("class", F.col("tokens").alias("tokens")).hint("merge"), "class")
    checked = lambda key, asked, given: _checked_lists(asked, given)
    out = left.groupBy("slice", "i", "j").cogroup(right.groupBy("in_slice", "in_i", "in_j")).applyInArrow(checked, "a long, b long")
    out = written(out, "ngram-links")
    removed(spark, many, held)
    return out


def _checked_lists(asked: pa.Table, given: pa.Table) -> pa.Table:
    """A forest of the linked pairs of lists; of a list, what lies in this block."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if asked.num_rows and given.num_rows:
        block = _Block(given)
        for a, others, tokens in zip(asked.column("a").to_pylist(), asked.column("others"), asked.column("own"), strict=True):
            b = block.linked(np.frombuffer(tokens.as_py(), np.uint64), np.frombuffer(others.as_py(), np.int64))
            found.append((np.full(len(b), a, np.int64), b))
    a, b = forest(*(np.concatenate(f) for f in zip(*found, strict=True)))
    return pa.table({"a": a, "b": b})


class _Block:
    """Sets (class, tokens) side by side, and how many of each lie in RANGES ranges of the hash."""

    def __init__(self, sets: pa.Table):
        self.cls, first = np.unique(sets.column("class").to_numpy(), return_index=True)
        tokens = sets.column("tokens")
        self.own = [np.frombuffer(tokens[i].as_py(), np.uint64) for i in first.tolist()]
        self.size = np.array([len(s) for s in self.own])
        of = np.repeat(np.arange(len(self.own)), self.size) * RANGES + (np.concatenate(self.own) >> np.uint64(60)).astype(np.int64)
        self.ranges = np.bincount(of, minlength=len(self.own) * RANGES).reshape(-1, RANGES)

    def linked(self, s: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Those of the classes `others` in this block that are linked with the set s."""
        at = np.minimum(np.searchsorted(self.cls, others), len(self.cls) - 1)
        at = at[self.cls[at] == others]
        ranges = np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=RANGES)
        need = least_overlap(self.size[at], len(s))
        may = np.abs(self.ranges[at] - ranges).sum(1) <= self.size[at] + len(s) - 2 * need
        at, need, out = at[may], need[may], []
        for p in range(0, len(at), 256):
            some = at[p : p + 256]
            tokens = np.concatenate([self.own[i] for i in some])
            hit = s[np.minimum(np.searchsorted(s, tokens), len(s) - 1)] == tokens
            ends = np.cumsum(self.size[some])
            out.append(self.cls[some[np.add.reduceat(hit, ends - self.size[some], dtype=np.int64) >= need[p : p + 256]]])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _checked(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs whose sets are linked."""
    block = _Block(sets)
    a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        linked = block.linked(block.own[int(np.searchsorted(block.cls, a[p]))], b[p:q])
        found.append((np.full(len(linked), a[p], np.int64), linked))
    return pa.table(dict(zip(("a", "b"), (np.concatenate(f) for f in zip(*found, strict=True)), strict=True)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b, bytes, by); sets (class, tokens)."""
    spark = pairs.sparkSession
    total = pairs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().bytes
    slices = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))
    heavy = pairs.groupBy("by").agg(F.ceil(F.sqrt(F.sum("bytes") / GROUP)).alias("blocks"))
    own = lambda c: F.pmod(F.xxhash64(c), "blocks").cast("int")
    # tokens of few pairs share a slice, one of many is dealt into square blocks
    slice_of = F.when(F.col("blocks") <= 1, F.pmod(F.xxhash64("by"), F.lit(slices))).otherwise(-F.abs("by") - 1)
    placed = written(pairs.join(heavy, "by").select(slice_of.alias("slice"), own("a").alias("i"), own("b").alias("j"), "a", "b"), "ngram-placed")
    key = ["slice", "i", "j"]
    wanted = placed.select(*key, F.col("a").alias("class")).union(placed.select(*key, "b")).distinct()
    wanted = wanted.join(sets.hint("merge"), "class")
    checked = lambda key, left, right: _checked(left, right)
    wanted = wanted.select(*[F.col(c).alias(f"for_{c}") for c in key], "class", "tokens")
    out = written(placed.groupBy(*key).cogroup(wanted.groupBy(*[f"for_{c}" for c in key])).applyInArrow(checked, "a long, b long"), "ngram-links")
    removed(spark, placed)
    return out


def _parts(docs: DataFrame) -> DataFrame:
    """(id, version, n, class, part) of every document: rows of one part are linked, directly or not; part is null for the empty set."""
    spark = docs.sparkSession
    for_python(spark)
    docs = docs.select(*own_columns(), "text")
    counts = shingle_counts(docs)
    slices = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // 4 // SLICE)
    frequent = max(FREQUENT, 16 * int(counts.mean()))
    shared_counts = spark.sparkContext.broadcast(counts)
    posted = written(docs.select("id", "version", "text").mapInArrow(_postings(shared_counts, slices, frequent), POSTINGS), "ngram-postings")
    shared_counts.destroy()
    shared = posted.filter("slice >= 0").groupBy("slice").applyInArrow(lambda t: _shared(t), SHARED)
    often = posted.filter("slice = -2").mapInArrow(_frequent, SHARED).dropDuplicates(["token", "class"])
    shared = written(shared.unionByName(often), "ngram-shared")
    members = written(posted.filter("slice = -1").mapInArrow(_unpack, "id long, version long, class long, n long"), "ngram-classes")
    removed(spark, posted)
    pairs = written(neighbour_pairs(shared), "ngram-pairs")
    # one text of each class
    first = members.filter("n > 0").groupBy("class").agg(F.min(F.struct("id", "version")).alias("first"))
    first = written(first.join(shared.select("class").distinct(), "class", "left_semi").select("class", "first.*"), "ngram-firsts")
    sets = _sets_of(docs, first, pairs.select(F.col("a").alias("class")).union(pairs.select("b")))
    links = verified(pairs, sets)
    named = lambda df: df.select(F.col("node").alias("class"), F.col("component").alias("part"))
    more = apart_lists(shared, named(components(links)), pairs)
    if not more.isEmpty():
        again = more.select(F.col("a").alias("class")).union(more.select("core", "others").mapInArrow(_held, "core long, class long").select("class"))
        sets = sets.unionByName(_sets_of(docs, first.join(sets.select("class"), "class", "left_anti"), again))
        links = links.unionByName(verified_lists(more, members.filter("n > 0").select("class", F.col("n").alias("size")).distinct(), sets))
    groups = written(named(components(links)), "ngram-parts")
    removed(spark, sets, shared, pairs, more, first)
    return members.join(groups, "class", "left").select("id", "version", "n", "class", F.when(F.col("n") > 0, F.coalesce("part", "class")).alias("part"))


def _sets_of(docs: DataFrame, first: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, tokens) of the given classes, each from its row of first (class, id, version).  What is wanted grows with the table: it is joined by shuffling at every size."""
    wanted = written(first.join(classes.distinct(), "class", "left_semi").select("id", "version"), "ngram-wanted")
    sets = written(docs.join(wanted.hint("merge"), ["id", "version"], "left_semi").select("text").mapInArrow(_sets, "class long, tokens binary"), "ngram-sets")
    removed(docs.sparkSession, wanted)
    return sets


def own_columns() -> list[Column]:
    """What tells documents apart: the id and a hash of the text, since rows of one id may differ."""
    return [F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.xxhash64("text").alias("version")]


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows = written(_parts(docs), "ngram-named")
    real = F.when(F.col("id") != _NONE, F.col("id"))
    least = rows.filter("n > 0").groupBy("part").agg(F.min(real).alias("least"))
    out = rows.join(least, "part", "left")
    return out.select(real.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(real).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each group of linked documents: the smallest doc_id stays (rows without one only if there is none)."""
    rows = written(_parts(docs).filter("n > 0"), "ngram-named")
    order = F.struct((F.col("id") == _NONE).alias("none"), "id", "version")
    best = rows.groupBy("part").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    of_many = rows.join(best, "part")
    last = (F.col("id") != F.col("best.id")) | (F.col("version") != F.col("best.version"))
    gone = written(of_many.filter(last).select("id", "version").distinct(), "ngram-gone")
    again = written(of_many.filter(~last).groupBy("id", "version").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id", "version"), "ngram-again")
    keyed = docs.select(*own_columns(), F.struct(*docs.columns).alias("row")).join(gone, ["id", "version"], "left_anti")
    out = keyed.join(again, ["id", "version"], "left_anti")
    if not again.isEmpty():  # rows equal in id and text
        out = out.unionByName(keyed.join(again, ["id", "version"], "left_semi").dropDuplicates(["id", "version"]))
    return out.select("row.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))
    WHEN len(words) > 0 THEN ['<' || array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
