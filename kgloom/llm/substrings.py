"""Substring dedup: words covered by a 20-word window that also starts earlier are removed.

Pass 1 sketches.  A window's anchor is the smallest hash of its 8-word grams; neighbouring windows mostly share it, so
there is one anchor for about seven windows, and windows that are equal have equal anchors.  Every task counts
the anchors of its texts, segment by segment, in a count-min sketch kept in sparse form (touched cells and
counts).  The partitions' sketches are merged by range of cells.  What is left is one bit per cell - counted at
least twice - and a list of the very frequent cells.  A cell's count is at least that of any anchor in it, so a window whose cell was
counted once is certainly unique.  The bits number about eight for each anchor, up to 2**MOST_BITS, which bounds what is sent to the
tasks; beyond that size more unique windows pass, but none is lost.

Pass 2 groups exactly, and only windows estimated repeated.  Each task works on segments of some million windows:
all but the earliest occurrence in the segment of a window are marked at once, so a passage that a third of all documents share
travels once per segment.  The others travel as runs of windows with one anchor to the slice of that anchor; windows of
very frequent anchors (a short notice in most documents, in ever new surroundings) are dealt by their own hash instead.
A slice sorts its windows by their 64-bit hash, and every occurrence but the earliest (doc_id, start) is
marked.  The number of slices follows the bytes of the texts, so a group's memory does not grow with the table.

Defined cases: null, empty and texts under 20 words lose nothing; rows of one doc_id with different texts are one document
(of windows that start at one place neither is earlier) and are cut each by its own marks; a null doc_id is below every other; an empty table gives an empty
result; other columns pass through, but for columns named n_words or n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import for_python, passing, schema_of, table, written
from ._text import Words, bytes_of, mix, ngrams, pieces

WINDOW, ANCHOR = 20, 8
#: Windows of one segment; bytes of text hashed at once.
SEGMENT, PIECE = 2_000_000, 1 << 20
#: Slices of the hash space for each shuffle partition, and bytes of text for each slice where that makes more.
SLICES, SLICE_BYTES = 4, 16 << 20
#: Cells of the sketch: bytes of text for each, and the powers of two between which they lie; anchors counted more often than FREQUENT are split.
CELL_BYTES, LEAST_BITS, MOST_BITS, FREQUENT = 5, 16, 29, 4096
#: Ranges of cells in which sketches are merged, and bytes of text for each where that makes more.
RANGES, RANGE_BYTES = 64, 1 << 28
_NONE = -(2**63)
BLOBS = "slice int, docs binary, versions binary, starts binary, lens binary, windows binary"


def _slid(x: np.ndarray, want: int, best) -> np.ndarray:
    """best over every `want` neighbours, by doubling."""
    span = 1
    while span < want:
        step = min(span, want - span)
        x, span = best(x[:-step], x[step:]), span + step
    return x


def _anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window the smallest hash of the grams inside it."""
    width = min(ANCHOR, window)
    return _slid(ngrams(words, width), window - width + 1, np.minimum)


def _inside(words: Words, window: int) -> np.ndarray:
    """Whether each window lies in one text."""
    return words.doc[: 1 - window or None] == words.doc[window - 1 :]


def _chosen(words: Words, window: int) -> np.ndarray:
    """The hashes of all places whose gram is the anchor of some window, each place once."""
    width = min(ANCHOR, window)
    span = window - width + 1
    low = np.where(_inside(words, window), _anchors(words.hash, window), 0)
    edge = np.zeros(span - 1, np.uint64)
    gram = ngrams(words.hash, width)
    # a window's anchor is no larger than any gram in it, so a place is an anchor if the largest of the anchors around equals it
    return gram[(_slid(np.concatenate((edge, low, edge)), span, np.maximum) == gram) & (gram > 0)]


class Sketch:
    """The merged sketch: a bit for each cell counted twice or more, and the frequent cells in order."""

    def __init__(self, bits: int, packed: np.ndarray, frequent: np.ndarray):
        self.bits, self.packed, self.frequent = bits, packed, frequent

    def repeated(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each anchor may occur again, and whether it is frequent."""
        cell = _cells(anchors, self.bits)
        some = (self.packed[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        if not len(self.frequent):
            return some, np.zeros(len(cell), bool)
        return some, self.frequent[np.minimum(np.searchsorted(self.frequent, cell), len(self.frequent) - 1)] == cell


def _cells(anchors: np.ndarray, bits: int) -> np.ndarray:
    return (mix(anchors) >> np.uint64(64 - bits)).astype(np.int64)


def _sketched(bits: int, ranges: int, window: int):
    """Per segment and range of cells the cells counted and their counts."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        own = cell >> (bits - ranges)
        edge = np.append(np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))), len(cell))
        low, n = (cell & ((1 << (bits - ranges)) - 1)).astype(np.uint32), np.minimum(n, 65535).astype(np.uint16)
        names = ["part", "cells", "counts"]
        cut = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(own[edge[:-1]].astype(np.int32)), *(pa.array([x[a:z].tobytes() for a, z in cut], pa.binary()) for x in (low, n))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            for a, z in pieces(np.diff(offsets), PIECE):
                at = offsets[a : z + 1]
                words = Words(data[at[0] : at[-1]], at - at[0])
                if len(words.hash) >= window:
                    held.append(_cells(_chosen(words, window), bits))
                    n += len(words.hash)
                if n >= SEGMENT:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _merged(bits: int, ranges: int, frequent: int):
    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << (bits - ranges), np.int64)
        for cells, counts in zip(t.column("cells"), t.column("counts"), strict=True):
            total[np.frombuffer(cells.as_py(), np.uint32)] += np.frombuffer(counts.as_py(), np.uint16)
        often = np.flatnonzero(total > frequent).astype(np.uint32)
        packed = np.packbits(total > 1, bitorder="little")
        return pa.table({"part": t.column("part").slice(0, 1), "packed": pa.array([packed.tobytes()], pa.binary()), "often": pa.array([often.tobytes()], pa.binary())})

    return run


def sketch(texts: DataFrame, window: int = WINDOW, size: int | None = None) -> Sketch:
    """The sketch of the anchors of all windows; size is the bytes of all texts."""
    if size is None:
        size = text_bytes(texts)
    bits = max(LEAST_BITS, min(MOST_BITS, int(np.ceil(np.log2(max(1, size / CELL_BYTES))))))
    ranges = min(bits - 3, int(np.ceil(np.log2(max(RANGES, size / RANGE_BYTES)))))
    frequent = max(FREQUENT, 16 * size // 45 >> bits)
    parts = texts.select("text").mapInArrow(_sketched(bits, ranges, window), "part int, cells binary, counts binary")
    rows = parts.groupBy("part").applyInArrow(_merged(bits, ranges, frequent), "part int, packed binary, often binary").collect()
    packed, often = np.zeros((1 << ranges, 1 << (bits - ranges - 3)), np.uint8), []
    for row in rows:
        packed[row.part] = np.frombuffer(row.packed, np.uint8)
        often.append(np.frombuffer(row.often, np.uint32).astype(np.int64) + (row.part << (bits - ranges)))
    return Sketch(bits, packed.reshape(-1), np.sort(np.concatenate(often)) if often else np.empty(0, np.int64))


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def _repeats(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of all windows that also occur earlier in (docs, starts); a count-min sketch of two rows leaves few to sort."""
    n = len(hashes)
    if n < 2:
        return np.empty(0, np.int64)
    bits = max(10, int(4 * n).bit_length())
    maybe = np.arange(n)
    for shift in (0, 64 - bits):
        cell = ((hashes[maybe] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        maybe = maybe[np.bincount(cell, minlength=1 << bits)[cell] > 1]
    h, d, s = hashes[maybe], docs[maybe], starts[maybe]
    order = np.lexsort((s, d, h))
    h, d, s = h[order], d[order], s[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    return maybe[order[same & ((d != d[head]) | (s != s[head]))]]


def _runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the stretches of consecutive starts with one value in each of `same`."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = starts[1:] != starts[:-1] + 1
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.concatenate(([0], np.flatnonzero(cut) + 1))
    return first, np.diff(np.append(first, len(starts)))


def _segment(parts: list[tuple[np.ndarray, ...]], slices: int) -> Iterator[pa.RecordBatch]:
    docs, versions, starts, hashes, routes = (np.concatenate(x) for x in zip(*parts, strict=True))
    gone = _repeats(hashes, docs, starts)
    if len(gone):
        gone.sort()
        first, length = _runs(starts[gone], docs[gone], versions[gone])
        at = gone[first]
        yield _blob(-1, docs[at], versions[at], starts[at], length, np.empty(0, np.uint64))
        keep = np.ones(len(docs), bool)
        keep[gone] = False
        docs, versions, starts, hashes, routes = (x[keep] for x in (docs, versions, starts, hashes, routes))
    first, length = _runs(starts, docs, versions, routes)
    own = (mix(routes[first]) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    first, length, own = first[order], length[order], own[order]
    ends = np.cumsum(length)
    hashes = hashes[np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    for a, z in zip(edge, np.append(edge, len(own))[1:], strict=True):
        at = first[a:z]
        yield _blob(int(own[a]), docs[at], versions[at], starts[at], length[a:z], hashes[ends[a] - length[a] : ends[z - 1]])


def _blob(at: int, docs, versions, starts, lens, hashes) -> pa.RecordBatch:
    cols = [docs.astype(np.int64), versions.astype(np.int64), starts.astype(np.int32), lens.astype(np.int32), hashes]
    names = ["slice", "docs", "versions", "starts", "lens", "windows"]
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names)


def _sliced(slices: int, window: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, found = [], 0, shared.value
        for batch in batches:
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            data, offsets = bytes_of(batch.column(2))
            for a, z in pieces(np.diff(offsets), PIECE):
                at = offsets[a : z + 1]
                words = Words(data[at[0] : at[-1]], at - at[0])
                if len(words.hash) < window:
                    continue
                anchors = _anchors(words.hash, window)
                some, often = found.repeated(anchors)
                kept = np.flatnonzero(some & _inside(words, window))
                doc, hashes = words.doc[kept], ngrams(words.hash, window)[kept]
                held.append((ids[a:z][doc], versions[a:z][doc], kept - words.first[doc], hashes, np.where(often[kept], hashes, anchors[kept])))
                n += len(kept)
                if n >= SEGMENT:
                    yield from _segment(held, slices)
                    held, n = [], 0
        if n:
            yield from _segment(held, slices)

    return run


def _unpacked(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(name)])


def _marks(docs: np.ndarray, versions: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> pa.Table:
    """Rows (id, version, mark): mark holds a run of window starts as start * 2**24 + length, longer runs in parts."""
    while len(lens) and lens.max() >= 1 << 24:
        big, most = lens >= 1 << 24, (1 << 24) - 1
        docs, versions, starts = np.append(docs, docs[big]), np.append(versions, versions[big]), np.append(starts, starts[big] + most)
        lens = np.append(np.minimum(lens, most), lens[big] - most)
    return pa.table({"id": docs.astype(np.int64), "version": versions.astype(np.int64), "mark": (starts.astype(np.int64) << 24) + lens})


def _grouped(t: pa.Table) -> pa.Table:
    docs, versions = _unpacked(t, "docs", np.int64), _unpacked(t, "versions", np.int64)
    starts, lens = _unpacked(t, "starts", np.int32), _unpacked(t, "lens", np.int32).astype(np.int64)
    if t.column("slice")[0].as_py() < 0:
        return _marks(docs, versions, starts, lens)
    ends = np.cumsum(lens)
    starts = np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])
    run = np.repeat(np.arange(len(lens)), lens)
    gone = np.sort(_repeats(_unpacked(t, "windows", np.uint64), docs[run], starts))
    docs, versions, starts = docs[run[gone]], versions[run[gone]], starts[gone]
    first, length = _runs(starts, docs, versions)
    return _marks(docs[first], versions[first], starts[first], length)


def _own() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.xxhash64("text").alias("version")]


def window_blobs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of docs estimated repeated, by slice, and in slice -1 marks found on the way."""
    spark = docs.sparkSession
    for_python(spark)
    texts = docs.select(*_own(), "text")
    size = text_bytes(texts)
    slices = max(SLICES * int(spark.conf.get("spark.sql.shuffle.partitions")), size // SLICE_BYTES)
    shared = spark.sparkContext.broadcast(sketch(texts, window, size))
    return texts.mapInArrow(_sliced(slices, window, shared), BLOBS)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, version, mark) of every run of windows that also start earlier."""
    # marks found inside a segment have no slice: they are spread by their bytes
    spread = F.when(F.col("slice") < 0, F.xxhash64("docs", "starts")).otherwise(F.lit(0))
    return window_blobs(docs, window).groupBy("slice", spread.alias("salt")).applyInArrow(lambda t: _grouped(t), "id long, version long, mark long")


def _cut(window: int, names: list[str], at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(at_text))
            marks = batch.column(len(names))
            for a, z in pieces(np.diff(offsets), PIECE):
                at = offsets[a : z + 1]
                out, kept_at, n_words, n_removed = _kept(data[at[0] : at[-1]], at - at[0], marks[a:z], window)
                text = pa.Array.from_buffers(pa.string(), z - a, [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(out)])
                cols = [text if i == at_text else batch.column(i)[a:z] for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words), pa.array(n_removed)], [*names, "n_words", "n_removed"])

    return run


def _kept(data, offsets, marks, window):
    """The kept words of each text joined by one blank, as bytes and offsets, and the counts."""
    words = Words(data, offsets, hashes=False)
    rows = len(offsets) - 1
    n_words = np.diff(words.first)
    cover = np.zeros(len(words.start) + 1, np.int64)
    of = np.repeat(np.arange(rows), np.asarray(marks.value_lengths().fill_null(0), np.int64))
    packed = np.asarray(marks.flatten(), np.int64)
    first = words.first[of] + (packed >> 24)
    last = first + (packed & ((1 << 24) - 1)) + window - 1
    fits = last <= words.first[of + 1]  # rows that share a doc_id may differ in length
    np.add.at(cover, first[fits], 1)
    np.add.at(cover, last[fits], -1)
    keep = np.cumsum(cover[:-1]) == 0
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    more = np.zeros(len(doc), bool)
    more[:-1] = doc[1:] == doc[:-1]
    bounds = np.zeros(len(data) + 2, np.int8)
    bounds[start] += 1
    bounds[end + more] -= 1
    taken = np.cumsum(bounds[:-2], dtype=np.int8).astype(bool)[: len(data)]
    out = data.copy()
    out[end[more]] = 32
    kept_at = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=end - start + more, minlength=rows), out=kept_at[1:])
    n_removed = np.bincount(words.doc[~keep], minlength=rows).astype(np.int64)
    return out[taken], kept_at, n_words.astype(np.int64), n_removed


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with `text` made of the kept words joined by one blank, and n_words, n_removed."""
    marks = repeated_windows(docs, window).groupBy("id", "version").agg(F.collect_list("mark").alias("marks"))
    names = passing(docs, "n_words", "n_removed")
    keyed = docs.select(*_own(), F.struct(*names).alias("row")).join(written(marks, "substring-marks"), ["id", "version"], "left")
    joined = keyed.select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)], "marks")
    return joined.mapInArrow(_cut(window, names, names.index("text")), schema_of(docs, names, "n_words long, n_removed long"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20
), g AS (
  SELECT doc_id, i, rank() OVER (PARTITION BY array_to_string(words[i : i + 19], ' ') ORDER BY doc_id, i) > 1 AS later FROM s
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM g WHERE later
), r AS (
  SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id)
), e AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM k
), o AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos WHERE c.pos IS NULL GROUP BY e.doc_id
)
SELECT k.doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN o USING (doc_id)
"""
