"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Texts are cut into words where no piece can reach across (before a blank that follows a non-blank,
and around characters that occur in no longer piece), and each distinct word is encoded once per worker.  Words of
equal length advance together, one character a step: the hashes of the substrings that end there
probe the sorted piece keys, and a maximum over the lengths stores score and backpointer.

For a unigram model the score is the sum of the pieces' scores.  The scores of a BPE model are
merge ranks, whose sum does not reproduce the merges; its lattice is restricted instead: a piece
may follow the last piece of a prefix only if no merge across their border would have come first
(undoing the later merge of the two, step by step, tells; of merges of equal score the left one comes first).
Exactly one path is left then, the one that merging gives.

Words of more than CUT characters (also those of scripts without blanks) are first cut wherever no piece reaches across, and
their parts advance like words.  A part of more than ALONE characters has too few of its length to
advance with: the matches of all its places are looked up together and its maxima are stored one by one.

The vocabulary is read once on the driver from a given path and sent to the tasks (its size is the vocabulary's).
Only models without normalisation beyond the blank mark are accepted.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become byte
pieces; a text holding the blank mark U+2581 itself decodes to a blank there (round_trip false);
equal rows are encoded alike; an empty table gives an empty result; other columns pass through, but for one named
like the column made (ids or decoded), which is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import for_python, passing, schema_of, table
from ._text import bytes_of, mix, pieces, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CUT, ALONE, CELLS, PIECE, CACHE_WORDS = 32, 256, 1 << 21, 1 << 21, 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Last piece of a prefix: none, or a character outside the vocabulary.
_DEAD, _UNKNOWN = -1, -2


def _key(codes: np.ndarray) -> np.uint64:
    return mix((codes.astype(np.uint64) * powers(_BASE, len(codes))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(codes)))[0]


class Vocabulary:
    """Pieces of a model as sorted arrays."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a\tb  éﬁ① C"
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{path} normalises its texts; only blank marks are supported")
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        normal = [i for i in range(len(self.text)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = np.array([model.get_score(i) for i in range(len(self.text))], np.float64)
        self.byte = np.zeros(256, np.int32)
        for i in range(len(self.text)):
            if model.is_byte(i):
                self.byte[int(self.text[i][3:-1], 16)] = i
        self.longest = max(len(self.text[i]) for i in normal)
        keys = np.array([_key(np.array([ord(c) for c in self.text[i]])) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        # where the keys of each leading 17 bits begin: a probe looks at a few neighbours only
        self.begin = np.searchsorted(self.keys, np.arange(1 << 17, dtype=np.uint64) << np.uint64(47))
        self.reach = int(np.bincount((self.keys >> np.uint64(47)).astype(np.int64)).max())
        self.keys = np.append(self.keys, np.zeros(self.reach, np.uint64))
        self.ids = np.append(self.ids, np.zeros(self.reach, np.int32))
        known = {self.text[i]: i for i in normal}
        if any(c not in known for i in normal for c in self.text[i]):
            raise ValueError("a piece holds a character that is no piece")
        self.known = known
        #: single-byte characters that no longer piece holds
        inside = {c for i in normal if len(self.text[i]) > 1 for c in self.text[i]}
        self.alone = np.array([b < 128 and chr(b) not in inside and b != 32 for b in range(256)])
        self.additive = _is_additive(path)
        #: order of merging, equal for equal scores; single characters come before all merges
        rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        rank[[i for i in normal if len(self.text[i]) == 1]] = -1
        self.rank = rank
        pairs = {}
        for i in normal:
            for cut in range(1, len(self.text[i])):
                a, b = known.get(self.text[i][:cut]), known.get(self.text[i][cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.left, self.right = np.full(len(self.text), -1, np.int32), np.full(len(self.text), -1, np.int32)
        self.bytes = [self._bytes(i) for i in range(len(self.text))]
        if not self.additive:
            for i in normal:
                if len(self.text[i]) > 1:
                    self.left[i], self.right[i] = self._halves(i)

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, piece ids) of the hashes that are a piece's."""
        at = self.begin[(h >> np.uint64(47)).astype(np.int64)]
        where = np.full(len(h), -1)
        for step in range(self.reach):
            where = np.where(self.keys[at + step] == h, at + step, where)
        rows = np.flatnonzero(where >= 0)
        return rows, self.ids[where[rows]]

    def _bytes(self, i: int) -> bytes:
        t = self.text[i]
        if t.startswith("<0x") and self.byte[int(t[3:-1], 16)] == i:
            return bytes([int(t[3:-1], 16)])
        return t.replace(MARK, " ").encode() if t in self.known else b""

    def _halves(self, i: int) -> tuple[int, int]:
        """The two pieces whose merge made piece i; (-1, -1) if merging never makes it."""
        steps = self.merged(self.text[i], want=i)
        return steps if steps is not None else (-1, -1)

    def merged(self, word: str, want: int | None = None):
        """Ids of a word by merging (with byte pieces); with want, the halves of the last merge that makes it."""
        symbols: list[str | None] = list(word)
        before, after = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                joined = symbols[i] + symbols[j]
                if (p := self.known.get(joined)) is not None:
                    heapq.heappush(heap, (-self.score[p], i, joined))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        halves = None
        while heap:
            _, i, joined = heapq.heappop(heap)
            if symbols[i] is None or (j := after[i]) >= len(symbols) or symbols[j] is None or symbols[i] + symbols[j] != joined:
                continue
            halves = (self.known.get(symbols[i], -1), self.known.get(symbols[j], -1))
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        left = [s for s in symbols if s is not None]
        if want is not None:
            return halves if len(left) == 1 else None
        out: list[int] = []
        for s in left:
            p = self.known.get(s)
            out += [p] if p is not None else [int(self.byte[b]) for b in s.encode()]
        return out


def _is_additive(path: str) -> bool:
    """Whether the model is of the unigram kind: trainer_spec (field 2) holds model_type (field 3), 1 being unigram and the default."""

    def fields(raw: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                b = raw[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(raw):
            tag = number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, number()
            elif kind == 2:
                n = number()
                yield tag >> 3, raw[at : at + n]
                at += n
            else:
                at += 4 if kind == 5 else 8
                yield tag >> 3, None

    with open(path, "rb") as f:
        spec = next((v for k, v in fields(f.read()) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1) == 1


class Encoder:
    """Encodes texts; keeps the ids of the distinct words it has met, up to CACHE_WORDS."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pair, self.pair_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.one: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.have = np.empty(0, np.uint64)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_kept_apart(), with the answers of earlier calls in a table where a later pair may take an earlier one's place."""
        key = ((a.astype(np.int64) + 3) << 32) | b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            ok[new] = self._kept_apart(a[new], b[new])
            self.pair[slot[new]] = key[new]
            # where two new pairs share a place, the answer kept is that of the pair kept
            own = new[self.pair[slot[new]] == key[new]]
            self.pair_ok[slot[own]] = ok[own]
        return ok

    def _kept_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps a border between pieces a and b: undo the later merge of the two until neither is merged;
        a merge across the border that would have come before the last one undone joins them."""
        v = self.v
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at].astype(np.int64), b[at].astype(np.int64)
        # the merge undone last, and whether it lay left of the border; ties of one piece go left first
        bound, was_left = np.full(len(a), np.iinfo(np.int64).max), np.zeros(len(a), bool)
        while len(at):
            key = (a << 32) | b
            where = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            rank = np.where(v.pair_keys[where] == key, v.rank[v.pair_piece[where]], np.iinfo(np.int64).max)
            crossed = (rank < bound) | ((rank == bound) & ~was_left & (rank < np.iinfo(np.int64).max))
            ok[at[crossed]] = False
            go = ~crossed & ((v.rank[a] >= 0) | (v.rank[b] >= 0))
            at, a, b = at[go], a[go], b[go]
            was_left = v.rank[a] > v.rank[b]
            bound = np.maximum(v.rank[a], v.rank[b])
            a, b = np.where(was_left, v.right[a], a), np.where(was_left, b, v.left[b])
        return ok

    def _advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number per word) of words of one length, a row each."""
        v = self.v
        n, length = codes.shape
        run = np.zeros((length + 1, n), np.uint64)
        np.cumsum(codes.T.astype(np.uint64) * powers(_BASE, length)[:, None], axis=0, out=run[1:])
        back = powers(_BACK, length + 1)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), _DEAD, np.int32)
        step = np.zeros((length + 1, n), np.int16)
        last[0] = -3
        for i in range(1, length + 1):
            for k in range(1, min(i, v.longest) + 1):
                h = mix((run[i] - run[i - k]) * back[i - k] + np.uint64(k))
                rows, piece = v.probe(h)
                live = best[i - k][rows] > -np.inf
                rows, piece = rows[live], piece[live]
                if v.additive:
                    value = best[i - k][rows] + v.score[piece]
                else:
                    fine = (v.rank[piece] < 0) | (v.left[piece] >= 0)
                    fine[fine] = self._follows(last[i - k][rows[fine]], piece[fine])
                    rows, piece = rows[fine], piece[fine]
                    value = np.zeros(len(rows))
                better = value > best[i][rows]
                rows, piece, value = rows[better], piece[better], value[better]
                best[i][rows], last[i][rows], step[i][rows] = value, piece, k
            # a character outside the vocabulary stands alone
            rows = np.flatnonzero((best[i] == -np.inf) & (best[i - 1] > -np.inf))
            if len(rows):
                single = mix(codes[rows, i - 1].astype(np.uint64) + np.uint64(1))
                rows = np.delete(rows, v.probe(single)[0])
                floor = v.score.min() - 10 if v.additive else 0
                best[i][rows], last[i][rows], step[i][rows] = best[i - 1][rows] + floor, _UNKNOWN, 1
        # the pieces from the end backwards
        at, rows = np.full(n, length), np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            piece = last[at[rows], rows]
            found.append((rows, at[rows].copy(), piece))
            at[rows] -= step[at[rows], rows]
            rows = rows[at[rows] > 0]
        row, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, row))
        row, end, piece = row[order], end[order], piece[order]
        width = np.ones(len(piece), np.int64)
        odd = np.flatnonzero(piece == _UNKNOWN)
        if not len(odd):
            return piece, np.bincount(row, minlength=n)
        spelled = [chr(codes[row[o], end[o] - 1]).encode(errors="surrogatepass") for o in odd]
        width[odd] = [len(s) for s in spelled]
        out = np.repeat(piece, width)
        starts = np.cumsum(width) - width
        for o, s in zip(odd, spelled, strict=True):
            out[starts[o] : starts[o] + len(s)] = self.v.byte[list(s)]
        return out, np.bincount(np.repeat(row, width), minlength=n)

    def _along(self, codes: np.ndarray) -> np.ndarray:
        """The ids of one long word: the search of _advance(), its maxima one by one."""
        v, length = self.v, len(codes)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * powers(_BASE, length))))
        back = powers(_BACK, length + 1)
        found = []
        for k in range(1, min(length, v.longest) + 1):
            rows, piece = v.probe(mix((run[k:] - run[:-k]) * back[: length + 1 - k] + np.uint64(k)))
            found.append((rows + k, np.full(len(rows), k), piece))
        end, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((size, end))
        first = np.searchsorted(end[order], np.arange(length + 2)).tolist()
        size, piece = size[order].tolist(), piece[order].tolist()
        fine = ((v.rank < 0) | (v.left >= 0)).tolist() if not v.additive else []
        single = np.zeros(length + 1, bool)
        single[end[order][np.array(size) == 1]] = True
        best, last, step = [0.0] + [-np.inf] * length, [-3] + [_DEAD] * length, [0] * (length + 1)
        floor = v.score.min() - 10 if v.additive else 0
        for i in range(1, length + 1):
            for at in range(first[i], first[i + 1]):
                k, p = size[at], piece[at]
                if best[i - k] == -np.inf:
                    continue
                if v.additive:
                    value = best[i - k] + v.score[p]
                elif fine[p] and self._one_follows(last[i - k], p):
                    value = 0.0
                else:
                    continue
                if value > best[i]:
                    best[i], last[i], step[i] = value, p, k
            if best[i] == -np.inf and best[i - 1] > -np.inf and not single[i]:
                best[i], last[i], step[i] = best[i - 1] + floor, _UNKNOWN, 1
        out, at = [], length
        while at:
            out.append([last[at]] if last[at] != _UNKNOWN else self.v.byte[list(chr(codes[at - 1]).encode(errors="surrogatepass"))].tolist())
            at -= step[at]
        return np.array([p for part in reversed(out) for p in part], np.int32)

    def _one_follows(self, a: int, b: int) -> bool:
        known = self.one.get((a, b))
        if known is None:
            if len(self.one) > 1 << 20:
                self.one.clear()
            known = self.one[a, b] = bool(self._kept_apart(np.array([a]), np.array([b]))[0])
        return known

    def _parts(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters of all words, first and end of every part): words are cut where no piece holds both neighbours."""
        v = self.v
        codes = np.concatenate([np.append(w, np.uint32(0x110000)) for w in words])  # a mark between words that no piece holds
        n = len(codes)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * powers(_BASE, n))))
        back = powers(_BACK, n + 1)
        held = np.zeros(n + 2, np.int64)
        for k in range(2, min(n, v.longest) + 1):
            rows, _ = v.probe(mix((run[k:] - run[:-k]) * back[: n + 1 - k] + np.uint64(k)))
            np.add.at(held, rows + 1, 1)
            np.add.at(held, rows + k, -1)
        free = np.cumsum(held)[:n] == 0  # nothing reaches across the border before a character
        first = np.flatnonzero(free)
        end = np.append(first[1:], n)
        word = codes[first] != 0x110000
        return codes, first[word], end[word]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number per word)."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        chars = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
        length = np.array([len(w) for w in chars])
        long = np.flatnonzero(length > CUT)
        short = np.flatnonzero(length <= CUT)
        codes = np.concatenate([chars[i] for i in short] or [np.empty(0, np.uint32)])
        end = np.cumsum(length[short])
        first, owner = end - length[short], short
        if len(long):
            more, a, z = self._parts([chars[i] for i in long])
            at = np.searchsorted(np.cumsum(length[long] + 1), a, side="right")
            first, end, owner = np.concatenate((first, a + len(codes))), np.concatenate((end, z + len(codes))), np.concatenate((owner, long[at]))
            codes = np.concatenate((codes, more))
        size = end - first
        ids: list[np.ndarray] = [np.empty(0, np.int32)] * len(size)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > ALONE:
                for i in rows.tolist():
                    ids[i] = self._along(codes[first[i] : end[i]])
                continue
            most = max(1, min(20_000, CELLS // max(1, n)))
            for a in range(0, len(rows), most):
                some = rows[a : a + most]
                flat, count = self._advance(codes[first[some][:, None] + np.arange(n)])
                ends = np.cumsum(count).tolist()
                for i, x, y in zip(some.tolist(), [0, *ends[:-1]], ends, strict=True):
                    ids[i] = flat[x:y]
        order = np.lexsort((first, owner))
        return np.concatenate([ids[i] for i in order.tolist()]), np.bincount(owner, [len(x) for x in ids], len(words)).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per text) of UTF-8 texts side by side."""
        rows, n = len(offsets) - 1, len(data)
        if n == 0:
            return np.empty(0, np.int32), np.zeros(rows, np.int64)
        blank, alone = data == 32, self.v.alone[data]
        cut = alone.copy()
        cut[1:] |= (blank[1:] & ~blank[:-1]) | alone[:-1]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut[full] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        opens = np.zeros(n, bool)
        opens[full] = True
        opens = opens[start]  # a text's first word gets the mark in front
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=run[1:])
        h = mix((run[end] - run[start]) * powers(_BACK, n)[start] * np.uint64(2) + opens)
        new, inverse = np.unique(h, return_inverse=True)
        if len(self.have) > CACHE_WORDS:
            self._forget()
        where = np.searchsorted(self.have, new)
        missing = np.ones(len(new), bool)
        if len(self.have):
            missing = self.have[np.minimum(where, len(self.have) - 1)] != new
        if missing.any():
            sample = np.zeros(len(new), np.int64)
            sample[inverse] = np.arange(len(h))
            at = sample[missing]
            raw = data.tobytes()
            words = [(MARK if o else "") + raw[a:z].decode("utf-8", "replace").replace(" ", MARK) for a, z, o in zip(start[at].tolist(), end[at].tolist(), opens[at].tolist(), strict=True)]
            flat, count = self.words(words)
            first = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate((self.pool, flat))
            have = np.concatenate((self.have, new[missing]))
            order = np.argsort(have, kind="stable")
            self.have, self.first, self.count = have[order], np.concatenate((self.first, first))[order], np.concatenate((self.count, count))[order]
            where = np.searchsorted(self.have, new)
        first, count = self.first[where][inverse], self.count[where][inverse]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]
        text = np.searchsorted(offsets, start, side="right") - 1
        return ids, np.bincount(text, count, rows).astype(np.int64)


class Decoder:
    """Bytes of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = np.array([len(b) for b in vocabulary.bytes])
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts with `count` ids each; the mark in front of a text goes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.pool[np.repeat(self.at[ids] - (ends - size), size) + np.arange(total)]
        last = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
        keep = np.ones(total, bool)
        some = last[:-1][count > 0]
        keep[some[data[some] == 32]] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        return data[keep], kept[last]


def _encoded(vocabulary, names: list[str], at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            data, offsets = bytes_of(batch.column(at_text))
            for a, z in pieces(np.diff(offsets), PIECE):
                at = offsets[a : z + 1]
                ids, count = encoder.encode(data[at[0] : at[-1]], at - at[0])
                first = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:z] for i in range(len(names))), lists], [*names, "ids"])

    return run


def _decoded(vocabulary, names: list[str], at_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            lists = batch.column(at_ids)
            count = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            data, at = decoder.decode(np.asarray(lists.flatten(), np.int64), count)
            text = [bytes(data[a:z]).decode("utf-8", "replace") for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(text, pa.string())], [*names, "decoded"])

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with `ids`, the piece ids of `text`."""
    for_python(docs.sparkSession)
    vocabulary, names = docs.sparkSession.sparkContext.broadcast(Vocabulary(path)), passing(docs, "ids")
    return docs.select(*names).mapInArrow(_encoded(vocabulary, names, names.index("text")), schema_of(docs, names, "ids array<int>"))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with `decoded`, the text of `ids`."""
    for_python(encoded.sparkSession)
    vocabulary, names = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path)), passing(encoded, "decoded")
    return encoded.select(*names).mapInArrow(_decoded(vocabulary, names, names.index("ids")), schema_of(encoded, names, "decoded string"))


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids) and whether decoding gives the text back, in one pass."""
    for_python(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary.value), Decoder(vocabulary.value)
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for a, z in pieces(np.diff(offsets), PIECE):
                at = offsets[a : z + 1]
                own, at = data[at[0] : at[-1]], at - at[0]
                ids, count = encoder.encode(own, at)
                out, out_at = decoder.decode(ids, count)
                raw, first = ids.astype("<i4").tobytes(), np.concatenate(([0], np.cumsum(count))).tolist()
                sha = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(first[:-1], first[1:], strict=True)]
                same = [np.array_equal(own[x:y], out[p:q]) for x, y, p, q in zip(at[:-1], at[1:], out_at[:-1], out_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array(count), pa.array(sha), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
