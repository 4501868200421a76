"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words (the last one may be shorter).  A passage is
encoded by what its words are - the mean of learned embedding rows of its hashed words and of their hashed first and last three bytes -
and by how it looks - shares of kinds of bytes and word statistics x.  A hidden layer h = tanh(V x + mean of the rows) and gated attention weights
a = softmax(w . (tanh(A h) * sigmoid(B h))) make one weighted representation of the bag, which a
logistic output scores.  All weights are learned together, by Adam on the document labels only;
no passage has a label.  The model is fitted in one task from at most `most` labelled documents
(those with the smallest hashes of doc_id, so the sample is the same in every run), and only its weights reach the driver;
training and scoring read every passage of a text.

Defined cases: a null text is an empty one; an empty text is a bag of one empty passage and gets
the score that makes; where no labelled document exists every score is 0.5; labels that conflict
for one doc_id count as separate examples; other columns pass through, but for one named score, which is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import for_python, held_out, passing, schema_of, table
from ._text import Words, bytes_of, mix, pieces

PASSAGE, PIECE = 64, 1 << 20
MOST, HIDDEN, GATE, EPOCHS, BATCH, SEED = 4000, 24, 12, 24, 64, 7
#: Embedding rows of hashed words, and as many of hashed ends of words; tokens of a word.
ROWS, GRAMS = 2048, 3
THRESHOLD = 0.3
_KINDS = 12


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 11, np.uint8)  # symbols and controls
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[32, 9, 11, 12, 13]], kind[10] = 3, 4
    for at, chars in ((5, ".!?"), (6, ",;:"), (7, "|"), (8, "\"'()-")):
        kind[[ord(c) for c in chars]] = at
    kind[128:192], kind[192:] = 9, 10
    return kind


_KIND = _byte_kinds()
WIDTH = _KINDS + 9


class Bags:
    """Passages of some texts side by side: features x, embedding rows of their tokens (GRAMS a word), words of each, and bag[i]:bag[i+1] the passages of text i."""

    __slots__ = ("x", "tokens", "filled", "bag")

    def __init__(self, x: np.ndarray, tokens: np.ndarray, filled: np.ndarray, bag: np.ndarray):
        self.x, self.tokens, self.filled, self.bag = x, tokens, filled, bag

    def means(self, rows: np.ndarray) -> np.ndarray:
        """The mean embedding row of each passage; nothing for one without words."""
        out = np.zeros((len(self.x), rows.shape[1]), rows.dtype)
        some = np.flatnonzero(self.filled)
        if len(some):
            first = GRAMS * (np.cumsum(self.filled) - self.filled)[some]
            out[some] = np.add.reduceat(rows[self.tokens], first, axis=0) / (GRAMS * self.filled[some, None])
        return out

    def shares(self, rows: int) -> np.ndarray:
        """Passages by rows: the share of each row among a passage's tokens."""
        of = np.repeat(np.arange(len(self.x)), GRAMS * self.filled)
        out = np.bincount(of * rows + self.tokens, minlength=len(self.x) * rows).reshape(len(self.x), rows).astype(np.float32)
        return out / np.maximum(GRAMS * self.filled, 1).astype(np.float32)[:, None]


def encode(texts: pa.Array) -> Iterator[Bags]:
    """Per piece of the texts its passages."""
    data, offsets = bytes_of(texts)
    for a, z in pieces(np.diff(offsets), PIECE):
        at = offsets[a : z + 1]
        yield _encoded(data[at[0] : at[-1]], at - at[0])


def _tokens(words: Words) -> np.ndarray:
    """The embedding rows of each word: of the word, its first and its last three bytes."""
    data, start, end = words.data, words.start, words.end
    out = np.empty((len(start), GRAMS), np.int32)
    out[:, 0] = words.hash % np.uint64(ROWS)
    for at, (first, step) in enumerate(((start, 1), (end - 1, -1))):
        gram = np.full(len(start), at + 1, np.uint64)
        for k in range(3):
            place = first + step * k
            inside = (place >= start) & (place < end)
            gram = (gram << np.uint64(8)) | np.where(inside, data[np.where(inside, place, first)], 0).astype(np.uint64)
        out[:, at + 1] = ROWS + (mix(gram) % np.uint64(ROWS)).astype(np.int32)
    return out.ravel()


def _encoded(data: np.ndarray, offsets: np.ndarray) -> Bags:
    words = Words(data, offsets, lower=True)
    rows = len(offsets) - 1
    per = np.diff(words.first)
    count = np.maximum(1, -(-per // PASSAGE))
    bag = np.concatenate(([0], np.cumsum(count)))
    n = int(bag[-1])
    of = bag[words.doc] + (np.arange(len(words.doc)) - words.first[words.doc]) // PASSAGE
    # bytes of a passage reach from its first word to the next passage's
    head = np.full(n + 1, len(data), np.int64)
    filled = np.bincount(of, minlength=n)
    opens = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
    head[of[opens]] = words.start[opens]
    head[bag[:-1]] = offsets[:-1]
    x = np.zeros((n, WIDTH), np.float32)
    length = np.diff(head).astype(np.float32)
    which = np.repeat(np.arange(n), np.diff(head))
    x[:, :_KINDS] = np.bincount(which * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    x[:, :_KINDS] /= np.maximum(length, 1)[:, None]
    if len(of):
        long = (words.end - words.start).astype(np.float64)
        mean = np.bincount(of, long, n) / np.maximum(filled, 1)
        spread = np.bincount(of, long * long, n) / np.maximum(filled, 1) - mean**2
        order = np.lexsort((words.hash, of))
        h, o = words.hash[order], of[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
        distinct = np.bincount(o[new], minlength=n)
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        top = np.zeros(n)
        np.maximum.at(top, o[new], run)
        again = np.zeros(len(of), bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
        marks = _KIND[data[words.end - 1]]
        filled_1 = np.maximum(filled, 1)
        x[:, _KINDS] = np.minimum(mean / 10, 3)
        x[:, _KINDS + 1] = np.minimum(np.sqrt(np.maximum(spread, 0)) / 10, 3)
        x[:, _KINDS + 2] = distinct / filled_1
        x[:, _KINDS + 3] = top / filled_1
        x[:, _KINDS + 4] = np.bincount(of, again, n) / filled_1
        x[:, _KINDS + 5] = np.bincount(of, marks == 11, n) / filled_1
        x[:, _KINDS + 6] = np.bincount(of, marks == 5, n) / filled_1
        x[:, _KINDS + 7] = np.bincount(of, words.end - words.start == 1, n) / filled_1
    x[:, _KINDS + 8] = np.minimum(filled / PASSAGE, 1)
    return Bags(x, _tokens(words), filled, bag)


class Attention:
    """The network; weights in a dict, so it is small to send."""

    def __init__(self, width: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {
            "mean": np.zeros(width), "scale": np.ones(width),
            "V": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), "v": np.zeros(HIDDEN), "E": np.zeros((2 * ROWS, HIDDEN), np.float32),
            "A": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "B": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "g": rng.normal(0, 1 / np.sqrt(GATE), GATE), "o": np.zeros(HIDDEN), "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bag: np.ndarray, means: np.ndarray):
        w = self.w
        z = np.clip((x - w["mean"]) / w["scale"], -8, 8)
        h = np.tanh(z @ w["V"] + w["v"] + means)
        a, b = np.tanh(h @ w["A"]), 1 / (1 + np.exp(-(h @ w["B"])))
        e = (a * b) @ w["g"]
        rows = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
        e = np.exp(e - np.maximum.reduceat(e, bag[:-1])[rows])
        p = e / np.add.reduceat(e, bag[:-1])[rows]
        m = np.add.reduceat(h * p[:, None], bag[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ w["o"] + w["c"], -30, 30)))
        return y, (z, h, a, b, p, m, rows)

    def score(self, bags: Bags) -> np.ndarray:
        return self.forward(bags.x, bags.bag, bags.means(self.w["E"]))[0]

    def fit(self, bags: list[Bags], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Attention:
        """bags: one text each."""
        n = sum(len(b.x) for b in bags)
        self.w["mean"] = sum(b.x.sum(0, dtype=np.float64) for b in bags) / n
        self.w["scale"] = np.sqrt(sum(((b.x - self.w["mean"]) ** 2).sum(0) for b in bags) / n) + 1e-3
        self.w["c"][:] = np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))
        rng, learned = np.random.default_rng(seed), ["V", "v", "E", "A", "B", "g", "o", "c"]
        first = {k: np.zeros_like(self.w[k]) for k in learned}
        second = {k: np.zeros_like(self.w[k]) for k in learned}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = [bags[i] for i in order[at : at + BATCH]]
                x, tokens, filled = (np.concatenate([getattr(b, c) for b in some]) for c in ("x", "tokens", "filled"))
                bag = np.concatenate(([0], np.cumsum([len(b.x) for b in some])))
                grads = self._gradients(Bags(x.astype(np.float64), tokens, filled, bag), labels[order[at : at + BATCH]])
                step += 1
                rate = 0.02 * (1 - epoch / epochs)
                for k in learned:
                    g = grads[k] + (1e-3 if k == "E" else 1e-4) * self.w[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, bags: Bags, labels: np.ndarray):
        shares, bag = bags.shares(len(self.w["E"])), bags.bag
        y, (z, h, a, b, p, m, rows) = self.forward(bags.x, bag, shares @ self.w["E"])
        w, d = self.w, (y - labels) / len(labels)
        dm = d[:, None] * w["o"]
        dh = p[:, None] * dm[rows]
        dp = (h * dm[rows]).sum(1)
        de = p * (dp - np.add.reduceat(p * dp, bag[:-1])[rows])
        da, db = de[:, None] * w["g"] * b * (1 - a * a), de[:, None] * w["g"] * a * b * (1 - b)
        dh = (dh + da @ w["A"].T + db @ w["B"].T) * (1 - h * h)
        return {"o": m.T @ d, "c": np.array([d.sum()]), "g": (a * b).T @ de, "A": h.T @ da, "B": h.T @ db, "V": z.T @ dh, "v": dh.sum(0), "E": shares.T @ dh.astype(shares.dtype)}


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of labels, those of the smallest doc_id hashes; only ids are read."""
    labels = labels.filter("quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return labels.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Attention | None:
    """The network from at most `most` labelled documents; null without two kinds of labels."""
    schema = "key long, label double, x binary, tokens binary, filled binary"
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled(docs, labels, most)), "doc_id")
    rows = chosen.select(F.xxhash64("doc_id").alias("key"), "text", "quality").mapInArrow(_training, schema)
    found = rows.repartition(1).mapInArrow(_fit, "weights binary").collect()
    if not found:
        return None
    model = Attention(WIDTH)
    model.w = pickle.loads(found[0].weights)
    return model


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights fitted to all rows of _training(); no row without two kinds of labels."""
    found = sorted((tuple(row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[0], r[1], r[3], r[2]))
    labels = np.array([r[1] for r in found])
    if len(labels) and labels.min() < labels.max():
        model = Attention(WIDTH).fit([_read(*r[2:]) for r in found], labels)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.w)], pa.binary())], ["weights"])


def _read(x: bytes, tokens: bytes, filled: bytes) -> Bags:
    x = np.frombuffer(x, np.float32).reshape(-1, WIDTH)
    return Bags(x, np.frombuffer(tokens, np.uint16), np.frombuffer(filled, np.uint16).astype(np.int64), np.array([0, len(x)]))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for b in encode(batch.column(1)):
            n = len(b.bag) - 1
            ends = GRAMS * np.concatenate(([0], np.cumsum(b.filled)))[b.bag]
            cut = list(zip(b.bag[:-1].tolist(), b.bag[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            kept = [[b.x[a:z].tobytes(), b.tokens[p:q].astype(np.uint16).tobytes(), b.filled[a:z].astype(np.uint16).tobytes()] for a, z, p, q in cut]
            cols = [pa.array([k[i] for k in kept], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], batch.column(2)[at : at + n], *cols], ["key", "label", "x", "tokens", "filled"])
            at += n


def scored(docs: DataFrame, model: Attention | None) -> DataFrame:
    """docs with `score`, the probability of label 1."""
    names = passing(docs, "score")
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = np.concatenate([np.empty(0), *(model.score(bags) for bags in encode(batch.column(at_text)))])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(score, pa.float64())], [*names, "score"])

    return docs.select(*names).mapInArrow(run, schema_of(docs, names, "score double"))


def learned(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Attention | None:
    """The model from the labelled documents outside the held-out fold."""
    for_python(docs.sparkSession)
    return fitted(docs, labels.filter(~held_out(F.col("doc_id"))), most)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
