"""Language ID with interpolated Kneser-Ney character models, one per language.

A text is the sequence of its letters in lower case with one blank after every word.  Each character is packed in 12 bits, so a gram of
ORDER characters is one sorted integer key.  Training counts the highest-order grams of every training
document, added up per task and then over all; the lower orders are continuation counts, as
Kneser-Ney takes them.  The tables are sorted arrays: for each order the grams that any language
has seen with the log-probability under every language (already interpolated), and the contexts
with every language's back-off weight.  Every gram of every language counts.  A model of at most
`most` (language, gram) rows is collected and sent; a larger one stays in tables (`Tables`) of the
same probabilities: the distinct grams of each block of BLOCK bytes of texts are looked up by
joins, and a block's texts meet what was found for them.

A text gets the language of the lowest cross-entropy per character.  `score` is the softmax of
the negative cross-entropies at SHARPNESS; a text whose cross-entropy (`entropy`) lies above its language's
bound is `rejected` and its score is halved: it is still named by the nearest language.  The bounds come from a fold, one in FOLDS by
id of all training documents of languages with many, judged by a model of the others' counts (the model returned counts all): by rank, at most a share of ALPHA of a language's texts
lies above its bound.  A language with too few of them for that rejects nothing.

Defined cases: null texts and texts without a letter are `und` with score 0; without training
documents every text is; ties go to the first language by code point; equal rows get equal
results; an empty table gives an empty result; other columns pass through, but for those named like a column made,
which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import for_python, held_out, passing, schema_of, table, written
from ._text import bytes_of, pieces

ORDER, MOST, FOLDS, MANY, ALPHA, SHARPNESS = 4, 1_000_000, 20, 400, 0.005, 4.0
MADE = "lang_pred string, score double, rejected boolean, entropy double"
PIECE, HELD, BLOCK = 1 << 21, 2_000_000, 1 << 25
_BITS, _PAD, _BLANK = 12, 4095, 1
_codes: list[np.ndarray] = []


def codes() -> np.ndarray:
    """By code point: 0 for what is no letter, else 2..4094 (lower-cased; rare scripts share codes)."""
    if not _codes:
        out = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                out[c] = low if 2 <= low < 2048 else 2048 + low % 2046
        _codes.append(out)
    return _codes[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed grams, first gram of each text and the end, whether each text has a letter)."""
    rows = len(offsets) - 1
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = lead[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = codes()[points]
    n = len(c)
    letter = c > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begin = at[:-1][at[1:] > at[:-1]]
    keep[begin] = letter[begin]
    c[~letter] = _BLANK
    total = np.concatenate(([0], np.cumsum(keep)))
    first = total[at]
    c = c[keep]
    starts = first[:-1][first[1:] > first[:-1]]
    gram, before = c.copy(), c
    for k in range(1, ORDER):
        shifted = np.empty_like(before)
        shifted[1:] = before[:-1]
        shifted[starts] = _PAD
        gram |= shifted << (_BITS * k)
        before = shifted
    letters = np.concatenate(([0], np.cumsum(letter)))[at]
    return gram, first, np.diff(letters) > 0 if n else np.zeros(rows, bool)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's documents."""
    held: dict[str, list[np.ndarray]] = {}
    done: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str) -> None:
        gram, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        if lang in done:
            both, inverse = np.unique(np.concatenate((done[lang][0], gram)), return_inverse=True)
            gram, n = both, np.bincount(inverse, np.concatenate((done[lang][1], n))).astype(np.int64)
        done[lang] = gram, n

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = bytes_of(batch.column(1))
        for a, z in pieces(np.diff(offsets), PIECE):
            at = offsets[a : z + 1]
            gram, first, _ = grams(data[at[0] : at[-1]], at - at[0])
            of = np.repeat(langs[a:z], np.diff(first)) if len(set(langs[a:z])) > 1 else None
            for lang in sorted(set(langs[a:z])):
                held.setdefault(lang, []).append(gram if of is None else gram[of == lang])
                if sum(map(len, held[lang])) > HELD:
                    add(lang)
    for lang in list(held):
        add(lang)
    for lang, (gram, n) in done.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Model:
    """Sorted keys per order with log-probabilities, and contexts with log back-off weights."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        count = len(langs)
        keys = [np.empty(0, np.int64)] * (ORDER + 1)
        per_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for at in range(count):
            g, c = gram[lang == at], n[lang == at].astype(np.float64)
            order = np.argsort(g)
            g, c = g[order], c[order]
            per_order[ORDER].append((g, c))
            for k in range(ORDER - 1, 0, -1):
                mask = (1 << (_BITS * k)) - 1
                g, c = np.unique(g & mask, return_counts=True)  # in how many longer grams it ends
                per_order[k].append((g, c.astype(np.float64)))
        size = max(2, len(np.unique(np.concatenate([p[0] for p in per_order[1]]))))
        self.keys: list[np.ndarray] = [np.empty(0, np.int64)]
        self.logp: list[np.ndarray] = [np.full((1, count), -np.log(size + 1))]
        self.contexts: list[np.ndarray] = [np.empty(0, np.int64)]
        self.weights: list[np.ndarray] = [np.empty((0, count))]
        del keys
        for k in range(1, ORDER + 1):
            every = np.unique(np.concatenate([p[0] for p in per_order[k]]))
            contexts = np.unique(every >> _BITS)
            back = np.zeros((len(contexts), count))
            own = np.zeros((len(every), count))
            for at, (g, c) in enumerate(per_order[k]):
                if not len(g):
                    continue
                once, twice = max(1, (c == 1).sum()), (c == 2).sum()
                discount = once / (once + 2 * twice)
                ctx, inverse = np.unique(g >> _BITS, return_inverse=True)
                total, kinds = np.bincount(inverse, c), np.bincount(inverse)
                where = np.searchsorted(contexts, ctx)
                back[where, at] = np.log(discount * kinds / total)
                own[np.searchsorted(every, g), at] = np.maximum(c - discount, 0) / total[inverse]
            suffix = every & ((1 << (_BITS * (k - 1))) - 1)
            lower = self._log(suffix, k - 1)
            where = np.searchsorted(contexts, every >> _BITS)
            self.keys.append(every)
            self.contexts.append(contexts)
            self.weights.append(back.astype(np.float32))
            self.logp.append(np.log(own + np.exp(back[where] + lower)).astype(np.float32))
        self.bound = np.full(count, np.inf)

    def _log(self, g: np.ndarray, k: int) -> np.ndarray:
        """Log-probability of the last character of each gram of k characters, a column per language."""
        if k == 0:
            return np.repeat(self.logp[0], len(g), axis=0)
        keys = self.keys[k]
        where = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
        out = self.logp[k][where].astype(np.float64)
        miss = np.flatnonzero(keys[where] != g)
        if len(miss):
            contexts = self.contexts[k]
            ctx = g[miss] >> _BITS
            place = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            weight = np.where((contexts[place] == ctx)[:, None], self.weights[k][place], 0)
            out[miss] = weight + self._log(g[miss] & ((1 << (_BITS * (k - 1))) - 1), k - 1)
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character of each text and language, whether the text has a letter)."""
        gram, first, has = grams(data, offsets)
        # each distinct gram is looked up once
        kinds, inverse = np.unique(gram, return_inverse=True)
        table = self._log(kinds, ORDER)
        count = np.diff(first)
        out = np.zeros((len(count), len(self.langs)))
        full = np.flatnonzero(count)
        if len(full):
            for at in range(len(self.langs)):
                out[full, at] = -np.add.reduceat(table[inverse, at], first[:-1][full]) / count[full]
        return out, has

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        """lang_pred, score, rejected and the cross-entropy of that language."""
        names, scores, rejected, entropies = [], [np.empty(0)], [np.empty(0, bool)], [np.empty(0)]
        data, offsets = bytes_of(texts)
        for a, z in pieces(np.diff(offsets), PIECE):
            at = offsets[a : z + 1]
            entropy, has = self.entropies(data[at[0] : at[-1]], at - at[0])
            best = entropy.argmin(1)
            e = np.exp(-SHARPNESS * (entropy - entropy.min(1, keepdims=True)))
            lowest = entropy[np.arange(z - a), best]
            odd = has & (lowest > self.bound[best])
            names += [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            scores.append(np.where(has, e.max(1) / e.sum(1) * np.where(odd, 0.5, 1.0), 0.0))
            rejected.append(odd | ~has)
            entropies.append(np.where(has, lowest, np.nan))
        entropy = np.concatenate(entropies)
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected)), pa.array(entropy, mask=np.isnan(entropy))]


class Found(Model):
    """What was looked up for some grams, in place of a whole model: sorted keys, a column per language."""

    def __init__(self, langs: list[str], bound: np.ndarray, gram: np.ndarray, logp: np.ndarray):
        self.langs, self.bound = langs, bound
        self.gram, first = np.unique(gram, return_index=True)
        self.found = logp[first]

    def _log(self, g: np.ndarray, k: int) -> np.ndarray:
        return self.found[np.searchsorted(self.gram, g)].astype(np.float64)


def _columns(t: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray]:
    """gram and logp of a looked-up table."""
    flat = t.column("logp").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("gram").to_numpy(), flat.reshape(-1, count)


class Tables:
    """The probabilities of a Model as tables, by order: p (gram, p) and contexts (ctx, w), an array element per language."""

    def __init__(self, counts: DataFrame):
        self.langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        count = len(self.langs)
        place = F.create_map(*[F.lit(x) for pair in zip(self.langs, range(count), strict=True) for x in pair])
        order = counts.select(place[F.col("lang")].alias("at"), "gram", F.col("n").cast("double").alias("c"))
        by_order = {ORDER: order}
        for k in range(ORDER - 1, 0, -1):
            shorter = by_order[k + 1].groupBy("at", _end("gram", k).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c"))  # in how many longer grams it ends
            by_order[k] = written(shorter, f"lang-order-{k}")
        size = max(2, by_order[1].select("gram").distinct().count())
        self.flat = F.array_repeat(F.lit(1 / (size + 1)), count)
        self.p: dict[int, DataFrame] = {}
        self.contexts: dict[int, DataFrame] = {}
        for k in range(1, ORDER + 1):
            rows = by_order[k].withColumn("ctx", F.shiftright("gram", _BITS))
            seen = {r["at"]: r for r in rows.groupBy("at").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()}
            discounts = [max(1, seen[at]["once"]) / (max(1, seen[at]["once"]) + 2 * seen[at]["twice"]) for at in range(count)]
            discount = F.array(*[F.lit(float(x)) for x in discounts])[F.col("at")]
            totals = written(rows.groupBy("at", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")), f"lang-totals-{k}")
            weights = totals.groupBy("ctx").agg(_dense(discount * F.col("kinds") / F.col("total"), count, 1.0).alias("w"))
            self.contexts[k] = written(weights, f"lang-contexts-{k}")
            # few keys of many rows are joined by broadcast: up to one character there are at most 4,095 a language
            own = rows.join(_few(totals, k - 1), ["at", "ctx"]).groupBy("gram").agg(_dense(F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total"), count, 0.0).alias("own"))
            own = own.withColumn("ctx", F.shiftright("gram", _BITS)).join(_few(self.contexts[k], k - 1), "ctx").withColumn("end", _end("gram", k - 1))
            own = own.join(_few(self.p[k - 1].select(F.col("gram").alias("end"), F.col("p").alias("lower")), k - 1), "end") if k > 1 else own.withColumn("lower", self.flat)
            self.p[k] = written(own.select("gram", F.zip_with("own", _times(F.col("w"), F.col("lower")), lambda a, b: a + b).alias("p")), f"lang-p-{k}")
        self.bound = np.full(count, np.inf)

    def found(self, grams: DataFrame) -> DataFrame:
        """grams (gram), distinct -> (gram, logp), backed off where the order has not seen one."""
        top = written(grams.join(self.p[ORDER], "gram", "left"), "lang-found")
        rows = top.filter("p is null").select("gram")
        for k in range(ORDER, 0, -1):
            rows = rows.withColumn("end", _end("gram", k)).withColumn("ctx", F.shiftright("end", _BITS))
            if k < ORDER:
                rows = rows.join(_few(self.p[k].select(F.col("gram").alias("end"), F.col("p").alias(f"p{k}")), k), "end", "left")
            rows = rows.join(_few(self.contexts[k].withColumnRenamed("w", f"w{k}"), k - 1), "ctx", "left").drop("end", "ctx")
        p = self.flat
        for k in range(1, ORDER + 1):
            backed = F.when(F.col(f"w{k}").isNull(), p).otherwise(_times(F.col(f"w{k}"), p))
            p = F.coalesce(f"p{k}", backed) if k < ORDER else backed
        every = top.filter("p is not null").unionByName(rows.select("gram", p.alias("p")))
        return every.select("gram", F.transform("p", lambda x: F.log(x).cast("float")).alias("logp"))


def _end(gram: str, k: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << (_BITS * k)) - 1))


def _few(df: DataFrame, characters: int) -> DataFrame:
    return F.broadcast(df) if characters <= 1 else df


def _dense(value: Column, count: int, default: float) -> Column:
    """An aggregate: the value of every `at` below count."""
    have = F.map_from_entries(F.collect_list(F.struct("at", value)))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.coalesce(have[i], F.lit(default)))


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def trained(docs: DataFrame, most: int = MOST) -> Model | Tables | None:
    """The model from (doc_id, text, lang) outside the held-out fold, collected if it has at most `most` rows."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", "doc_id")
    # the fold goes by id, so rows of one id are on one side
    many = rows.groupBy("lang").count().filter(F.col("count") >= MANY).select("lang", F.lit(True).alias("many"))
    fold = F.coalesce(F.col("many"), F.lit(False)) & F.coalesce(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)) == 0, F.lit(False))
    rows = rows.join(F.broadcast(many), "lang", "left").withColumn("kept_out", fold)
    # one scan counts both sides, told apart by a first character
    marked = rows.select(F.concat(F.when(F.col("kept_out"), "1").otherwise("0"), "lang").alias("lang"), "text").mapInArrow(_counted, "lang string, gram long, n long")
    rest = F.sum(F.when(F.col("lang").startswith("0"), F.col("n")).otherwise(0)).alias("rest")
    counts = marked.groupBy(F.expr("substr(lang, 2)").alias("name"), "gram").agg(F.sum("n").alias("n"), rest).withColumnRenamed("name", "lang")
    counts = written(counts, "lang-grams")
    model = _built(counts.select("lang", "gram", "n"), most)
    if model is None:
        return None
    rest = _built(counts.filter("rest > 0").select("lang", "gram", F.col("rest").alias("n")), most)
    if rest is not None:
        own = identified(rows.filter("kept_out").select("text"), rest).select("lang_pred", "entropy").dropna()
        found = dict(zip(rest.langs, bounds(rest.langs, _highest(own)), strict=True))
        model.bound = np.array([found.get(lang, np.inf) for lang in model.langs])
    return model


def _built(counts: DataFrame, most: int) -> Model | Tables | None:
    """The model of counts (lang, gram, n), collected if there are at most `most` rows."""
    size = counts.count()
    if not size:
        return None
    if size > most:
        return Tables(counts)
    found = counts.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(langs)}
    lang = np.array([place[x] for x in found.column("lang").to_pylist()])
    return Model(langs, lang, found.column("gram").to_numpy(), found.column("n").to_numpy())


def _rank(count: int, alpha: float = ALPHA) -> int:
    return int(np.ceil((count + 1) * (1 - alpha)))


def _highest(own: DataFrame) -> dict[str, tuple[int, float]]:
    """lang_pred -> number of its texts, and the cross-entropy of the rank that is its bound (infinite with too few)."""
    own = written(own, "lang-entropies")
    sizes = {r["lang_pred"]: r["n"] for r in own.groupBy("lang_pred").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the rank from above: few rows of each language are sorted last
    above = {lang: n - _rank(n) + 1 for lang, n in sizes.items() if _rank(n) <= n}
    if not above:
        return {lang: (n, np.inf) for lang, n in sizes.items()}
    top = own.withColumn("at", F.row_number().over(Window.partitionBy("lang_pred").orderBy(F.desc("entropy")))).filter(F.col("at") <= max(above.values()))
    asked = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])[F.col("lang_pred")]
    at = {r["lang_pred"]: r["entropy"] for r in top.filter(F.col("at") == asked).collect()}
    return {lang: (n, at.get(lang, np.inf)) for lang, n in sizes.items()}


def bounds(langs: list[str], found: list[tuple[str, float]] | dict[str, tuple[int, float]], alpha: float = ALPHA) -> np.ndarray:
    """The rank of each language's cross-entropies that a further text exceeds with probability alpha at most; infinite with too few."""
    if isinstance(found, dict):
        return np.array([found.get(lang, (0, np.inf))[1] for lang in langs])
    out = np.full(len(langs), np.inf)
    for at, lang in enumerate(langs):
        own = np.sort([e for name, e in found if name == lang])
        rank = _rank(len(own), alpha)
        if rank <= len(own):
            out[at] = own[rank - 1]
    return out


def _blocks(at: int):
    """Rows with the number of their block of about BLOCK bytes of texts, within a task; the text is column `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = bytes_of(batch.column(at))
            block = task + (seen + offsets[:-1]) // BLOCK
            seen += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int64))], [*batch.schema.names, "_block"])

    return run


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) -> the distinct grams of each run of rows of a block; a gram may come more than once."""

    def out(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        gram = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), block, np.int64)), pa.array(gram)], ["_block", "gram"])

    current, held, size = None, [], 0
    for batch in batches:
        block = batch.column(0).to_numpy()
        data, offsets = bytes_of(batch.column(1))
        cuts = np.flatnonzero(np.diff(block)) + 1
        for p, q in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if p == q:
                continue
            if held and block[p] != current:
                yield out(current, held)
                held, size = [], 0
            current = int(block[p])
            for a, z in pieces(np.diff(offsets[p : q + 1]), PIECE):
                at = offsets[p + a : p + z + 1]
                held.append(np.unique(grams(data[at[0] : at[-1]], at - at[0])[0]))
                size += len(held[-1])
                if size > HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0]) // 2
    if held:
        yield out(current, held)


def _joined(docs: DataFrame, model: Tables, schema: str) -> DataFrame:
    names, langs, bound = docs.columns, model.langs, model.bound
    made = [field.split()[0] for field in MADE.split(", ")]
    # a column may have the name of the block's: they go as one
    packed = docs.select("text", F.struct(*[c for c in names if c != "text"]).alias("row")) if len(names) > 1 else docs.select("text", F.struct(F.lit(0).alias("none")).alias("row"))
    marked = written(packed.mapInArrow(_blocks(0), schema_of(packed, ["text", "row"], "_block long")), "lang-blocks")
    asked = written(marked.select("_block", "text").mapInArrow(_distinct_grams, "_block long, gram long"), "lang-asked")
    found = asked.join(written(model.found(asked.select("gram").distinct()), "lang-answers"), "gram")

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = rows.column("row").combine_chunks()
        cols = [rows.column(0) if c == "text" else own.field(c) for c in names]
        return pa.table([*cols, *Found(langs, bound, *_columns(answers, len(langs))).predict(rows.column("text"))], names=[*names, *made])

    return marked.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(run, schema)


def identified(docs: DataFrame, model: Model | Tables | None) -> DataFrame:
    """docs with lang_pred, score, rejected and entropy (null for und)."""
    made = [field.split()[0] for field in MADE.split(", ")]
    names = passing(docs, *made)
    docs, schema, at_text = docs.select(*names), schema_of(docs, names, MADE), names.index("text")
    if isinstance(model, Tables):
        return _joined(docs, model, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            found = model.predict(batch.column(at_text)) if model else [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.ones(n, bool)), pa.nulls(n, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *found], [*names, *made])

    return docs.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    for_python(spark)
    docs = table(spark, sf_dir, "documents")
    model = trained(docs.select("doc_id", "text", "lang"))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "entropy")
