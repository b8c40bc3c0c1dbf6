"""Toxicity by two class-conditional Kneser-Ney models.

Each class's model gives the probability of a word as the product over its bytes (a
start before, an end after it) of n-gram probabilities of order 6 with interpolated
absolute discounting: raw counts at the highest order, counts of different left
neighbours below. Orders up to ``SHARED`` are counted over both classes together, so
an expression that is rare in both backs off to the same numbers and says nothing,
while a rare word with the stem of known ones is still recognised.

A text's score compares the two log-likelihoods normalised by length: their
difference per word, and per root of the number of words (by their inverse hyperbolic
sines, so that texts far from both classes do not set the scale), with that number, go into
a logistic regression fitted on a fold of the learning rows that the counts leave
out. The fold goes by the least hash of a text's word n-grams, so that copies of a text
all stand on one side (near copies as often as they share that n-gram), and what the
regression sees are texts as new as those to be scored.

Learning uses at most ``MAX_DOCS`` labelled texts of each class (those with the
least hashes of their id); where that cuts a class, the regression weights its rows by
the inverse of the rate, so that classes keep their ratio. The words' counts are one
distributed aggregation, the models (bounded by that sample) go to the tasks, every
whole text is scored there.
Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts have difference 0 and are scored like any other;
repeated rows are scored each; labels that are null or other than 0 and 1, or whose
text is missing, teach nothing (of a document's labels the largest counts); if one
class has no learning texts every score is the share of label 1 among them (0 if
there are none); an empty table gives no rows; the score and ``predicted`` replace
input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm.jaccard_join import shingle_sets
from scorelens.llm.words import doc_words, mix

ORDER = 6
SHARED = 1
MAX_DOCS = 16_000
FOLDS = 5
FOLD_WORDS = 5
REMEMBERED = 1_000_000
_START, _END = 1, 2
OUT = ["score", "predicted"]


def word_grams(words: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each byte of the words and at their ends, as integers
    (last byte lowest, filled with starts), and each word's first one."""
    words = words.cast(pa.large_string())
    n = len(words)
    off = np.frombuffer(words.buffers()[1], np.int64, count=words.offset + n + 1)[words.offset:]
    data = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    size = np.diff(off) + 1
    ends = np.cumsum(size) - 1
    out = np.empty(len(data) + n, np.uint64)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = data, _END
    place = np.arange(len(out)) - np.repeat(ends + 1 - size, size)
    gram = out.copy()
    for k in range(1, order):
        before = np.full(len(out), _START, np.uint64)
        before[k:] = np.where(place[k:] >= k, out[:len(out) - k], np.uint64(_START))
        gram |= before << np.uint64(8 * k)
    return gram, ends + 1 - size


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


class KneserNey:
    """Models of two classes from word counts [words, 2]."""

    def __init__(self, words: pa.Array, counts: np.ndarray, order: int = ORDER, shared: int = SHARED):
        self.order = order
        gram, weight = np.empty(0, np.uint64), np.empty((0, 2))
        for lo in range(0, len(words), 50_000):  # slices, so that only distinct n-grams are held
            part = words.slice(lo, 50_000)
            own, first = word_grams(part, order)
            times = np.repeat(counts[lo:lo + 50_000], np.diff(np.append(first, len(own))), axis=0)
            gram, where = np.unique(np.concatenate([gram, own]), return_inverse=True)
            both = np.concatenate([weight, times])
            weight = np.stack([np.bincount(where, both[:, c], len(gram)) for c in (0, 1)], 1)
        self.tables: list = [None] * (order + 1)
        upper = None
        for k in range(order, 0, -1):
            keys, where = np.unique(gram & _mask(k), return_inverse=True)
            raw = np.stack([np.bincount(where, weight[:, c], len(keys)) for c in (0, 1)], 1)
            if k == order:
                used, pooled = raw, raw.sum(1)
            else:
                at = np.searchsorted(keys, upper[0] & _mask(k))
                used = np.stack([np.bincount(at, upper[1][:, c] > 0, len(keys)) for c in (0, 1)], 1).astype(np.float64)
                pooled = np.bincount(at, upper[1].any(1), len(keys)).astype(np.float64)
                if k > 1:  # nothing but the start stands before a start
                    begin = (keys >> np.uint64(8 * (k - 1))) == _START
                    used[begin], pooled[begin] = raw[begin], raw[begin].sum(1)
            upper = (keys, raw)
            if k <= shared:
                used = np.stack([pooled, pooled], 1)
            context, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.stack([np.bincount(of, used[:, c], len(context)) for c in (0, 1)], 1)
            kinds = np.stack([np.bincount(of, used[:, c] > 0, len(context)) for c in (0, 1)], 1)
            once, twice = (used == 1).sum(0), (used == 2).sum(0)
            discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
            self.tables[k] = (keys, used.astype(np.float32), context, total.astype(np.float32),
                              kinds.astype(np.float32), discount)

    def log_ratio(self, words: pa.Array) -> np.ndarray:
        """ln P(word | class 1) - ln P(word | class 0)."""
        if not len(words):
            return np.empty(0)
        gram, first = word_grams(words, self.order)
        gram, where = np.unique(gram, return_inverse=True)  # a probability needs the n-gram only
        p = np.full((len(gram), 2), 1 / 256)
        for k in range(1, self.order + 1):
            keys, used, context, total, kinds, discount = self.tables[k]
            if not len(keys):
                continue
            g = gram & _mask(k)
            at = np.minimum(np.searchsorted(context, g >> np.uint64(8)), len(context) - 1)
            t = np.where((context[at] == g >> np.uint64(8))[:, None], total[at], 0).astype(np.float64)
            own = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            c = np.where((keys[own] == g)[:, None], used[own], 0)
            some = np.maximum(t, 1e-9)
            p = np.where(t > 0, np.maximum(c - discount, 0) / some + discount * kinds[at] / some * p, p)
        ratio = np.log(p[:, 1]) - np.log(p[:, 0])
        return np.add.reduceat(ratio[where], first)


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of a text's log-likelihood difference and its number of words."""
    m = np.maximum(n, 1)
    return np.stack([np.arcsinh(4 * total / m), np.arcsinh(total / np.sqrt(m)), np.log1p(n)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60,
                 times: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(mean, scale, weights) of a ridge logistic regression, by Newton steps; ``times``:
    how many rows each row stands for."""
    times = np.ones(len(x)) if times is None else times
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])

    def loss(w):
        t = z @ w
        return times @ (np.logaddexp(0, t) - y * t) + w @ penalty @ w / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (times * (p * (1 - p) + 1e-9))[:, None]).T @ z + penalty, z.T @ (times * (y - p)) - penalty @ w)
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2  # a full step may go too far where classes are nearly apart
        w, now = w + step, min(now, after)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def predict_logistic(model: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -35, 35)))


class _Scorer:
    """Differences of texts; a worker remembers the words it has met."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.known, self.ratio = pa.array([], pa.large_string()), np.empty(0)

    def totals(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        codes, off, words = doc_words(text)
        if len(self.known) > REMEMBERED or self.known.nbytes > C.REMEMBERED_BYTES:
            self.known, self.ratio = pa.array([], pa.large_string()), np.empty(0)
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        ratio = np.where(at >= 0, self.ratio[at] if len(self.ratio) else 0.0, 0.0)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            ratio[new] = self.model.log_ratio(fresh)
            self.known = pa.concat_arrays([self.known, fresh])
            self.ratio = np.concatenate([self.ratio, ratio[new]])
        run = np.append(0, np.cumsum(ratio[codes]))
        return run[off[1:]] - run[off[:-1]], np.diff(off)


def _scorer(shared) -> _Scorer:
    return C.held(("toxicity", shared.id), lambda: _Scorer(shared.value))  # ``id``: Spark's number of the broadcast


class _Shared:
    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(value)
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def _differences(rows: DataFrame, text: str, shared: _Shared, columns: list[str]) -> DataFrame:
    """``columns`` of every row with its difference ``__d`` and number of words ``__n``."""
    schema = T.StructType([rows.schema[c] for c in columns]
                          + [T.StructField("__d", T.DoubleType()), T.StructField("__n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in C.slices(batches, text):
            d, n = scorer.totals(C.texts(batch, text))
            yield pa.RecordBatch.from_arrays([C.column(batch, c) for c in columns] + [pa.array(d), pa.array(n)],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, n0, n1) over rows (__text, __y): counted in each task, then added."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n0", T.LongType()), T.StructField("n1", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "__text"):
            codes, off, words = doc_words(C.texts(batch, "__text"))
            y = np.repeat(C.column(batch, "__y").to_numpy(), np.diff(off))
            n = [np.bincount(codes[y == c], minlength=len(words)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), *[pa.array(x.astype(np.int64)) for x in n]], names=schema.names)

    return rows.mapInArrow(run, schema).groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (__text, __y) with ``__fold``, by the least hash of the text's word n-grams."""
    schema = T.StructType([*rows.schema.fields, T.StructField("__fold", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "__text"):
            keys, off = shingle_sets(C.texts(batch, "__text"), FOLD_WORDS)
            least = np.append(keys, np.uint64(0))[off[:-1]]
            least[np.diff(off) == 0] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((mix(least) % np.uint64(FOLDS)).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "toxic", max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.
    Only labels whose id's crc32 (as text) is no multiple of 5 are learned from."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = C.drop_clashing(docs, OUT)
    given, docs = docs.columns, C.aside(docs, [id_col, text])
    known = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__key"))
                   .agg(F.max(label).cast("int").alias("__y")).where(C.fold("__key", FOLDS) != 0))
    known = C.written(known)
    given_of = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    few = None
    for c in (0, 1):  # at most max_docs rows each, so the sample may be broadcast
        own = known.where(F.col("__y") == c).orderBy(F.xxhash64("__key"), "__key").limit(max_docs)
        few = own if few is None else few.unionByName(own)
    few = C.written(few)
    sample = C.written(_dealt(docs.select(F.col(id_col).alias("__key"), C.text_or_empty(text).alias("__text"))
                              .join(F.broadcast(few), "__key").select("__text", "__y")))
    size = {(r[0], r[1]): r[2] for r in sample.groupBy("__y", F.col("__fold") == 1).count().collect()}
    of = lambda c: size.get((c, True), 0) + size.get((c, False), 0)
    if not of(0) or not of(1):
        share = F.lit(float(of(1) > 0))
        return docs.select("*", share.alias("score"), (share >= 0.5).cast("int").alias("predicted")).toDF(*given, *OUT)
    # a fold for the regression, unless a class would be missing on either side: then the
    # regression sees the counted rows themselves
    apart = all(size.get(k, 0) for k in ((0, True), (0, False), (1, True), (1, False)))
    counted, judged = (sample.where("__fold <> 1"), sample.where("__fold = 1")) if apart else (sample, sample)
    table = _word_counts(counted).toArrow().combine_chunks()  # bounded by the sample
    words = table.column("word").chunk(0).cast(pa.large_string()) if len(table) else pa.array([], pa.large_string())
    counts = np.stack([table.column(c).to_numpy() for c in ("n0", "n1")], 1)
    del table
    shared = _Shared(spark, KneserNey(C.compact(words), counts))
    del words, counts
    seen = _differences(judged, "__text", shared, ["__y"]).toPandas()
    y = seen["__y"].to_numpy()
    times = np.array([max(1.0, given_of.get(c, 0) / max_docs) for c in (0, 1)])[y]
    model = fit_logistic(features(seen["__d"].to_numpy(), seen["__n"].to_numpy()), y.astype(float), times=times)

    mean, scale, w = model
    rows = _differences(docs, text, shared, docs.columns)
    m = F.greatest(F.col("__n"), F.lit(1)).cast("double")
    x = [F.asinh(4 * F.col("__d") / m), F.asinh(F.col("__d") / F.sqrt(m)), F.log1p(F.col("__n").cast("double"))]
    z = F.lit(float(w[0]))
    for k in range(3):
        z = z + (x[k] - float(mean[k])) / float(scale[k]) * float(w[k + 1])
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))
    return rows.select(*[f"`{c}`" for c in docs.columns], score.alias("score"),
                       (score >= 0.5).cast("int").alias("predicted")).toDF(*given, *OUT)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", (C.fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
