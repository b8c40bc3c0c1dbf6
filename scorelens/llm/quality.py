"""Quality by ordinal cumulative-link regression on hashed text.

P(grade <= k | text) = 1 / (1 + exp(w . x - t_k)) with one weight vector w for all
grades and ordered thresholds t_0 < t_1 < ... . x is the mean over a text's words of
hashed indicators: the word itself and its shape (runs of small letters, capitals,
digits and each other character). The model gives every text an expected grade and
the probability of at least the wanted grade, by which texts are selected.

It is fitted on at most ``MAX_DOCS`` rated texts (those with the least hashes of their
id; ids whose crc32 as text is a multiple of 5 are held out): their hashed counts are
made in the tasks, the fit itself is a small optimisation on the driver, whose size
this bound and ``DIM`` limit. Whole texts are hashed and scored in the tasks.

Defined cases: null and empty texts have x = 0; repeated rows are scored each; null
ratings teach nothing (of a document's ratings the least counts); with one grade only
every text has it; without ratings the grade and the probability are null and every
text is kept; an empty table gives no rows; input columns named like the output are
replaced. More than ``MAX_GRADES`` distinct ratings raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm.words import keys_of, mix

DIM = 1 << 17
MAX_DOCS = 20_000
MAX_GRADES = 32
FOLDS = 5
OUT = ["expected_grade", "tail_probability", "predicted_grade", "kept"]
_RUNS = [(re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[0-9]+"), "0")]


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each."""
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word[:16]


class WordHasher:
    """Hash numbers of words and of their shapes; remembers the words it has met."""

    REMEMBERED = 500_000

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.known, self.numbers = pa.array([], pa.large_string()), np.empty((0, 2), np.int64)

    def hashed(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code per word, numbers [distinct words, 2], offsets of the texts)."""
        lists = pc.ascii_split_whitespace(text)
        flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        there = pc.not_equal(pc.binary_length(flat), 0)
        kept = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
        coded = flat.filter(there).dictionary_encode()
        words = coded.dictionary
        if len(self.known) > self.REMEMBERED or self.known.nbytes > C.REMEMBERED_BYTES:
            self.__init__(self.dim)
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        numbers = np.zeros((len(words), 2), np.int64)
        numbers[at >= 0] = self.numbers[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            own = keys_of(pc.ascii_lower(C.compact(fresh))) % np.uint64(self.dim)
            shapes = keys_of(pa.array([shape(w) for w in fresh.to_pylist()], pa.large_string()))
            numbers[new, 0], numbers[new, 1] = own, mix(shapes) % np.uint64(self.dim)
            self.known = pa.concat_arrays([self.known, fresh])
            self.numbers = np.concatenate([self.numbers, numbers[new]])
        return coded.indices.to_numpy(zero_copy_only=False), numbers, kept[off - off[0]]


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, n_grades: int, dim: int = DIM,
                epochs: int = 12, batch: int = 256, rate: float = 2.0, l2: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by AdaGrad on the cumulative-link likelihood. rows: the
    numbers and shares of each text's features; grade: 0 .. n_grades - 1."""
    share = np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / len(grade)
    t = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    w, seen_w, seen_t = np.zeros(dim), np.full(dim, 1e-6), np.full(len(t), 1e-2)
    rng = np.random.default_rng(0)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            ids = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            s = np.bincount(doc, w[ids] * val, len(pick))
            y = grade[pick]
            edge = np.concatenate([[-np.inf], t, [np.inf]])
            hi, lw = sigmoid(edge[y + 1] - s), sigmoid(edge[y] - s)
            hi[y == n_grades - 1], lw[y == 0] = 1, 0
            p = np.maximum(hi - lw, 1e-9)
            up, down = hi * (1 - hi) / p, lw * (1 - lw) / p  # d log p / d upper, - d lower threshold
            slope = down - up  # d log p / d s
            g = np.bincount(ids, (slope[doc] * val), dim) / len(pick) - l2 * w
            seen_w += g * g
            w += 0.25 * rate * g / np.sqrt(seen_w)
            gt = (np.bincount(y, up, n_grades)[:-1] - np.bincount(y, down, n_grades)[1:]) / len(pick)
            seen_t += gt * gt
            t = np.sort(t + 0.05 * rate * gt / np.sqrt(seen_t))
    return w, t


def _sparse(hasher: WordHasher, text: pa.LargeStringArray) -> list[tuple[bytes, bytes]]:
    codes, numbers, off = hasher.hashed(text)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        ids, count = np.unique(numbers[codes[a:b]].ravel(), return_counts=True)
        out.append((ids.astype("<i4").tobytes(), (count / max(1, b - a)).astype("<f4").tobytes()))
    return out


def grade_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text: str = "text", rating: str = "quality",
                  want: float | None = None, keep_at: float = 0.5, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of at least ``want``, by
    default the second lowest grade: better than the worst), ``predicted_grade``
    (likeliest) and ``kept`` (tail probability of ``keep_at`` or more)."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = C.drop_clashing(docs, OUT)
    given, docs = docs.columns, C.aside(docs, [id_col, text])
    known = (ratings.where(F.col(rating).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__key"))
                    .agg(F.min(rating).cast("double").alias("__y")).where(C.fold("__key", FOLDS) != 0))
    few = C.written(known.orderBy(F.xxhash64("__key"), "__key").limit(max_docs))  # so it may be broadcast
    sample = docs.select(F.col(id_col).alias("__key"), C.text_or_empty(text).alias("__text")).join(F.broadcast(few), "__key")
    schema = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("val", T.BinaryType())])

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in C.slices(batches, "__text"):
            rows = _sparse(hasher, C.texts(batch, "__text"))
            yield pa.RecordBatch.from_arrays([C.column(batch, "__y"), pa.array([r[0] for r in rows], pa.binary()),
                                              pa.array([r[1] for r in rows], pa.binary())], names=schema.names)

    got = sample.select("__text", "__y").mapInArrow(hash_rows, schema).collect()  # at most max_docs small rows
    got.sort(key=lambda r: (r["y"], bytes(r["ids"])))
    grades = sorted({r["y"] for r in got})
    if len(grades) > MAX_GRADES:
        raise ValueError(f"{len(grades)} different ratings; at most {MAX_GRADES} grades")
    null = F.lit(None).cast("double")
    if not grades:
        return docs.select("*", null.alias("expected_grade"), null.alias("tail_probability"),
                           null.alias("predicted_grade"), F.lit(True).alias("kept")).toDF(*given, *OUT)
    want = want if want is not None else grades[min(1, len(grades) - 1)]
    if len(grades) == 1:
        tail = F.lit(float(grades[0] >= want))
        return docs.select("*", F.lit(grades[0]).alias("expected_grade"), tail.alias("tail_probability"),
                           F.lit(grades[0]).alias("predicted_grade"), (tail >= keep_at).alias("kept")).toDF(*given, *OUT)
    rows = [(np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["val"], "<f4").astype(np.float64)) for r in got]
    weights, cuts = fit_ordinal(rows, np.searchsorted(grades, [r["y"] for r in got]), len(grades))
    shared = spark.sparkContext.broadcast(weights)  # DIM numbers

    out = T.StructType(list(docs.schema) + [T.StructField("__s", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = shared.value, WordHasher()
        for batch in C.slices(batches, text):
            codes, numbers, off = hasher.hashed(C.texts(batch, text))
            run = np.append(0, np.cumsum(w[numbers].sum(1)[codes])) if len(codes) else np.zeros(1)
            s = (run[off[1:]] - run[off[:-1]]) / np.maximum(np.diff(off), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=out.names)

    scored = docs.mapInArrow(score, out)
    upto = [1 / (1 + F.exp(F.col("__s") - float(c))) for c in cuts] + [F.lit(1.0)]
    each = [upto[0]] + [upto[k] - upto[k - 1] for k in range(1, len(grades))]
    expected = sum((p * g for p, g in zip(each[1:], grades[1:])), each[0] * grades[0])
    below = sum(1 for g in grades if g < want)
    tail = F.lit(1.0) - upto[below - 1] if below else F.lit(1.0)
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(float(g)).alias("g")) for p, g in zip(each, grades)]))["g"]
    return scored.select(*[f"`{c}`" for c in docs.columns], expected.alias("expected_grade"), tail.alias("tail_probability"),
                         best.alias("predicted_grade"), (tail >= keep_at).alias("kept")).toDF(*given, *OUT)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = grade_quality(docs, C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", (C.fold("doc_id", FOLDS) == 0).alias("held_out"), *OUT)
