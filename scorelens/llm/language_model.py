"""Language-model scores by deleted interpolation.

P(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1)

over words and an end of text, v being the word before (the end mark before the
first word). The maximum-likelihood estimates are mixed by weights that depend on
the bucket b of the context's frequency (0: unseen; k: 2^(k-1) <= c(v) < 2^k). The
weights are learned by expectation-maximisation: the counts of all learning
documents but one fold are the estimates, the deleted fold's tokens the held-out
counts that are predicted. Scores then use the counts of all learning documents.
All unseen words share the mass of one.

Counts cover every learning document: see ``exchange`` for how they are gathered and
handed back. A step of the EM is one map-side combined aggregation over the table of
held-out counts, with at most 65 x 3 weights in the query.

Defined cases: null and empty texts are the end alone; repeated rows count and are
scored as often as they occur; without learning documents every count is 0 and the
weights are those of the bucket 0; an empty table gives no rows; other columns than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm import common as C
from scorelens.llm import exchange as X
from scorelens.llm.words import chain_keys, doc_words, from_planes, keys_of, planes

BUCKETS = 65
EM_STEPS = 25
EM_TOLERANCE = 1e-6
_END_KEY = np.uint64(0x0E0D0C0B0A090807)


def with_ends(codes: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """The words of all texts with an end after each text."""
    n = len(offsets) - 1
    out = np.empty(len(codes) + n, np.int64)
    ends = offsets[1:] + np.arange(n)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = codes, end
    return out


class BlockKeys:
    """The distinct words and word pairs of a block as ascending 64-bit keys
    (lowest bit 0: word, 1: pair), and where each token's are."""

    def __init__(self, w: np.ndarray, word_keys: np.ndarray):
        end = len(word_keys) - 1
        v = np.empty_like(w)
        v[:1], v[1:] = end, w[:-1]  # the token before the first word of a text is an end
        pairs, pair = np.unique(v * len(word_keys) + w, return_inverse=True)
        words = word_keys & ~np.uint64(1)
        both = chain_keys(word_keys[pairs // len(word_keys)], word_keys[pairs % len(word_keys)]) | np.uint64(1)
        keys = np.concatenate([words, both])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys = keys[order]
        self.word, self.before, self.pair = place[w], place[v], place[len(words) + pair]

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each key occurs among the tokens ``of`` (a mask)."""
        return np.bincount(self.word[of], minlength=len(self.keys)) + np.bincount(self.pair[of], minlength=len(self.keys))


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2 c)."""
    return np.frexp(c.astype(np.float64))[1].astype(np.int64)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """w (tokens with ends), tokens per document, fold per token, keys of the words and of the end."""
    text = table.column("__text").combine_chunks()
    text = C.compact(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
    codes, offsets, words = doc_words(text)
    w = with_ends(codes, offsets, len(words))
    size = np.diff(offsets) + 1
    fold = np.repeat(table.column("__fold").to_numpy(), size)
    return w, size, fold, np.append(keys_of(words), _END_KEY)


def _stats(keys: np.ndarray, totals: list[np.ndarray]) -> list[int]:
    word = (keys & np.uint64(1)) == 0
    return [x for t in totals for x in (np.count_nonzero(t[word]), t[word].sum())]


def learn_weights(held: DataFrame, n_tokens: int, n_words: int, steps: int = EM_STEPS,
                  tolerance: float = EM_TOLERANCE) -> np.ndarray:
    """EM over held-out counts (b, c2, cv, c1, n). Returns weights [bucket, (l0, l1, l2)]."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0.5, 0.5, 0.0]
    p2 = F.when(F.col("cv") > 0, F.col("c2") / F.col("cv")).otherwise(F.lit(0.0))
    p1 = F.col("c1") / F.lit(float(max(n_tokens, 1)))
    t = held.select("b", "n", p2.alias("p2"), p1.alias("p1"), F.lit(1.0 / (n_words + 1)).alias("p0"))
    last = None
    for _ in range(steps):
        of = lambda k: F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("b").cast("int") + 1)
        parts = t.select("b", "n", *[(of(k) * F.col(f"p{k}")).alias(f"m{k}") for k in range(3)])
        total = F.col("m0") + F.col("m1") + F.col("m2")
        got = (parts.groupBy("b").agg(*[F.sum(F.col("n") * F.col(f"m{k}") / total).alias(f"r{k}") for k in range(3)],
                                      F.sum(F.col("n") * F.log(total)).alias("ll"), F.sum("n").alias("n")).collect())
        if not got:
            return weights
        pooled = np.array([[r["r0"], r["r1"], r["r2"]] for r in got]).sum(0)
        fresh = np.tile(pooled / pooled.sum(), (BUCKETS, 1))  # contexts that no held-out text has
        fresh[0] = [*(pooled[:2] / max(pooled[:2].sum(), 1e-300)), 0.0]
        for r in got:
            m = np.array([r["r0"], r["r1"], r["r2"]])
            fresh[r["b"]] = m / m.sum()
        weights = np.maximum(fresh, [1e-9, 0, 0])  # an unseen word is never impossible
        weights /= weights.sum(1, keepdims=True)
        ll = sum(r["ll"] for r in got) / sum(r["n"] for r in got)
        if last is not None and ll - last < tolerance:
            break
        last = ll
    return weights


def lm_scores(docs: DataFrame, learn, held, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Score whole texts. ``learn``: column, true for the documents learned from;
    ``held``: true for those of them that the mixture weights are learned on.
    One row per document: id, n_tokens, n_known, train_tokens, base_score, score
    (log10 probability), bits_per_token."""
    spark = docs.sparkSession
    C.prepare(spark)
    parts = C.partitions(spark)
    n_buckets = 2 * parts
    fold = F.when(learn & held, 1).when(learn, 2).otherwise(0).cast("byte")
    src = C.with_row_ids(docs.select(F.col(id_col).alias("__id"), C.text_or_empty(text).alias("__text"), fold.alias("__fold")))

    def send(batches):
        for block, table in X.blocks(batches):
            w, _, fold, word_keys = _block(table)
            k = BlockKeys(w, word_keys)
            yield X.requests(block, k.keys, [k.counts(fold > 0), k.counts(fold > 1)], n_buckets)

    sent = src.select("__rid", "__text", "__fold").mapInArrow(send, X.request_schema(2))
    answers = C.written(X.merged(sent, 2, parts, 4, _stats))
    v_all, n_all, v_part, n_part = (int(x or 0) for x in answers.where("block IS NULL").agg(
        *[F.sum(f"s{i}") for i in range(4)]).first())

    # held-out counts: the tokens of the deleted fold with the other folds' counts
    held_schema = T.StructType([T.StructField("block", T.LongType())]
                               + [T.StructField(c, T.BinaryType()) for c in ("pair", "before", "word")])

    def send_held(batches):
        for block, table in X.blocks(batches):
            w, _, fold, word_keys = _block(table)
            k, of = BlockKeys(w, word_keys), fold == 1
            if of.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64())] + [pa.array([planes(x[of], 4)], pa.binary()) for x in (k.pair, k.before, k.word)],
                    names=held_schema.names)

    counted = T.StructType([T.StructField(c, T.LongType()) for c in ("b", "c2", "cv", "c1", "n")])

    def count_held(batches):
        for row, (part,) in X.by_block(batches, 1):
            c2, cv, c1 = (part[from_planes(C.column(row, c)[0].as_py(), 4)].astype(np.int64) for c in ("pair", "before", "word"))
            order = np.lexsort((c2, c1, cv))
            c2, cv, c1 = c2[order], cv[order], c1[order]
            new = np.flatnonzero(np.append(True, (c2[1:] != c2[:-1]) | (cv[1:] != cv[:-1]) | (c1[1:] != c1[:-1])))
            cols = [frequency_bucket(cv[new]), c2[new], cv[new], c1[new], np.diff(np.append(new, len(c2)))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=counted.names)

    part_only = answers.select("block", "bucket", F.col("c1").alias("c0"))
    payload = src.select("__rid", "__text", "__fold").mapInArrow(send_held, held_schema).select(
        "*", F.lit(None).cast("int").alias("bucket"))
    held_counts = C.written(X.answered(payload, part_only, 1, parts).mapInArrow(count_held, counted))
    weights = learn_weights(held_counts, n_part, v_part)

    # scores: each block's tokens meet the totals of all learning documents
    id_type = docs.schema[id_col].dataType
    text_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                                T.StructField("size", T.BinaryType()), T.StructField("w", T.BinaryType()),
                                T.StructField("word_keys", T.BinaryType())])

    def send_text(batches):
        for block, table in X.blocks(batches):
            w, size, _, word_keys = _block(table)
            ids = table.column("__id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([planes(size, 4)], pa.binary()), pa.array([planes(w, 4)], pa.binary()),
                 pa.array([planes(word_keys, 8)], pa.binary())], names=text_schema.names)

    out = T.StructType([T.StructField(id_col, id_type)]
                       + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
                       + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "bits_per_token")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, (count,) in X.by_block(batches, 1):
            size = from_planes(C.column(row, "size")[0].as_py(), 4).astype(np.int64)
            k = BlockKeys(from_planes(C.column(row, "w")[0].as_py(), 4).astype(np.int64),
                          from_planes(C.column(row, "word_keys")[0].as_py(), 8))
            if len(count) != len(k.keys):
                raise RuntimeError("a block came out differently on its second reading")
            c2, cv, c1 = (count[x].astype(np.float64) for x in (k.pair, k.before, k.word))
            l = weights[frequency_bucket(cv)]
            p = (l[:, 2] * (c2 / np.maximum(cv, 1)) + l[:, 1] * (c1 / max(n_all, 1)) + l[:, 0] / (v_all + 1))
            base = np.log10((c1 + 0.1) / (n_all + 0.1 * (v_all + 1)))
            starts = np.cumsum(size) - size
            total = np.add.reduceat(np.log10(p), starts)
            cols = [C.column(row, "ids").flatten(), pa.array(size), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(size), n_all)), pa.array(np.add.reduceat(base, starts)), pa.array(total),
                    pa.array(-total * np.log2(10) / size)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    payload = src.select("__rid", "__id", "__text", "__fold").mapInArrow(send_text, text_schema).select(
        "*", F.lit(None).cast("int").alias("bucket"))
    return X.answered(payload, answers.select("block", "bucket", "c0"), 1, parts).mapInArrow(score, out)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = C.fold("doc_id", 10)
    out = lm_scores(docs, rest != 0, rest == 1)
    return out.select("doc_id", (C.fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score", "bits_per_token")
