"""Deleted interpolation (op5) against counts and EM on plain Python dictionaries."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorelens.llm import exchange, language_model
from scorelens.llm import common as C

from conftest import SF_SMALL


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) + ["\n"]


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def brute(docs, folds=10, steps=25):
    """(n_tokens, n_known, N, base, score) of every document."""
    own = [(fold(i, folds), tokens(t)) for i, t in docs]

    def counts(parts):
        uni, bi = Counter(), Counter()
        for w in parts:
            uni.update(w)
            bi.update(zip(["\n"] + w[:-1], w))
        return uni, bi

    uni, bi = counts([w for f, w in own if f])
    part, part_bi = counts([w for f, w in own if f > 1])
    n, v, pn, pv = sum(uni.values()), len(uni), sum(part.values()), len(part)
    bucket = lambda c: 0 if c == 0 else 1 + int(math.log2(c))
    held = Counter()
    for f, w in own:
        if f == 1:
            for a, b in zip(["\n"] + w[:-1], w):
                held[(bucket(part[a]), part_bi[a, b] / part[a] if part[a] else 0.0, part[b] / max(pn, 1))] += 1
    weights = {b: [1 / 3] * 3 for b in range(65)}
    weights[0] = [0.5, 0.5, 0.0]
    last = None
    for _ in range(steps):
        if not held:
            break
        got, ll = {}, 0.0
        for (b, p2, p1), k in held.items():
            m = [weights[b][0] / (pv + 1), weights[b][1] * p1, weights[b][2] * p2]
            s = sum(m)
            ll += k * math.log(s)
            r = got.setdefault(b, [0.0] * 3)
            for j in range(3):
                r[j] += k * m[j] / s
        pooled = [sum(r[j] for r in got.values()) for j in range(3)]
        weights = {b: [x / sum(pooled) for x in pooled] for b in range(65)}
        weights[0] = [pooled[0] / (pooled[0] + pooled[1]), pooled[1] / (pooled[0] + pooled[1]), 0.0]
        for b, r in got.items():
            weights[b] = [x / sum(r) for x in r]
        for b, w in weights.items():
            w[0] = max(w[0], 1e-9)
            weights[b] = [x / sum(w) for x in w]
        ll /= sum(held.values())
        if last is not None and ll - last < language_model.EM_TOLERANCE:
            break
        last = ll
    out = []
    for _, w in own:
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip(["\n"] + w[:-1], w):
            l0, l1, l2 = weights[bucket(uni[a])]
            score += math.log10(l0 / (v + 1) + l1 * uni[b] / max(n, 1) + (l2 * bi[a, b] / uni[a] if uni[a] else 0))
        out.append((len(w), sum(x in uni for x in w), n, base, score))
    return out


def compare(rows, docs):
    want = sorted((repr(i), *r) for (i, _), r in zip(docs, brute(docs)))
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-6)


def scored(docs):
    rest = C.fold("doc_id", 10)
    return language_model.lm_scores(docs, rest != 0, rest == 1)


def test_hard_documents_in_small_blocks(hard, monkeypatch):
    monkeypatch.setattr(exchange.blocks, "__defaults__", ("__text", "__rid", 2000))
    compare(scored(hard).collect(), [(r["doc_id"], r["text"]) for r in hard.collect()])


def test_query(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = language_model.op5_lm_scores(spark, SF_SMALL).collect()
    compare(rows, docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 10) == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # the mixture beats the base


def test_nothing_and_nothing_to_learn_from(spark, empty):
    assert scored(empty).count() == 0
    docs = spark.createDataFrame([(0, "some words"), (1, None)], "doc_id long, text string")
    rows = language_model.lm_scores(docs, F.lit(False), F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in rows)
