"""Ranked lexical search (op11)."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from scorelens.llm import lexical_search as S

from conftest import SF_CHECK

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items, k):
    """[(item, rank, doc_id, score)] from rows (doc_id, text) and (item_id, text)."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(x for _, c in own for x in c)
    out = []
    for item, text in items:
        q, rows = Counter(terms(text)), []
        for i, c in own:
            m = 75 + 25 * c.total() * N // max(L, 1)
            s = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * ((10 ** 9 * c[x]) // (1000 * c[x] + 12 * m))
                    for x, n in q.items() if c[x])
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return out


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({S.OP11_SQL})").fetchall()
    got = [tuple(r) for r in S.op11_ranked_search(spark, SF_CHECK).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    word = lambda: f"T{min(int(rng.zipf(1.3)), 300)}é"
    docs = [(int(i), " ".join(word() for _ in range(rng.integers(0, 60)))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (3, docs[3][1])]  # ties, a null and a repeated id
    items = [(k, " ".join(word() for _ in range(rng.integers(1, 12)))) for k in range(6)] + [(6, docs[7][1]), (7, None), (8, "- ."), (9, "absent")]
    got = S.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                          spark.createDataFrame(items, "item_id long, text string"), k=5, item_block=block).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute(docs, items, 5)))


@pytest.mark.parametrize("seed", range(4))
def test_tree_bounds_and_prunes(seed):
    rng = np.random.default_rng(seed)
    tf = np.where(rng.random((900, 40)) < np.linspace(0.9, 0.02, 40), rng.integers(1, 9, (900, 40)), 0).astype(np.int32)
    tf = tf[tf.any(1)]
    m, name = rng.integers(75, 400, len(tf)), rng.permutation(len(tf))
    w = np.where(rng.random((40, 12)) < 0.2, rng.integers(0, 9000, (40, 12)), 0).astype(float)
    tree, best = S.FPTree(tf, m, name), S.Best(12, 7)
    scored = S.search(tree, w, best)
    full = tree.scores(0, len(tf), w)
    for lo, hi in tree.children(0, len(tf)):
        assert (tree.bound(lo, hi, w) >= full[lo:hi].max(0)).all()
    for i in range(12):
        want = [x for x in np.lexsort((tree.name, -full[:, i]))[:7] if full[x, i] > 0]
        assert best.score[i, :len(want)].tolist() == full[want, i].tolist()
        assert best.name[i, :len(want)].tolist() == tree.name[want].tolist()
    assert scored <= len(tf)


def test_hard_documents(spark, hard):
    docs = [(r["doc_id"], r["text"]) for r in hard.collect()]
    items = [(1, "The SAME text twice"), (2, "日本語 é 7713"), (3, docs[7][1][:300]), (4, ""), (None, "word two")]
    got = S.ranked_search(hard, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute(docs, items, 20)))


def test_nothing(spark, empty, hard):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert S.ranked_search(empty, items).count() == 0
    none = S.ranked_search(hard, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
