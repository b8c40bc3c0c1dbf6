"""MinHash near-dedup by an LSH forest (op13), and the comparison within clusters."""

import random

import duckdb
import numpy as np
import pytest

from scorelens.llm import jaccard_join, minhash_forest as M
from scorelens.llm.clusters import Limits
from scorelens.llm.components import components, least_nodes
from scorelens.llm.jaccard_join import Share

from conftest import SF_SMALL
from .test_dedup import brute, mixed_corpus, sets_of

TIGHT = Limits(small=12, chunk=8, pivots=3, more=5, weight=4000)


def check(rows, texts, n, num, den):
    sets = sets_of(texts, n)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in enumerate(sets)}
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(brute(sets, num, den)))


@pytest.mark.parametrize("n,num,den,hot,limits,region", [(3, 85, 100, 0, M.LIMITS, M.REGION), (5, 8, 10, 200, TIGHT, 4), (3, 85, 100, 300, TIGHT, M.REGION)])
def test_components_of_all_pairs(spark, n, num, den, hot, limits, region):
    texts = mixed_corpus(n + hot, hot)
    rows = M.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=n, num=num, den=den,
                             limits=limits, region=region).collect()
    check(rows, texts, n, num, den)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("hot", [150, 300])
def test_trees_over_several_pivot_rounds(spark, hot):
    """The Jaccard join with clusters far beyond one task's limit."""
    texts = mixed_corpus(hot, hot)
    rows = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limits=TIGHT).collect()
    check(rows, texts, 3, 9, 10)


@pytest.mark.parametrize("name,num,den", [("forest", 85, 100), ("join", 9, 10)])
def test_queries_against_brute_force(spark, name, num, den):
    query = M.op13_minhash_forest if name == "forest" else jaccard_join.op7_jaccard_join
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    rows = query(spark, SF_SMALL).collect()
    sets = sets_of([t for _, t in docs], 3)
    root = brute(sets, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {
        d[0]: (len(s), docs[k][0]) for d, s, k in zip(docs, sets, root)}
    assert len(rows) == len(docs)


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        y = np.concatenate([x[:340], rng.integers(0, 1 << 63, 60).astype(np.uint64)])
        s = M.signatures(np.concatenate([x, y]), np.array([0, 400, 800]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 340 / 460) < 0.02
    assert M.signatures(np.empty(0, np.uint64), np.array([0, 0])).shape == (1, M.TREES * M.PREFIX)


def test_least_agreeing_is_the_tail():
    from math import comb
    k = M.least_agreeing(0.85)
    tail = [sum(comb(M.SKETCH, j) * 0.85 ** j * 0.15 ** (M.SKETCH - j) for j in range(x)) for x in (k, k + 1)]
    assert tail[0] <= M.LOST < tail[1]


@pytest.mark.parametrize("most", [3, 20, 1000])
def test_split_regions_keep_near_rows_together(most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 256, (5, M.SKETCH), dtype=np.uint8)
    own = rng.integers(0, 5, 200)
    sketch = base[own]
    sketch[np.arange(200), rng.integers(30, M.SKETCH, 200)] = 7
    order = np.lexsort(sketch.T[::-1])
    label = M.region_groups(sketch[order], np.full(200, 100), Share(85, 100), 30, most)
    assert len({(a, b) for a, b in zip(label.tolist(), own[order].tolist())}) == 5


@pytest.mark.parametrize("seed", range(5))
def test_split_regions_find_the_same_groups(seed):
    rng = np.random.default_rng(seed)
    sketch = rng.integers(0, 3, (300, M.SKETCH), dtype=np.uint8)
    sketch = sketch[np.lexsort(sketch.T[::-1])]
    n = rng.integers(50, 70, 300)
    whole, split = M.near_groups(sketch, n, Share(85, 100), 25), M.region_groups(sketch, n, Share(85, 100), 25, 6)
    assert len(set(zip(whole.tolist(), split.tolist()))) == len(set(whole.tolist())) == len(set(split.tolist()))
    assert 5 < len(set(whole.tolist())) < 295


@pytest.mark.parametrize("seed", range(6))
def test_confirmed_links_connect_what_links_connect(seed):
    random.seed(seed)
    sets = [np.array(sorted(x), np.uint64) for x in (
        {random.choice((0, 1000, 5000)) + random.randrange(60) for _ in range(random.randint(1, 200))} for _ in range(120))]
    got = M.confirmed(list(enumerate(sets[:70])), list(zip(range(70, 120), sets[70:])), Share(8, 10))
    want = brute([set(s.tolist()) for s in sets], 8, 10)
    assert len(got) == len(sets) - len(set(want))
    assert all(want[a] == want[b] for a, b in got)


def test_least_nodes_and_contraction_rounds(spark):
    random.seed(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2001, 2000)]
    random.shuffle(edges)
    node, root = least_nodes(*np.array(edges).T)
    assert set(zip(node.tolist(), root.tolist())) >= {(300, 0), (1199, 1000), (2001, 2000)} and set(root.tolist()) == {0, 1000, 2000}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), local_edges=20).collect()}
    assert set(got) == set(node.tolist()) and len({got[i] for i in range(301)}) == 1 and len(set(got.values())) == 3


def test_hard_documents(hard, empty):
    docs = hard.collect()
    rows = M.near_duplicates(hard, n=3, num=85, den=100).collect()
    sets = sets_of([r["text"] for r in docs], 3)
    assert sorted((repr(r["doc_id"]), r["n_shingles"]) for r in rows) == sorted((repr(d["doc_id"]), len(s)) for d, s in zip(docs, sets))
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    assert (comp[4], comp[5], comp[6], comp[7], comp[8], comp[9], comp[11], comp[12], comp[13]) == (4, 4, 6, 6, 8, 8, 11, 11, 11)
    assert all(comp[i] == i for i in (1, 2, 3, 10, 14, 15, 16)) and comp[None] is None
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert M.near_duplicates(empty).count() == 0
