"""Exact dedup (op4), the n-gram Jaccard join (op7) and graph components."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from scorelens.llm import exact_dedup, jaccard_join
from scorelens.llm.components import components
from scorelens.llm.jaccard_join import PrefixTree, Share, tree_links

from conftest import SF_SMALL


def test_exact_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({exact_dedup.OP4_SQL})").fetchall()
    got = [tuple(r) for r in exact_dedup.op4_exact_dedup(spark, SF_SMALL).select(cols).collect()]
    assert sorted(got) == sorted(want)


def test_exact_hard_documents(hard):
    rows = exact_dedup.exact_dedup(hard, first_digit=4).collect()
    groups = defaultdict(list)
    for r in hard.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(rows) == sum(map(len, groups.values()))
    for r in rows:
        own = groups[r["text"] or ""]
        assert r["group_size"] == len(own)
        assert r["keep_id"] == max((i for i in own if i is not None), default=None)
        assert (r["__rid"], r["score"], r["spans"]) == (9, 0.5, "mine")  # other columns as they were
    assert Counter(r["text"] or "" for r in rows if r["kept"]) == Counter(list(groups))
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_prefixes_are_not_equal(spark):
    texts = ["a" * n for n in range(0, 70)] + ["a" * 68, "a" * 64 + "b", "a" * 64 + "b", "é", "é"]
    rows = exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), first_digit=8).collect()
    size = Counter(texts)
    assert all(r["group_size"] == size[texts[r["doc_id"]]] for r in rows)


def test_exact_nothing(empty):
    out = exact_dedup.exact_dedup(empty)
    assert out.count() == 0 and out.columns == [c for c in empty.columns if c != "keep_id"] + exact_dedup.OUT


def test_components_of_chains_and_stars(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 300)] + [(500, 500), (601, 600), (602, 601)]
    random.shuffle(edges)
    got = defaultdict(set)
    for node, root in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[root].add(node)
    assert sorted(map(sorted, got.values())) == [list(range(0, 41)), list(range(100, 300)), [600, 601, 602]]


def sets_of(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(sets, num=9, den=10):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(5))
def test_prefix_tree_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    share = Share(8, 10)
    base = [rng.choice(10_000, rng.integers(5, 60), replace=False) for _ in range(6)]
    sets = []
    for _ in range(80):
        b = list(base[rng.integers(6)])
        for _ in range(rng.integers(0, 4)):
            b[rng.integers(len(b))] = int(rng.integers(10_000))
        sets.append(np.array(sorted(set(map(int, b)), reverse=True), np.uint64))
    tree = PrefixTree(sets)
    for k, s in enumerate(sets):
        want = {j for j, y in enumerate(sets) if share.linked(len(set(s) & set(y)), len(s), len(y))}
        assert set(tree.matches(np.sort(s), share)) == want
    links = tree_links(list(enumerate(sets)), list(enumerate(sets)), share)
    assert len(links) == len(sets) - len(set(brute([set(s.tolist()) for s in sets], 8, 10)))


def mixed_corpus(seed, hot=0):
    """Unrelated texts, near copies in chains, common passages, and one large group."""
    random.seed(seed)
    word = lambda: f"w{random.randint(0, 3000)}"
    common = [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(random.randint(0, 120))) for _ in range(60)]
    for _ in range(12):
        t = [word() for _ in range(random.randint(30, 150))]
        for _ in range(random.randint(1, 6)):
            texts.append(" ".join(t))
            for _ in range(random.randint(0, 2)):
                t[random.randrange(len(t))] = word()
    texts += [" ".join([word() for _ in range(random.randint(1, 40))] + common) for _ in range(20)]
    big = [word() for _ in range(150)]
    for _ in range(hot):
        t = list(big)
        for _ in range(random.randint(0, 3)):
            t[random.randrange(len(t))] = word()
        texts.append(" ".join(t))
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("n,num,den,hot", [(3, 9, 10, 260), (5, 8, 10, 0)])
def test_join_finds_the_components_of_all_pairs(spark, n, num, den, hot):
    texts = mixed_corpus(n, hot)
    rows = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                           n=n, num=num, den=den).collect()
    sets = sets_of(texts, n)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in enumerate(sets)}
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(brute(sets, num, den)))


def test_join_hard_documents(hard):
    rows = jaccard_join.jaccard_components(hard).collect()
    docs = hard.collect()
    sets = sets_of([r["text"] for r in docs], 3)
    assert sorted((repr(r["doc_id"]), r["n_shingles"]) for r in rows) == sorted((repr(d["doc_id"]), len(s)) for d, s in zip(docs, sets))
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    assert (comp[4], comp[5], comp[6], comp[7], comp[8], comp[9], comp[11], comp[12], comp[13]) == (4, 4, 6, 6, 8, 8, 11, 11, 11)
    assert all(comp[i] == i for i in (1, 2, 3, 10, 14, 15, 16)) and comp[None] is None


def test_near_drop_keeps_one_of_each_group(hard, empty):
    rows = jaccard_join.drop_near(hard)
    assert rows.columns == hard.columns
    left = rows.collect()
    ids = Counter(r["doc_id"] for r in left)
    assert {4, 6, 8, 11} <= set(ids) and not {7, 9, 12} & set(ids) and ids[5] == 0 and ids[None] == 2
    assert all((r["__rid"], r["spans"]) == (9, "mine") for r in left)
    assert jaccard_join.drop_near(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
