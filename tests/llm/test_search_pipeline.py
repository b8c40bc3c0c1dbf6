"""Vector search (op8) and the pipeline."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from scorelens.llm import common as C
from scorelens.llm import vector_search as S

from conftest import SF_SMALL


def brute(rows, queries, k):
    """rows: (id, vector); nearest by (distance, id), the query's id left out."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
        out[q] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def collected(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return got


def test_recall_of_the_graph_on_many_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = S.build_index(df, shard_rows=800)
    assert index.count() == 4
    got = collected(S.search_index(index, S.usable(df, "vec_id", "embedding").where("id % 50 = 0")))
    want = brute(rows, rows[::50], 10)
    found = 0
    for q, near in want.items():
        exact = dict(near)
        assert len(got[q]) == 10
        for _, i, s in got[q]:
            assert s == pytest.approx(float(np.linalg.norm(np.array(rows[i][1]) - np.array(rows[q][1]))), abs=1e-12)
            found += i in exact
    assert found / (10 * len(want)) >= 0.95


def test_query_recall(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = collected(S.op8_vector_search(spark, SF_SMALL))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hits / (10 * len(want)) >= 0.9


def test_odd_vectors_ties_and_repeated_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 60)] + [(100, [1.0, 2.5]), (101, [float("nan"), 1.0]), (102, None), (103, [0.0, 0.0]),
            (104, [1.0, None]), (105, [float("inf"), 1.0]), (None, same), (106, [3.0, 4.0, 5.0]), (5, same), (100, [1.0, 2.5]), (107, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, query_id string")
    index = S.build_index(df, shard_rows=20)
    got = collected(S.search_index(index, S.usable(df, "vec_id", "embedding").where("id in (0, 7, 100, 101, 102, 103, 106)")))
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]  # ties to the smaller id, rows as often as they are
    assert [i for _, i, _ in got[7]] == [0, 1, 2, 3, 4, 5, 5, 6, 8, 9]
    assert [i for _, i, _ in got[100]] == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8] and got[100][0][2] == 0.5
    assert not {101, 102, 103, 106} & set(got)  # no part, or nothing of its length beside it


def test_nothing_to_search(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = S.build_index(df)
    assert S.search_index(index, S.usable(df, "vec_id", "embedding")).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert S.search_index(S.build_index(one), S.usable(one, "vec_id", "embedding")).count() == 0


DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.LongType()),
                    T.StructField("__rid", T.LongType())])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic, repeated, near and private documents with labels, as given tables."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 900, n)]
    rows, labels = [], []
    for i in range(300):
        w = word(60)
        toxic = i % 4 == 0
        if toxic:
            for k in range(0, 60, 6):
                w[k] = ["idiot", "scum", "moron"][k % 3]
        rows.append((i, " ".join(w)))
        if i < 260:
            labels.append((i, int(i % 9 > 0), int(toxic)))
    clean = next(t for i, t in rows if i == 1)
    rows += [(400, clean), (401, clean), (402, clean.replace("w", "w", 1) + " more"), (403, None), (404, ""), (405, None),
             (406, "mail a.b@mail1.example.com now " + " ".join(word(30))), (None, "without an id " + " ".join(word(30)))]
    path = tmp_path_factory.mktemp("corpus")
    table = [(i, t, "en", "s", None if t is None else len(t), 3, 4) for i, t in rows]
    spark.createDataFrame(table, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_stages(spark, corpus):
    docs = C.table(spark, corpus, "documents")
    cols, left = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = C.written(stage(spark, docs, corpus))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == cols
            assert out.agg(F.min("score"), F.max("__rid")).first() == (3, 4)
            left[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        docs = out
    assert not any(i is not None and i < 300 and i % 4 == 0 for i in left["toxicity"])  # toxic ones go
    assert sum(i is not None and i < 300 for i in left["toxicity"]) == 225  # clean ones stay
    exact = left["exact_dedup"]
    assert 401 in exact and not {1, 400} & set(exact) and len({403, 404, 405} & set(exact)) == 1 and 405 in exact
    near = left["near_dedup"]
    assert 401 in near and 402 not in near and None in near
    private = left["personal_data"]
    assert private[406].startswith("mail [EMAIL] now")
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(private)
    size = defaultdict(int)
    for r in pieces:
        size[r["sequence_id"]] += r["length"]
    assert max(size.values()) <= 1024 and len(size) <= sum(size.values()) / 1024 + 2


def test_pipeline_runs_as_a_query_and_on_nothing(spark, corpus, tmp_path):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
