import pytest

import public_tokenizers
from pyspark.sql import types as T

# columns named like outputs and internal columns of the operators
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("keep_id", T.LongType()),
                       T.StructField("score", T.DoubleType()), T.StructField("__rid", T.LongType()),
                       T.StructField("__d", T.LongType()), T.StructField("spans", T.StringType())]) 
BASE = T.StructType(SCHEMA.fields[:5])

WORDS = [f"w{i * 7919 % 997}{'aeiou'[i % 5]}" for i in range(400)]
NEAR = " ".join(WORDS[:200])
LONG = " ".join(WORDS[i * 31 % 400] + str(i % 613) for i in range(30_000))
HARD = [
    (None, "a row without an id", None, None, None),
    (1, None, "en", "s", None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", None, 5),
    (4, "the same text twice", "en", "s", 19),
    (5, "the same text twice", None, "s", 19),
    (5, "the same text twice", None, "s", 19),
    (6, LONG, "en", "s", len(LONG)),
    (7, LONG, "en", "s", len(LONG)),
    (8, "Word", "en", "s", 4),
    (9, "word", "en", "s", 4),
    (10, "two words", "en", "s", 9),
    (11, NEAR, "en", "s", len(NEAR)),
    (12, NEAR + " more", "en", "s", len(NEAR) + 5),
    (13, NEAR.replace(WORDS[100], "other"), "en", "s", len(NEAR)),
    (14, "x" * 5000, "en", "s", 5000),
    (15, "mail a.b@mail1.example.com or +1 (017) 555-7713 é 97.51.17.173", "en", "s", 60),
    (16, "<|endoftext|> 　 \x85 </s> ▁ 日本語 ﬁ \x00", "en", "s", 20),
    (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with every odd case, and columns with clashing names."""
    rows = [(*r, 7, 0.5, 9, 3, "mine") for r in HARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def small_slices(monkeypatch):
    """Driver-side: batches are cut after few bytes (tasks run in other processes)."""
    from scorelens.llm import common
    monkeypatch.setattr(common, "SLICE_BYTES", 200)
