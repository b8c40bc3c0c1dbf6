"""Corpus preparation in stages: each stage reads what its predecessor kept.

Documents pass toxicity rejection, exact dedup, near dedup by the n-gram Jaccard
join, masking of personal data, and are packed into training sequences. Every stage
but the last returns the columns of the documents it got, under their names and in
their order, whatever they are called.

Defined cases: a document with a null or empty text is scored, deduplicated and
packed like any other (nulls and empty texts are equal for the exact stage, link
with nothing in the near stage); of repeated rows one is kept by the exact stage; null
ids come after all others when one of a group is chosen; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm import common as C
from scorelens.llm.exact_dedup import exact_dedup
from scorelens.llm.jaccard_join import drop_near
from scorelens.llm.packing import pack_documents
from scorelens.llm.personal_data import personal_data
from scorelens.llm.toxicity import score_toxicity

# the near stage works on five-word shingles and a similarity of 0.8 or more
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 8, 10


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    plain = C.aside(docs, ["doc_id", "text"])
    judged = score_toxicity(plain, C.table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").drop("score", "predicted").toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    plain = C.aside(docs, ["doc_id", "text"])
    return exact_dedup(plain).where("kept").select(*plain.columns).toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the document with the least id stays."""
    return drop_near(docs, n=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    out = personal_data(docs, replace=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece with its place and ids' checksum."""
    import public_tokenizers
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("personal_data", private_stage), ("packing", packing_stage)]

# training, graph components and packing have no SQL form: tests/llm holds brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = C.written(docs)
    return docs
