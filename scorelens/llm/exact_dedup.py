"""Exact deduplication by distributed most-significant-digit radix partitioning.

A text is read as a byte string and cut into digits: bytes 0..63, the next 256,
the next 1024 and so on (each level's digit is four times as wide, so a text of L
bytes has about log4(L / 64) levels). Level by level every still undecided document is
put into the group of its parent group and its next digit:

* a group of one document is finished - nothing equals it;
* a group whose texts *ended* with this digit holds equal texts - finished;
* any other group is split again by the next digit.

Equality is decided by the bytes alone, no digest is involved. A level is one
map-side combined aggregation over (parent group, digit, ended) - a group with a
third of all rows shrinks to one row per map task before the shuffle - and one
salted join that hands the groups back to their documents. The joins are sort-merge
joins at every size (their sides grow with the documents). Only documents that share
their first digit with another one carry their text beyond level 0.

Defined cases: null text equals the empty text; all empty texts are one group;
a repeated row (same id and text) is a member like any other, exactly one row of
a group is kept (largest id, then the first row read); null ids rank lowest; an
empty table gives an empty result; input columns named ``keep_id``,
``group_size`` or ``kept`` are replaced by the operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm import common as C

FIRST_DIGIT = 64
WIDER = 4
SALTS = 16
OUT = ["keep_id", "group_size", "kept"]


def _split(rows: DataFrame, salts: int) -> DataFrame:
    """One level: rows (rid, id, gid, digit, ended) -> the rows of groups with more
    than one member: (rid, gid, ended, best id, best rid, size)."""
    keys = ["__gid", "__digit", "__ended"]
    groups = (rows.groupBy(*keys)
                  .agg(F.count(F.lit(1)).alias("__n"), F.min("__rid").alias("__new"),
                       F.max(F.struct(F.col("__id"), (-F.col("__rid")).alias("neg"))).alias("__best"))
                  .where("__n > 1")
                  .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"),
                          "__n", "__new", "__best"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__rid"), F.lit(salts)).cast("int"))
    # the parent group is null-free (0 at the root), digits are never null
    return (salted.join(groups.hint("merge"), [*keys, "__salt"])
                  .select("__rid", F.col("__new").alias("__gid"), "__ended", "__n",
                          F.col("__best.__id").alias("__keep"), (-F.col("__best.neg")).alias("__keep_rid")))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                first_digit: int = FIRST_DIGIT, salts: int = SALTS) -> DataFrame:
    """``docs`` with ``keep_id`` (id of the row of its group that stays),
    ``group_size`` and ``kept`` for every row."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = C.drop_clashing(docs, OUT)
    src = C.with_row_ids(C.aside(docs, [id_col, text]))
    raw = C.text_or_empty(text).cast("binary")
    size = F.length(raw)
    digit = lambda b, off, w: F.substring(b, off + 1, w)

    # level 0 reads the first digit of every document
    rows = src.select("__rid", F.col(id_col).alias("__id"), F.lit(0).cast("long").alias("__gid"),
                      digit(raw, 0, first_digit).alias("__digit"), (size <= first_digit).alias("__ended"))
    state = C.written(_split(rows, salts))
    done = [state.where("__ended")]
    # undecided documents keep the rest of their bytes in one written table
    open_ids = state.where("NOT __ended").select("__rid")
    rest = C.written(src.select("__rid", F.col(id_col).alias("__id"), raw.alias("__b")).join(open_ids.hint("merge"), "__rid"))
    off, width = first_digit, WIDER * first_digit
    while not state.where("NOT __ended").isEmpty():
        part = rest.where(F.length("__b") > off).select(
            "__rid", "__id", digit(F.col("__b"), off, width).alias("__digit"),
            (F.length("__b") <= off + width).alias("__ended"))
        rows = part.join(state.where("NOT __ended").select("__rid", "__gid").hint("merge"), "__rid")
        state = C.written(_split(rows, salts))
        done.append(state.where("__ended"))
        off, width = off + width, WIDER * width
    equal = done[0]
    for d in done[1:]:
        equal = equal.unionByName(d)
    equal = equal.select("__rid", "__n", "__keep", "__keep_rid")
    out = src.join(equal.hint("merge"), "__rid", "left")
    single = F.col("__n").isNull()
    return out.select(*[f"`{c}`" for c in src.columns if c != "__rid"],
                      F.when(single, F.col(id_col)).otherwise(F.col("__keep")).alias("keep_id"),
                      F.coalesce(F.col("__n"), F.lit(1)).cast("long").alias("group_size"),
                      (single | (F.col("__keep_rid") == F.col("__rid"))).alias("kept")).toDF(*docs.columns, *OUT)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    d = docs.select("doc_id", "text", F.sha2(C.text_or_empty("text").cast("binary"), 256).alias("text_sha256"))
    return exact_dedup(d).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
