"""Exact deduplication with a split for heavy hitters. DataFrame operations only.

A Misra-Gries sketch (DataFrameStatFunctions.freqItems) over 64-bit hashes of the digests (it keeps
bytes by identity, so equal digests would not meet in it) names every one that holds more than
HEAVY_SHARE of the rows, and perhaps others. One exact aggregate over the candidates
verifies them and picks their winners; the verified ones number 1 / HEAVY_SHARE at most, so they are
broadcast and their copies are decided where they lie. All other digests are shuffled, and none of
their groups exceeds HEAVY_SHARE of the rows.

Defined results: null text equals empty text; texts are equal when they agree without white space;
the longest original (code points) stays, then the smallest id, ids that are null coming last. Each
row is decided by itself: of rows that repeat an id, the ones whose text another row holds go, those
with a text of their own stay. Ids may be of any type that has an order. An empty table gives an
empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrgraph.llm.common import ROW, SPACE, documents, save, text_of, unique_ids, with_row_key, without_ids

#: A digest with more than this share of the rows is heavy; so at most 1000 are broadcast.
HEAVY_SHARE = 0.001


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _length, _digest, _row): code points of the text, sha256 of the text without white space, a number of the row's own."""
    text = text_of(text_col)
    return df.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.length(text).alias("_length"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),  # for ties alone; it holds once the table is written
    )


def heavy_winners(prints: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(_digest, _keep, _keep_row, _size) of the digests that hold more than `share` of the rows."""
    total = prints.count()
    keyed = prints.withColumn("_hash", F.xxhash64("_digest"))
    candidates = keyed.stat.freqItems(["_hash"], share).select(F.explode("_hash_freqItems").alias("_hash"))
    best = F.min(F.struct(-F.col("_length"), F.col("_id").isNull(), F.col("_id").alias("_keep"), F.col("_row").alias("_keep_row")))
    return (
        keyed.join(F.broadcast(candidates), "_hash", "left_semi")
        .groupBy("_digest")
        .agg(best.alias("_best"), F.count("*").alias("_size"))
        .filter((F.col("_size") > share * total) & (F.col("_size") > 1))
        .select("_digest", F.col("_best._keep").alias("_keep"), F.col("_best._keep_row").alias("_keep_row"), "_size")
    )


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = HEAVY_SHARE) -> DataFrame:
    """One row per row of df: the id, keep_id, group_size, kept, text_sha256."""
    prints = save(fingerprints(df, id_col, text_col), "fingerprints", True)
    heavy = save(heavy_winners(prints, share), "heavy")
    near = prints.join(F.broadcast(heavy), "_digest")
    rest = prints.join(F.broadcast(heavy), "_digest", "left_anti")
    group = Window.partitionBy("_digest")
    ranked = group.orderBy(F.col("_length").desc(), F.col("_id").asc_nulls_last(), "_row")
    first = F.first(F.struct("_id", "_row")).over(ranked)
    rest = rest.withColumn("_first", first).withColumns({"_keep": F.col("_first._id"), "_keep_row": F.col("_first._row")}).drop("_first").withColumn("_size", F.count("*").over(group))
    return near.unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        (F.col("_row") == F.col("_keep_row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts: the one that op1 keeps."""
    if dict(df.dtypes)[id_col] == "bigint" and unique_ids(df, id_col):
        gone = save(exact_duplicates(df, id_col, text_col).filter("NOT kept").select(F.col(f"`{id_col}`").alias("_gone")), "copies")
        return without_ids(df, id_col, gone, "_gone")
    rows = with_row_key(df, id_col, text_col)
    gone = save(exact_duplicates(rows, ROW, text_col).filter("NOT kept").select(F.col(ROW).alias("_gone")), "copies")
    return without_ids(rows, ROW, gone, "_gone").drop(ROW)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
