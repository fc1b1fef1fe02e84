"""Mixing sources to target weights by pivotal dependent rounding.

Sources share SHARE of all words by weight, none above CAP times its own words; so a source's
documents are each due c = target / words copies. floor(c) copies are certain. The fraction left is
rounded by pivots: two documents transfer words between their fractions, at random and without bias,
until one fraction is 0 or 1, and the other goes on to the next pairing. Words are conserved, so a
source ends within one document's size of its target.

Level 0 pairs the documents of one (bucket, source); a bucket is a hash of the id, so a hot source is
spread over all buckets. Each leaves one residual at most. Every next level merges FAN_IN buckets, a
reduction tree of depth log(rows). The order and the draws hash the ids, so reruns agree, however
rows are partitioned and whichever executors are lost.

Defined results: null and empty texts have size 0 and take 0 words; null sources are one source,
ranked last; a source without words has target 0; rows that repeat an id are rounded one by one.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrgraph.llm.common import WORD, documents, lean, partitions, save, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BUCKET_ROWS = 4096
FAN_IN = 16


def word_sizes(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{source_col}`").cast("string").alias("_source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_size"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, _words, _target): water filling, one scalar aggregate over the sources a round."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("_words")).sort(F.col("_source").asc_nulls_last())
    ranked = totals.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], float(weights[x[1] % len(weights)])))
    sources = save(spark.createDataFrame(ranked, "_source string, _words long, _weight double"), "sources")
    due = share * (sources.agg(F.sum("_words")).first()[0] or 0)
    rate, over = 0.0, -1
    full = lambda r: F.lit(r) * F.col("_weight") > cap * F.col("_words")
    while True:
        capped, open_weight, n = sources.agg(
            F.sum(F.when(full(rate), cap * F.col("_words")).otherwise(0.0)),
            F.sum(F.when(full(rate), 0.0).otherwise(F.col("_weight"))),
            F.count_if(full(rate)),
        ).first()
        if n == over or not open_weight:
            break
        rate, over = (due - capped) / open_weight, n
    return sources.select("_source", "_words", F.least(F.lit(rate) * F.col("_weight"), cap * F.col("_words")).alias("_target"))


def draw(*parts) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    return xxhash.xxh64_intdigest(repr(parts)) / 2.0**64


def pivot(a: list, b: list, seed: int) -> None:
    """Transfer words between the fractions of two documents [id, size, fraction] until one is whole."""
    (i, s, p), (j, t, q) = a, b
    up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
    if draw(seed, i, j) * (up + down) < down:  # a gains `up` words with chance down / (up + down)
        a[2] = 1.0 if up == s * (1 - p) else p + up / s
        b[2] = 0.0 if up == t * q else q - up / t
    else:
        a[2] = 0.0 if down == s * p else p - down / s
        b[2] = 1.0 if down == t * (1 - q) else q + down / t
    for x in (a, b):  # rounding errors may leave a hair
        x[2] = 0.0 if x[2] < 1e-12 else 1.0 if x[2] > 1 - 1e-12 else x[2]


def pair_off(seed: int, last: bool):
    """A function for mapInPandas over rows sorted by (_bucket, _source): one open fraction stays for each."""

    def run(batches):
        import pandas as pd

        columns = ["_id", "_source", "_size", "_words", "_target", "_bucket", "_copies", "_p"]
        held, key, out = None, None, []

        def close(row):
            if last and 0 < row[7] < 1:
                row[7] = 1.0 if draw(seed, "last", row[0]) < row[7] else 0.0
            if row[7] in (0.0, 1.0):
                row[6] += int(row[7])
                row[7] = 0.0
            out.append(row)

        for pdf in batches:
            for row in pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist():
                if key != (row[5], row[1]) or held is None:
                    if held is not None:
                        close(held)
                    key, held = (row[5], row[1]), row
                    continue
                a, b = [held[0], held[2], held[7]], [row[0], row[2], row[7]]
                pivot(a, b, seed)
                held[7], row[7] = a[2], b[2]
                if 0 < held[7] < 1:
                    close(row)
                else:
                    close(held)
                    held = row
            yield pd.DataFrame(out, columns=columns)
            out = []
        if held is not None:
            close(held)
            yield pd.DataFrame(out, columns=columns)

    return run


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, **targets) -> DataFrame:
    """One row per row of df: id, size, source_size, target, taken, copies, source."""
    spark = df.sparkSession
    sizes = save(word_sizes(df, id_col, source_col, text_col), "sizes", True)
    sources = source_targets(sizes, **targets)
    buckets = 1 << max(0, math.ceil(math.log2(max(1, sizes.count()) / BUCKET_ROWS)))
    # the table of sources is small or skew-split by AQE; a null source meets the null source
    rate = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(0.0)
    rows = sizes.join(sources.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).select(
        "_id", "_source", "_size", "_words", "_target",
        F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(buckets)).alias("_bucket"),
        F.floor(rate).cast("long").alias("_copies"),
        F.when(F.col("_size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("_p"),
    )
    schema, done, level = "_id {}, _source string, _size long, _words long, _target double, _bucket long, _copies long, _p double".format(dict(sizes.dtypes)["_id"]), [], 0
    whole = rows.filter("_p <= 0 or _p >= 1").withColumns({"_copies": F.col("_copies") + (F.col("_p") >= 1).cast("long"), "_p": F.lit(0.0)})
    rows = rows.filter("_p > 0 and _p < 1")
    while True:
        dealt = rows.repartition(partitions(spark), "_bucket", *(["_source"] if level else [])).sortWithinPartitions(
            "_bucket", "_source", F.xxhash64(F.lit(seed), "_id"), "_id", "_size"
        )
        paired = save(dealt.mapInPandas(lean(pair_off(seed + level, buckets == 1)), schema), f"level{level}")
        done.append(paired.filter("_p = 0"))
        if buckets == 1:
            break
        rows = paired.filter("_p > 0").withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN).cast("long"))
        buckets, level = max(1, buckets // FAN_IN), level + 1
    for part in done:
        whole = whole.unionByName(part)
    return whole.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
        F.col("_source").alias("source"),
    )


def mix_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **more) -> DataFrame:
    """df with each row as often as the mix takes it. Rows of one id are matched in order of their size."""
    mixed = save(mix(df, id_col, source_col, text_col, **more), "mixed").select(F.col(id_col).alias("__cg_id"), F.col("size").alias("__cg_n"), F.col("source").alias("__cg_from"), F.col("copies").alias("__cg_copies"))
    if mixed.groupBy("__cg_id").count().filter("count > 1").limit(1).count():
        nth = Window.partitionBy("__cg_id", "__cg_n", "__cg_from").orderBy("__cg_copies")
        mixed = mixed.withColumn("__cg_nth", F.row_number().over(nth))
        sized = df.withColumn("__cg_n", F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"))
        sized = sized.withColumn("__cg_nth", F.row_number().over(Window.partitionBy(id_col, "__cg_n", source_col).orderBy(text_col)))
        both = sized.join(mixed.withColumnsRenamed({"__cg_n": "__cg_m", "__cg_nth": "__cg_mth"}), (F.col(id_col).eqNullSafe(F.col("__cg_id"))) & (F.col("__cg_n") == F.col("__cg_m")) & (F.col(source_col).eqNullSafe(F.col("__cg_from"))) & (F.col("__cg_nth") == F.col("__cg_mth")))
    else:
        # mixed has a row for every document: one plan at every size, with neither side broadcast
        both = df.join(mixed.hint("merge"), F.col(id_col).eqNullSafe(F.col("__cg_id")))
    return both.withColumn("__cg_copy", F.explode(F.array_repeat(F.lit(0), F.col("__cg_copies").cast("int")))).select(*[f"`{c}`" for c in df.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
