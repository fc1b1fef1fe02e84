"""What the corpus operators share: the shared scratch folder, saved tables, text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One character of white space, and one word, in the syntax common to Java and Python.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode alone."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corrgraph-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corrgraph-{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as Parquet under the shared folder and return it as read back.

    The lineage ends here: a lost executor costs only the tasks that ran on it since. With small, the
    rows of many tasks are gathered by size into few files, where each task has little to write.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    (df.hint("rebalance") if small else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path.rsplit("/", 1)[0]  # for drop_saved()
    return out


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_saved(*tables: DataFrame) -> None:
    """Delete the folders of tables that save() returned, once every table made from them is written.

    Nothing may read them again, not even to work out anew what a lost executor held: so only tables
    that saved tables alone are read from go.
    """
    for df in tables:
        drop_dir(df.sparkSession, df._saved_at)  # type: ignore[attr-defined]


def text_of(name: str) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_group_first(rows: DataFrame, key: list[str], value: str, name: str, share: float = 0.001) -> DataFrame:
    """rows with a column `name`: the smallest `value` among the rows of the same key.

    Keys above `share` of the rows are found by a Misra-Gries sketch over the first key column,
    verified, and broadcast (at most 1 / share of them); the rest are dealt by key once.
    """
    from pyspark.sql import Window

    total = rows.count()
    candidates = rows.stat.freqItems([key[0]], share).select(F.explode(f"{key[0]}_freqItems").alias(key[0]))
    heavy = rows.join(F.broadcast(candidates), key[0], "left_semi").groupBy(*key).agg(F.min(value).alias(name), F.count("*").alias("_n"))
    heavy = save(heavy.filter(F.col("_n") > share * total).drop("_n"), "heavy")
    near = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy), key, "left_anti").withColumn(name, F.min(value).over(Window.partitionBy(*key)))
    return near.unionByName(rest)


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own; no row has null."""
    same = df.groupBy(F.col(f"`{id_col}`").alias("_id")).count()
    return not same.filter("_id IS NULL OR count > 1").limit(1).count()


#: The name of the key that with_row_key() adds.
ROW = "__cg_row"


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df, written once, with a key for each row (bigint, ROW) that sorts as (id, nulls last; hash of the text).

    Where ids repeat, are null or are no bigint, operators decide on these keys, so rows of one id are
    rows of their own. A range of ids with many rows is parted by the hash.
    """
    key, salt = F.col(f"`{id_col}`"), F.xxhash64(text_of(text_col))
    order = [key.isNull().asc(), key.asc(), salt.asc()]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return save(dealt.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is named by its smallest node.

    Each round takes the smallest name among a node and its neighbours, then the name of that name,
    so long chains shorten by half and more. Tables are written each round; nothing is collected.
    """
    edges = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = save(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct(), "edges", True)
    last = names = save(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "names")
    while True:
        near = edges.join(names.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("m"))
        closer = names.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = names.select(F.col("node").alias("c"), F.col("component").alias("m"))
        new = save(closer.join(jump, "c", "left").select("node", F.least("c", "m").alias("component"), "old"), "names", True)
        drop_saved(last)
        last, names = new, new.select("node", "component")
        if not new.filter("component <> old").limit(1).count():
            drop_saved(edges)
            return names


#: Bits of a filter, kept as rows of 64: 2^16 rows of two numbers, 1 MB, whatever it is made of.
FILTER_BITS = 1 << 22


def id_filter(df: DataFrame, id_col: str, ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose id may be among ids, rows whose id is not), without a shuffle of df.

    A bit for each hash of an id is broadcast: FILTER_BITS / 64 rows at most. Where ids are many, more
    rows pass for maybe; none that is there passes for not.
    """
    place = lambda c: F.expr(f"shiftright(pmod(xxhash64({c}), {FILTER_BITS}), 6)")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {FILTER_BITS}) & 63 as int))")
    bits = ids.select(place(f"`{name}`").alias("__cg_word"), bit(f"`{name}`").alias("__cg_bit"))
    bits = F.broadcast(bits.groupBy("__cg_word").agg(F.bit_or("__cg_bit").alias("__cg_mask")))
    keyed = df.withColumns({"__cg_place": place(f"`{id_col}`"), "__cg_own": bit(f"`{id_col}`")})
    told = keyed.join(bits, F.col("__cg_place") == F.col("__cg_word"), "left").withColumn("__cg_maybe", F.coalesce(F.col("__cg_mask").bitwiseAND(F.col("__cg_own")) != 0, F.lit(False)))
    plain = [f"`{c}`" for c in df.columns]
    return told.filter("__cg_maybe").select(*plain), told.filter("NOT __cg_maybe").select(*plain)


def without_ids(df: DataFrame, id_col: str, gone: DataFrame, name: str) -> DataFrame:
    """df without the rows whose id is among gone (name); only rows that may be among them are shuffled."""
    maybe, rest = id_filter(df, id_col, gone, name)
    other = gone.select(F.col(f"`{name}`").alias("__cg_gone_id"))
    return rest.unionByName(maybe.join(other, F.col(f"`{id_col}`").eqNullSafe(F.col("__cg_gone_id")), "left_anti"))


#: Bytes of an Arrow batch at most: workers and the JVM hold a few batches at a time, whatever a row weighs.
BATCH_BYTES = "4m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Give memory that a finished task has freed back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def lean(run):
    """run, for mapInArrow or mapInPandas: batches bounded by bytes, memory released at the end."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(BATCH_CONF, None) in (None, "67108864b"):  # its default
        spark.conf.set(BATCH_CONF, BATCH_BYTES)

    def go(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return go
