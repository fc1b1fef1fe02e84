"""Tables written under the shared folder, which cut lineage between the rounds of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder in local mode alone."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corrgraph-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """df as written to and read back from a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/corrgraph-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
