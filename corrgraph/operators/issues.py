"""Issues: one schema for every rule's findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "severity string, code string, message string, subject_id string"


def issues(rows: DataFrame, code, subject: Column, message: Column, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"), subject.alias("subject_id"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def say(*parts) -> Column:
    """A message from texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts])
