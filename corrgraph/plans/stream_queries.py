"""The streaming extension's result over the whole table, read as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrgraph.sources import lens
from corrgraph.streaming import contradictions as c


def contradictions_by_day(spark, d):
    found = c.contradictions(c.evidence(lens.table(spark, d, "events")))
    return found.select("subject", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


QUERIES = {"contradictions_by_day": contradictions_by_day}
ORACLE = {
    "contradictions_by_day": "SELECT 'urn:tpch:customer:' || user_id AS subject, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(DISTINCT event_id) AS n FROM events WHERE event_type = 'error' GROUP BY ALL",
}
