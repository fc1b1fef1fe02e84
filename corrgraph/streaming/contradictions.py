"""Evidence as a stream: contradictions per subject and window, as they arrive.

An extension beside the batch rules. Events are deduplicated by id within the watermark, so state is
bounded by the lateness allowed; late events beyond it are dropped by the engine, as its metrics tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "1 hour"
WINDOW = "1 day"


def evidence(events: DataFrame) -> DataFrame:
    """(id, subject, ts, result) of events (event_id, ts, user_id, event_type), batch or stream."""
    result = F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "error", "contradicts").otherwise("inconclusive")
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("urn:tpch:customer:"), F.col("user_id").cast("string")).alias("subject"), "ts", result.alias("result"))


def contradictions(found: DataFrame, window: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """(subject, start, n): contradicting evidence in each window of each subject."""
    once = found.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"]) if found.isStreaming else found.dropDuplicates(["id"])
    counted = once.filter("result = 'contradicts'").groupBy(F.window("ts", window).alias("w"), "subject").agg(F.count("*").alias("n"))
    return counted.select("subject", F.col("w.start").alias("start"), "n")


def watch(events: DataFrame, sink, checkpoint: str, **more):
    """Start the stream: sink(batch, id) gets each batch of finished windows."""
    return contradictions(evidence(events), **more).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
