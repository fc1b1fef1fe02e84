"""The stream agrees with the batch on the windows it closes."""

from corrgraph.streaming import contradictions as c


def test_stream(spark, tmp_path):
    rows = [(k, f"2026-01-{1 + k // 24:02d} {k % 24:02d}:00:00", k % 3, "error" if k % 2 else "view") for k in range(24 * 6)]
    events = spark.createDataFrame(rows + rows[:10], "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "to_timestamp(ts) AS ts", "user_id", "event_type")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    got = {}

    def sink(batch, _):
        for r in batch.collect():
            got[r.subject, r.start] = r.n

    stream = c.watch(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), sink, str(tmp_path / "state"))
    stream.awaitTermination(120)
    want = {(r.subject, r.start): r.n for r in c.contradictions(c.evidence(events)).collect()}
    last = max(s for _, s in want)
    assert got and all(want[k] == n for k, n in got.items()) and set(got) >= {k for k in want if k[1] < last}
