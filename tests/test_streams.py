"""Keyed state of streams: three micro-batches with a restart give what the batch operators give."""

import pytest

from lectern.operators import events
from lectern.streaming import state
from lectern.streaming.usage import run_available


def parts(spark, rows, schema, path):
    """Writes rows in order of time as three files, the next when asked."""
    n = -(-len(rows) // 3)
    for i in range(3):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(path)
        yield i


def stream_of(spark, path, schema):
    from pyspark.sql import functions as F

    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.timestamp_seconds("s"))


@pytest.fixture(scope="module")
def few(spark):
    """Each micro-batch has a state store a partition; two will do."""
    told = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", told)


def test_bursts_over_a_restart(spark, few, tmp_path):
    from pyspark.sql import functions as F

    rows = sorted((float(1_700_000_000 + i * 17 % 400), i % 3, i) for i in range(60))
    schema = "s double, user_id long, event_id long"
    got = None
    for _ in parts(spark, rows, schema, f"{tmp_path}/in"):
        # A query of its own each time: it goes on from the checkpoint.
        got = run_available(state.burst(stream_of(spark, f"{tmp_path}/in", schema), 3, late="1 minute"), f"file://{tmp_path}/out", ["user_id", "event_id"])
    plain = events.burst(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")), 3)
    assert sorted(map(tuple, got.select("user_id", "event_id", "allowed").collect())) == sorted(map(tuple, plain.select("user_id", "event_id", "allowed").collect()))


def test_retries_over_a_restart_and_what_falls_due(spark, few, tmp_path):
    from pyspark.sql import functions as F

    base = 1_700_000_000.0
    # Job 1 fails three times (extract: given up), then once; job 2 fails, then succeeds; job 3 is told to wait; the last row moves the clock.
    rows = [(base, 1, "extract", 1, "x", None), (base + 1, 2, "fetch", 2, "x", None), (base + 2, 3, "fetch", 3, "x", 900.0), (base + 40, 1, "extract", 4, "y", None), (base + 50, 2, "fetch", 5, None, None), (base + 200, 1, "extract", 6, "z", None), (base + 300, 1, "extract", 7, "x", None), (base + 5000, 9, "fetch", 8, None, None), (base + 5001, 9, "fetch", 9, None, None)]
    schema = "s double, doc_id long, stage string, event_id long, error string, at_least double"
    got = None
    for _ in parts(spark, rows, schema, f"{tmp_path}/in"):
        got = run_available(state.retries(stream_of(spark, f"{tmp_path}/in", schema)), f"file://{tmp_path}/out", ["doc_id", "stage", "event_id", "state"])
    names = ["doc_id", "stage", "event_id", "state", "attempts", "next_attempt_at"]
    every = [tuple(r[c] for c in names) for r in got.collect()]
    plain = state.retries_of(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")))
    assert sorted(r for r in every if r[3] != "due") == sorted((tuple(r[c] for c in names) for r in plain.collect()))
    by_id = {r[2]: r[3:] for r in every}
    assert by_id[1] == ("queued", 1, base + 30) and by_id[4] == ("queued", 2, base + 100) and by_id[6][0] == "failed" and by_id[7] == ("queued", 1, base + 330)
    assert by_id[3] == ("queued", 1, base + 902) and by_id[5] == ("done", 0, None)
    due = {(r[0], r[5]) for r in every if r[3] == "due"}
    assert due == {(3, base + 902), (1, base + 330)}


def test_keys_come_and_go_as_rows(spark, few):
    """Not as a table for each key; events of one time are taken by their number, and null times come last."""
    from pyspark.sql import Row

    stream = spark.readStream.format("rate").load().selectExpr("timestamp AS ts", "value AS user_id", "value AS event_id", "value AS doc_id", "'fetch' AS stage", "'x' AS error", "1.0D AS at_least")
    for made in (state.burst(stream, 3), state.retries(stream)):
        plan = made._jdf.queryExecution().analyzed().toString()
        assert "TransformWithStateInPySpark" in plan and "InPandas" not in plan and "handleInputRows" not in plan
    rows = [Row(at=2.0, event_id=1), Row(at=None, event_id=0), Row(at=1.0, event_id=9), Row(at=2.0, event_id=0)]
    assert [(r.at, r.event_id) for r in state._rows(iter(rows), "at", "event_id")] == [(1.0, 9), (2.0, 0), (2.0, 1), (None, 0)]
