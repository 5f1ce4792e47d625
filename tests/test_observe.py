"""A run's events and gauges, from real batches and from planned ones."""

import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.streaming import observe


def wait(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)


def test_a_real_stream(spark, tmp_path):
    tap = observe.Tap("run-1", "s", heartbeat_seconds=0)
    spark.streams.addListener(tap)
    try:
        for i in range(3):
            spark.range(10 * i, 10 * i + 10).withColumn("origin", F.lit("LOG")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def run(fail):
            rows = spark.readStream.schema("id long, origin string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            rows = rows.withColumn("id", F.when((F.col("id") == 35) & F.lit(fail), F.raise_error(F.lit("planned"))).otherwise(F.col("id")))
            observe.meters(rows, top=F.max("id")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

        run(False)
        spark.range(30, 40).withColumn("origin", F.lit("LOG")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with pytest.raises(Exception, match="planned"):
            run(True)
        wait(spark)
    finally:
        spark.streams.removeListener(tap)
    rows = tap.events(spark).orderBy("ts", "seq").collect()
    kinds = [r.kind for r in rows]
    assert kinds.count("checkpoint.advanced") == 3
    assert kinds.count("error") == 1
    assert "planned" in json.loads(rows[kinds.index("error")].detail)["message"]
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
    assert (tap.counters["n_rows"], tap.counters["log_events"], tap.counters["select_events"]) == (30, 30, 0)
    assert {r.kind for r in tap.metrics(spark).collect()} == {"counter", "gauge"}


def progress(batch, millis, moved=True, **counts):
    source = SimpleNamespace(description="log", startOffset="1", endOffset="2" if moved else "1")
    return SimpleNamespace(progress=SimpleNamespace(batchId=batch, durationMs={"triggerExecution": millis}, observedMetrics={"meters": Row(**counts)} if counts else {}, inputRowsPerSecond=1.0, processedRowsPerSecond=2.0, stateOperators=[], sources=[source]))


def test_standby_heartbeats_and_numbers(spark):
    now = [dt.datetime(2026, 1, 1, tzinfo=dt.UTC)]
    tap = observe.Tap("r", "s", heartbeat_seconds=5, standby_seconds=1, retained=100, clock=lambda: now[0])
    for seconds, millis, moved in ((0, 10, True), (2, 1500, True), (1, 2000, True), (3, 999, False)):
        now[0] += dt.timedelta(seconds=seconds)
        tap.onQueryProgress(progress(1, millis, moved, n_rows=4))
    tap.record("request.transition", request="a", before="QUEUED", after="ACTIVE")
    tap.onQueryTerminated(SimpleNamespace(exception=None))
    got = [(r.kind, r.seq) for r in tap.events(spark).collect()]
    assert got == [("checkpoint.advanced", 1), ("stream.heartbeat", 2), ("checkpoint.advanced", 3), ("stream.standby", None), ("checkpoint.advanced", 4), ("stream.resumed", None), ("stream.heartbeat", 5), ("request.transition", 6)]
    assert tap.counters == {"n_rows": 16}
    few = observe.Tap("r", "s", retained=2)
    for _ in range(5):
        few.record("error")
    assert [r.seq for r in few.events(spark).collect()] == [4, 5]
