"""What an observer sees of a stream: events of its run and gauges, from the run's own passes.

Counts are taken by ``DataFrame.observe`` while a batch runs, so nothing is read a second time; Spark reports them with
the batch's progress, and a listener makes events of that. Kinds: ``checkpoint.advanced`` for each batch that moved an
offset, ``stream.heartbeat`` with the batch's counts and backlog at most once an interval, ``stream.standby`` when a
batch took longer than a threshold (what comes in waits meanwhile) and ``stream.resumed`` when one didn't any more,
``error`` for a query that ended by one, and ``request.transition`` for what is recorded of requests. The two kinds in
the middle have no number; the others are numbered in order.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "v int, seq long, ts timestamp, run_id string, source_id string, kind string, batch long, detail string"
UNNUMBERED = ("stream.standby", "stream.resumed")


def meters(df: DataFrame, name: str = "meters", **more: Column) -> DataFrame:
    """df, observed as it runs: rows, and events by origin where it has one."""
    counts = {"n_rows": F.count(F.lit(1)), **more}
    if "origin" in df.columns:
        counts |= {"log_events": F.count_if(F.col("origin") == "LOG"), "select_events": F.count_if(F.col("origin") == "SELECT")}
    return df.observe(name, *[c.alias(k) for k, c in counts.items()])


class Tap(StreamingQueryListener):
    """Keeps the last ``retained`` events of a run, counters summed over its batches, and the gauges of the last batch."""

    def __init__(self, run_id: str, source_id: str, heartbeat_seconds: float = 5.0, standby_seconds: float = 10.0, retained: int = 65_536, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.run_id, self.source_id, self.clock = run_id, source_id, clock
        self.heartbeat, self.standby = dt.timedelta(seconds=heartbeat_seconds), 1000 * standby_seconds
        self.rows: deque[tuple] = deque(maxlen=retained)
        self.seq, self.last_beat, self.waiting, self.lock = 0, None, False, threading.Lock()
        self.counters: dict[str, int] = {}
        self.gauges: dict[str, float] = {}

    def record(self, kind: str, batch: int | None = None, **detail) -> None:
        """One event; details are kept as JSON."""
        with self.lock:
            numbered = kind not in UNNUMBERED
            self.seq += numbered
            self.rows.append((1, self.seq if numbered else None, self.clock(), self.run_id, self.source_id, kind, batch, json.dumps(detail, default=str)))

    def onQueryStarted(self, event) -> None:
        """A start is no event of the log."""

    def onQueryIdle(self, event) -> None:
        """Nothing came; the next batch says so by its offsets."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {k: v for row in (p.observedMetrics or {}).values() for k, v in row.asDict().items() if isinstance(v, int)}
        for k, v in counts.items():
            self.counters[k] = self.counters.get(k, 0) + v
        took = (p.durationMs or {}).get("triggerExecution", 0)
        self.gauges = {"input_rows_per_second": p.inputRowsPerSecond, "processed_rows_per_second": p.processedRowsPerSecond, "batch_millis": took, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        moved = {s.description: s.endOffset for s in p.sources if s.startOffset != s.endOffset}
        if moved:
            self.record("checkpoint.advanced", p.batchId, offsets=moved)
        slow = took >= self.standby
        if slow != self.waiting:
            self.waiting = slow
            self.record("stream.standby" if slow else "stream.resumed", p.batchId, batch_millis=took)
        now = self.clock()
        if self.last_beat is None or now - self.last_beat >= self.heartbeat:
            self.last_beat = now
            self.record("stream.heartbeat", p.batchId, **counts, **self.gauges)

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.record("error", None, message=event.exception[:2000])

    def events(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), SCHEMA)

    def metrics(self, spark: SparkSession) -> DataFrame:
        """name, kind (counter, gauge), value."""
        rows = [(k, "counter", float(v)) for k, v in self.counters.items()] + [(k, "gauge", float(v)) for k, v in self.gauges.items()]
        return spark.createDataFrame(rows, "name string, kind string, value double")
