"""Dumps of tables into a log that goes on: control rows in the log, windows between them, and progress that lasts.

A window covers many chunks. Where windows end is planned by one pass over the keys; then, for each window, LOW is
written, the rows of its range of keys are read and kept, HIGH is written, and the session emits the log
up to HIGH and then the rows that no event in between has changed. Progress and the emitted position are saved after
each window, so a run that ends anywhere goes on at the window that was under way, with new tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import saved

from . import apply, chunks, reconcile
from .requests import Progress, Request, RuntimeState

STEPS = ("bound", "plan", "begin", "low", "read", "high", "emit", "sink", "complete", "checkpoint")


class ControlLog:
    """A change log in a shared folder, into which a session also writes: watermarks and heartbeats of its run."""

    SCHEMA = "pos long, table_name string, k long, op string, value double, token string, run_id string"

    def __init__(self, spark: SparkSession, folder: str, run_id: str, heartbeat_seconds: float = 5.0):
        if not run_id.strip():
            raise ValueError("a run has an id")
        self.spark, self.folder, self.run_id, self.heartbeat_seconds = spark, folder, run_id, heartbeat_seconds
        self.last_beat: float | None = None

    def append(self, rows: DataFrame) -> None:
        """Events of the source: pos, table_name, k, op, value."""
        none = F.lit(None).cast("string")
        rows.select("pos", "table_name", "k", "op", "value", none.alias("token"), none.alias("run_id")).write.mode("append").parquet(self.folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def events(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """What isn't a control row, between two positions."""
        rows = apply.without_controls(self.read()).filter(F.col("pos") > after)
        return (rows if upto is None else rows.filter(F.col("pos") <= upto)).select("pos", "table_name", "k", "op", "value")

    def top(self) -> int:
        return self.read().agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]

    def _control(self, op: str, token: str) -> int:
        pos = self.top() + 1
        self.spark.createDataFrame([(pos, "control", 1, op, None, token, self.run_id)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        return pos

    def watermark(self, token: str) -> int:
        """A control row at the log's end; its position."""
        if not token.strip():
            raise ValueError("a watermark has a token")
        return self._control("WATERMARK", token)

    def heartbeat(self, now: float) -> bool:
        """A heartbeat, unless the last one is younger than the interval."""
        if self.last_beat is not None and 0 <= now - self.last_beat < self.heartbeat_seconds:
            return False
        self._control("HEARTBEAT", f"beat-{now}")
        self.last_beat = now
        return True


@dataclass
class LiveDump:
    """tables: display name -> rows with k and value, read anew for each window. at: told each step, twice, in tests
    to fail or wait there."""

    source_id: str
    tables: dict[str, Callable[[], DataFrame]]
    log: ControlLog
    state: RuntimeState
    window_rows: int = 1_000_000
    at: Callable[[str], None] = field(default=lambda step: None)

    def _step(self, name: str, action: Callable):
        self.at(f"before-{name}")
        out = action()
        self.at(f"after-{name}")
        return out

    def table(self, job_id: str, name: str, sink: Callable[[DataFrame], None]) -> int:
        """Dumps a table, or the rest of it; how many windows that took."""
        progress = self.state.progress(job_id, name) or Progress(job_id, name, "")
        if progress.low is not None:
            progress = progress.restart()
        if progress.upper_bound is None:
            top = self._step("bound", lambda: self.tables[name]().agg(F.max("k")).first()[0])
            if top is None:
                return 0
            progress = progress.bound(str(top))
            self.state.save_progress(progress)
        ends = self._step("plan", lambda: self._ends(name, progress))
        windows = 0
        while not progress.completed:
            progress = self._window(progress, name, next(ends), sink)
            windows += 1
        return windows

    def _ends(self, name: str, progress: Progress) -> Iterator[int]:
        """Last keys of the windows to come, the bound at the end. One number a window of ``window_rows`` rows is kept."""
        rows = self._range(name, progress.last_completed, int(progress.upper_bound))
        found = sorted(r[0] for r in chunks.window_ends(rows, "k", self.window_rows).collect())
        return iter([*[e for e in found if e < int(progress.upper_bound)], int(progress.upper_bound)])

    def _range(self, name: str, after: str | None, upto: int) -> DataFrame:
        rows = self.tables[name]().select("k", "value").filter(F.col("k") <= upto)
        return rows if after is None else rows.filter(F.col("k") > int(after))

    def _window(self, progress: Progress, name: str, end: int, sink: Callable[[DataFrame], None]) -> Progress:
        progress = progress.begin()
        self._step("begin", lambda: self.state.save_progress(progress))
        low = self._step("low", lambda: self.log.watermark(progress.low))
        part = self._step("read", lambda: saved(self._range(name, progress.start_after, end)))
        high = self._step("high", lambda: self.log.watermark(progress.high))
        chunk = part.select("k", "value", F.col("k").alias("ordinal"), F.lit(0).cast("long").alias("chunk_id"), F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi"))
        begun = self.state.resume_position(self.source_id)
        out = self._step("emit", lambda: self._emitted(chunk, name, -1 if begun is None else begun, low, high))
        self._step("sink", lambda: sink(out))
        done = progress.complete(str(end), end == int(progress.upper_bound))
        self._step("checkpoint", lambda: self.state.save_checkpoint(self.source_id, high))
        self._step("complete", lambda: self.state.save_progress(done))
        return done

    def _emitted(self, chunk: DataFrame, name: str, after: int, low: int, high: int) -> DataFrame:
        """The log behind ``after`` up to HIGH, and the rows left. What was emitted before isn't again, but counts for
        the window."""
        rows = reconcile.survivors(chunk, self.log.events(low, high), name)
        none = chunk.filter(F.lit(False))
        live = reconcile.emitted(none, self.log.events(after, high), name)
        return live.unionByName(reconcile.emitted(rows, self.log.events(high, high), name))


@dataclass
class Pump:
    """Turns: a heartbeat if it is due, then a request if there is one, else the stream, until neither has work."""

    dump: LiveDump
    clock: Callable[[], float]
    idle: Callable[[], None] = field(default=lambda: None)
    stopped: bool = False

    def run(self, sink: Callable[[DataFrame], None], idle_turns: int = 1) -> list[str]:
        """Ids of the requests that were completed; ends after ``idle_turns`` turns without work, or when stopped."""
        done: list[str] = []
        idle = 0
        while not self.stopped and idle < idle_turns:
            self.dump.log.heartbeat(self.clock())
            request = self.dump.state.requests.next()
            if request is not None:
                self._serve(request, sink)
                done.append(request["request_id"])
                idle = 0
            elif self._drain(sink):
                idle = 0
            else:
                idle += 1
                self.idle()
        return done

    def _serve(self, row: dict, sink: Callable[[DataFrame], None]) -> None:
        request = Request(row["request_id"], row["scope"], row["table_name"], tuple(row["keys"] or ()))
        requests = self.dump.state.requests
        requests.move(request.request_id, ("QUEUED", "ACTIVE"), "ACTIVE")
        names: Iterable[str] = [request.table_name] if request.table_name else self.dump.tables
        for name in names:
            if request.scope == "PRIMARY_KEYS":
                self._repair(request, name, sink)
            else:
                self.dump.table(request.request_id, name, sink)
        if request.scope != "PRIMARY_KEYS":
            requests.move(request.request_id, ("ACTIVE",), "COMPLETED")

    def _repair(self, request: Request, name: str, sink: Callable[[DataFrame], None]) -> None:
        """A dump of a few keys in one window; a key that isn't there is reported."""
        keys = sorted({int(k) for k in request.keys})
        only = LiveDump(self.dump.source_id, {name: lambda: self.dump.tables[name]().filter(F.col("k").isin(keys))}, self.dump.log, self.dump.state, len(keys) + 1, self.dump.at)
        found = {r.k for r in only.tables[name]().select("k").collect()}  # at most the request's keys
        only.table(request.request_id, name, sink)
        self.dump.state.requests.move(request.request_id, ("ACTIVE",), "COMPLETED", missing=tuple(str(k) for k in keys if k not in found))

    def _drain(self, sink: Callable[[DataFrame], None]) -> bool:
        """Emits the log behind the checkpoint; whether there was any."""
        log, state, source = self.dump.log, self.dump.state, self.dump.source_id
        begun = state.resume_position(source)
        top = log.top()
        rows = log.events(-1 if begun is None else begun, top)
        if rows.isEmpty():
            return False
        empty = rows.select("k", "value", F.col("pos").alias("ordinal"), F.col("pos").alias("chunk_id"), F.col("pos").alias("lo"), F.col("pos").alias("hi")).filter(F.lit(False))
        sink(reconcile.emitted(empty, rows, ""))
        state.save_checkpoint(source, top)
        return True
