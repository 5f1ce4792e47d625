"""Folds that reset: checkpoint flushes by count or age, and a rate limit on heartbeats.

Where a fold resets next depends on where it did last, so it looks sequential. It is done in parts all the same: streams
are range-partitioned by their order, so one stream may lie in many tasks, and a task works out what its part does to
any state that could come in. That is little: what comes in decides where the part's first reset is, and from there on
links from reset to reset lead to one state that goes out, followed for each possible first reset and remembered on the
way. Only the first and the last stream of a task go beyond it, so two such summaries a task are put one after another,
and then each part is walked from the state that it really begins with.

A walk goes from reset to reset on arrays: the next one is looked for, not each row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import checkpoint, ship

State = tuple[int, int | None]  # events that are buffered, and a time in nanoseconds: of the first of them, or of the last beat
EMPTY: State = (0, None)
NOTHING = -(1 << 63)  # stands for no time in a column


def _next(holds: Callable[[int, int], np.ndarray], lo: int, hi: int) -> int:
    """The first place from lo on where a condition holds, hi if none does; holds(a, b) tells it of a stretch."""
    size = 64
    while lo < hi:
        part = holds(lo, min(hi, lo + size))
        if part.any():
            return lo + int(part.argmax())
        lo, size = lo + size, 2 * size
    return hi


def _ends(links: Callable[[int], int], starts: range, n: int) -> list[int]:
    """The last reset in the part that links lead to from each start; each link is followed once."""
    known: dict[int, int] = {}
    for start in starts:
        path, at = [], start
        while at not in known:
            path.append(at)
            after = links(at)
            if after >= n:
                known[at] = at
                break
            at = after
        for p in path:
            known[p] = known[at]
    return [known[s] for s in starts]


def _same(a, b) -> bool:
    """Whether two streams are one; no id is a stream of its own, which pandas gives as None or as not a number."""
    return a is b or a == b or (a != a and b != b)


def _rising(times: np.ndarray) -> bool:
    return len(times) < 2 or bool((times[1:] >= times[:-1]).all())


@dataclass(frozen=True)
class Flush:
    """Resets when ``most`` events are buffered or the first of them is ``age`` nanoseconds old, after the event."""

    most: int
    age: int

    def _due(self, times: np.ndarray, count: int, first: int | None, at: int) -> int:
        """The next reset at or behind a place, with a buffer of ``count`` events; len(times) if there is none."""
        first = times[at] if not count else first
        full = at + self.most - count - 1
        due = _next(lambda a, b: times[a:b] - first >= self.age, at, min(len(times), full))
        return due if due < min(len(times), full) else min(full, len(times))

    def walk(self, state: State, times: np.ndarray) -> tuple[State, list[int]]:
        (count, first), places, at = state, [], 0
        while at < len(times):
            first = int(times[at]) if not count else first
            due = self._due(times, count, first, at)
            if due == len(times):
                return (count + due - at, first), places
            places.append(due)
            count, at = 0, due + 1
        return EMPTY, places

    def summary(self, times: np.ndarray) -> tuple:
        """Rows, the first times, and the state that goes out for each place that the first reset can have."""
        n = len(times)
        head = times[: self.most]
        if _rising(times):
            far = np.minimum(np.searchsorted(times, times + self.age), np.arange(n) + self.most - 1)
            links = lambda i: int(far[i + 1]) if i + 1 < n else n
        else:
            links = lambda i: self._due(times, 0, None, i + 1) if i + 1 < n else n
        out = [(n - e - 1, int(times[e + 1]) if e + 1 < n else None) for e in _ends(links, range(len(head)), n)]
        return n, head, out

    def through(self, state: State, summary: tuple) -> State:
        n, head, out = summary
        count, first = state
        first = int(head[0]) if not count else first
        due = self._due(head, count, first, 0)
        return out[due] if due < len(head) else (count + n, first)


@dataclass(frozen=True)
class Beat:
    """Resets at a stream's first event, and when ``interval`` nanoseconds have passed since the last reset or time went back."""

    interval: int

    def _due(self, times: np.ndarray, last: int | None, at: int) -> int:
        if last is None:
            return at
        return _next(lambda a, b: (times[a:b] < last) | (times[a:b] - last >= self.interval), at, len(times))

    def walk(self, state: State, times: np.ndarray) -> tuple[State, list[int]]:
        last, places = state[1], []
        due = self._due(times, last, 0)
        while due < len(times):
            places.append(due)
            last = int(times[due])
            due = self._due(times, last, due + 1)
        return (0, last), places

    def summary(self, times: np.ndarray) -> tuple:
        """The first times, as far as a state from before can last, and what goes out for each first reset among them."""
        n = len(times)
        far = _next(lambda a, b: np.abs(times[a:b] - times[0]) >= self.interval, 0, n)
        head = times[: far + 1]
        if _rising(times):
            after = np.searchsorted(times, times + self.interval)
            links = lambda i: int(after[i])
        else:
            links = lambda i: self._due(times, int(times[i]), i + 1)
        return head, times[_ends(links, range(len(head)), n)]

    def through(self, state: State, summary: tuple) -> State:
        head, out = summary
        due = self._due(head, state[1], 0)
        return (0, int(out[due])) if due < len(head) else state


def _fold(df: DataFrame, stream: str, seq: str, ts: str, fold: Flush | Beat, name: str) -> DataFrame:
    """df with a boolean column ``name``: whether the fold resets at the row."""
    spark = df.sparkSession
    ship(spark)
    ranged = checkpoint(df.repartitionByRange(stream, seq).withColumn("_part", F.spark_partition_id()))
    key = df.schema[stream].dataType.simpleString()

    def nanoseconds(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[ts].to_numpy().astype("datetime64[ns]").astype(np.int64)

    def summaries(batches):
        """Of the first and the last stream of a partition; those between them begin and end in it."""
        held: list[tuple] = []  # of the first stream and of the one under way: key, arrays of times
        part = None
        for pdf in batches:
            times, keys = nanoseconds(pdf), pdf[stream].to_numpy()
            part = int(pdf["_part"].iloc[0]) if len(pdf) else part
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)], strict=True):
                if lo < hi:
                    if not held or not _same(held[-1][0], keys[lo]):
                        held = [*held[:1], (keys[lo], [])]
                    held[-1][1].append(times[lo:hi])
        if held:
            yield pd.DataFrame([(k, part, pickle.dumps(fold.summary(np.concatenate(t)))) for k, t in held], columns=["key", "_part", "summary"])

    def compose(parts: pd.DataFrame) -> pd.DataFrame:
        """The state that each part of a stream begins with."""
        state, rows = EMPTY, []
        for k, part, summary in parts.sort_values("_part")[["key", "_part", "summary"]].itertuples(index=False):
            rows.append((k, part, *state))
            state = fold.through(state, pickle.loads(summary))
        out = pd.DataFrame(rows, columns=["key", "_part", "_count", "_time"])
        return out.astype({"_time": "Int64"})

    def walk(batches):
        now, state = None, EMPTY
        for pdf in batches:
            keys, times, out = pdf[stream].to_numpy(), nanoseconds(pdf), np.zeros(len(pdf), bool)
            counts, begun = pdf["_count"].to_numpy(), pdf["_time"]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)], strict=True):
                if lo < hi:
                    if now is None or not _same(keys[lo], now[0]):
                        now, at = (keys[lo],), begun.iloc[lo]
                        state = (int(counts[lo]), None if at == NOTHING else int(at))
                    state, places = fold.walk(state, times[lo:hi])
                    out[lo + np.array(places, np.int64)] = True
            yield pdf.drop(columns=["_part", "_count", "_time"]).assign(**{name: out})

    in_order = ranged.select(F.col(stream), F.col(seq), F.col(ts), "_part").sortWithinPartitions(stream, seq)
    made = in_order.mapInPandas(summaries, f"key {key}, _part int, summary binary")
    begins = made.groupBy("key").applyInPandas(compose, f"key {key}, _part int, _count long, _time long")
    begins = F.broadcast(checkpoint(begins.select("_part", F.col("key").alias("_key"), "_count", F.coalesce("_time", F.lit(NOTHING)).alias("_time"))))  # two rows a partition
    rows = ranged.join(begins, (ranged["_part"] == begins["_part"]) & ranged[stream].eqNullSafe(begins["_key"]), "left")
    rows = rows.select(*df.columns, ranged["_part"], F.coalesce("_count", F.lit(0)).alias("_count"), F.coalesce("_time", F.lit(NOTHING)).alias("_time"))
    schema = ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, (name, "boolean")])
    return rows.sortWithinPartitions(stream, seq).mapInPandas(walk, schema)


def flush_points(df: DataFrame, stream: str, seq: str, ts: str, most: int, age: pd.Timedelta) -> DataFrame:
    """``flush``: whether the buffer is written after this event, by its count or the age of its first event."""
    return _fold(df, stream, seq, ts, Flush(most, age.value), "flush")


def due_beats(df: DataFrame, stream: str, seq: str, ts: str, interval: pd.Timedelta) -> DataFrame:
    """``due``: whether a beat is written, not sooner than ``interval`` after the last written one.

    A part's summary holds the rows of one interval from its start, at most; all else is bounded by counts of tasks.
    """
    return _fold(df, stream, seq, ts, Beat(interval.value), "due")
