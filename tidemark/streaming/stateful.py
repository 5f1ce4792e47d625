"""The reconciler on Spark's own streaming state: one state for each bucket of keys, a timer at its next HIGH.

The stream is a log of records in which a dump's rows stand beside the events: a row of a chunk is recorded between its
LOW and its HIGH, and HIGH itself is a record. Positions, from 0, are event time (a millisecond each, one later), so the watermark says up
to where the log is complete. A row waits in the state of its bucket until the watermark reaches its HIGH; an event of
its key inside the window takes it away. Nothing is kept in files of this library's: state, timers and the place in the
log are in the query's checkpoint, so a query that is killed goes on where it was.

Keys are dealt to buckets by hash, so a batch calls Python and the state store once for a bucket, not for a key, and a
bucket's rows and events are compared as frames. Events need no state to come out and don't wait for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECORD = "pos long, kind string, table_name string, k long, op string, value double, ordinal long, chunk_id long, lo long, hi long"
EMITTED = "emit_pos long, origin_rank int, ordinal long, origin string, table_name string, op string, k long, value double"
WAITED = "emit_pos long, ordinal long, table_name string, k long, no_key boolean, value double, no_value boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_records(log: DataFrame) -> DataFrame:
    """Events of a change log as records."""
    none = F.lit(None).cast("long")
    return log.select("pos", F.lit("LOG").alias("kind"), "table_name", "k", "op", "value", *[none.alias(c) for c in ("ordinal", "chunk_id", "lo", "hi")])


def dump_records(chunk: DataFrame, table: str, recorded: Column | None = None) -> DataFrame:
    """Rows of chunks, and one record for each HIGH, spread by their chunks' numbers as if these were keys. recorded:
    where in the log a row stands, right before its HIGH if not said."""
    at = F.col("hi") - 1 if recorded is None else recorded
    rows = chunk.select(at.cast("long").alias("pos"), F.lit("SELECT").alias("kind"), F.lit(table).alias("table_name"), "k", F.lit("UPDATE").alias("op"), "value", "ordinal", "chunk_id", "lo", "hi")
    high = chunk.select("chunk_id", "lo", "hi").distinct().select(F.col("hi").alias("pos"), F.lit("HIGH").alias("kind"), F.lit(table).alias("table_name"), F.col("chunk_id").alias("k"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("ordinal"), "chunk_id", "lo", "hi")
    return rows.unionByName(high)

KEY = ["table_name", "k"]
OPEN = [*KEY, "no_key", "ordinal", "lo", "hi", "value", "no_value"]
CHANGED = [*KEY, "pos"]
CLOSED = [f.split(" ")[0] for f in WAITED.split(", ")]


def _pack(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


class _Windows(StatefulProcessor):
    """Of one bucket: ``open``, the rows that wait for their HIGH, ``changed``, where each key changed last, and
    ``timer``, when to look again."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "open binary, changed binary, timer long")

    def _load(self) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        found = self.state.get() if self.state.exists() else (None, None, None)
        return *[None if raw is None else _unpack(bytes(raw)) for raw in found[:2]], found[2]

    def _keep(self, waiting: pd.DataFrame, changed: pd.DataFrame, timer: int | None, now: int) -> None:
        """The state from now on, without changes that no window still to come holds, and its timer. timer: the one that
        is set."""
        changed = changed[changed["pos"] >= now - self.span]
        ends = [waiting["hi"].min()] if len(waiting) else []
        ends += [changed["pos"].max() + self.span + 1] if len(changed) else []
        after = int(min(ends)) if ends else None
        if timer is not None and timer != after:
            self.handle.deleteTimer(timer)
        if after is None:
            self.state.clear()
            return
        if timer != after:
            self.handle.registerTimer(after)
        self.state.update((_pack(waiting) if len(waiting) else None, _pack(changed) if len(changed) else None, after))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        waiting, changed, timer = self._load()
        new = frame[frame["is_row"]]
        if len(long := new[new["hi"] - new["lo"] > self.span]):
            raise ValueError(f"a window of {(long['hi'] - long['lo']).max()} positions; span is {self.span}")
        waiting, events = pd.concat([waiting, new[OPEN]]), pd.concat([changed, frame.loc[~frame["is_row"] & ~frame["no_key"], CHANGED]])
        events = events.sort_values("pos", ignore_index=True)
        if len(waiting) and len(events):  # the first event of the key behind LOW tells whether one is inside
            places = events[KEY].assign(place=events.index, at=events["pos"])
            waiting = pd.merge_asof(waiting.sort_values("lo"), places, left_on="lo", right_on="at", by=KEY, direction="forward", allow_exact_matches=False)
            found = waiting["place"].notna() & ~waiting["no_key"]
            first = events["pos"].to_numpy()[waiting["place"].fillna(0).astype("int64")]
            waiting = waiting.loc[~(found & (first < waiting["hi"])), OPEN]
        self._keep(waiting, events.drop_duplicates(KEY, keep="last"), timer, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(columns=CLOSED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting, changed, _ = self._load()
        waiting = pd.DataFrame(columns=OPEN) if waiting is None else waiting
        changed = pd.DataFrame(columns=CHANGED) if changed is None else changed
        closed = waiting["hi"] <= now
        out = waiting[closed].rename(columns={"hi": "emit_pos"})
        self._keep(waiting[~closed], changed, None, now)  # Spark takes the timer that fired
        yield out[CLOSED]


def reconcile(records: DataFrame, span: int, buckets: int = 512) -> DataFrame:
    """What ``operators.reconcile.emitted`` gives, from a stream of records (``RECORD``) in the order of their positions.

    span: the most positions from a LOW to its HIGH; a longer window is an error. It bounds how long a key that changed
    is remembered. buckets: of the keys; a checkpoint holds for one number of them, and no more tasks than that share the
    work. Events come out in the batch that reads them, rows in the batch after the one that reads their HIGH
    (or any record behind it); Spark runs that one by itself.
    """
    use_state_store(records.sparkSession)
    events = records.filter("kind = 'LOG'").select(F.col("pos").alias("emit_pos"), F.lit(0).alias("origin_rank"), F.lit(0).cast("long").alias("ordinal"), F.lit("LOG").alias("origin"), "table_name", "op", "k", "value")
    # one later, as what is at 0 would be late; one position of delay: records of one position may come in two batches; all below the watermark + 1 have come
    timed = records.withColumn("at", F.timestamp_millis(F.col("pos") + 1)).withWatermark("at", "1 millisecond")
    is_row = F.col("kind") == "SELECT"
    bare = (F.col("kind") == "HIGH") | F.col("table_name").isNull() | F.col("k").isNull()  # what has no key touches none; it moves the watermark
    # a null is a flag beside its value, as pandas would make whole numbers with nulls floats
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("k", "ordinal", "lo", "hi")]
    held = timed.select(
        "at", F.pmod(F.xxhash64("table_name", "k"), F.lit(buckets)).alias("bucket"), is_row.alias("is_row"), "pos", "table_name", *numbers, bare.alias("no_key"), "value", F.col("value").isNull().alias("no_value")
    )
    waited = held.groupBy("bucket").transformWithStateInPandas(_Windows(span), outputStructType=WAITED, outputMode="Append", timeMode="EventTime")
    key, value = F.when(~F.col("no_key"), F.col("k")).alias("k"), F.when(~F.col("no_value"), F.coalesce("value", F.lit(float("nan")))).alias("value")  # NaN comes back as null
    rows = waited.select("emit_pos", F.lit(1).alias("origin_rank"), "ordinal", F.lit("SELECT").alias("origin"), "table_name", F.lit("UPDATE").alias("op"), key, value)
    return events.unionByName(rows)


def use_state_store(spark: SparkSession) -> None:
    """State by key with timers needs a store of column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
