"""Operational questions as DataFrames: requests, recent events, schemas, metrics and a check before the start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import TableContract

from . import chunks
from .requests import Request, RequestStore


class ControlPlane:
    """events: pos, table_name, k, op. tables: the contracts with their rows."""

    def __init__(self, store: RequestStore, events: DataFrame, tables: list[tuple[TableContract, DataFrame]], retained: int = 512):
        self.store, self.events, self.tables, self.retained = store, events, tables, retained

    def requests(self, state: str | None = None, limit: int = 50) -> DataFrame:
        if state not in (None, "QUEUED", "ACTIVE", "COMPLETED", "FAILED"):
            raise ValueError(f"state {state}")
        rows = self.store.current()
        return (rows.filter(F.col("state") == state) if state else rows).orderBy(F.desc("seq")).limit(limit)

    def request(self, request_id: str) -> DataFrame:
        return self.store.current().filter(F.col("request_id") == request_id)

    def submit(self, request: Request) -> None:
        known = {c.table.display for c, _ in self.tables}
        if request.table_name is not None and request.table_name not in known:
            raise ValueError(f"{request.table_name} isn't captured")
        self.store.submit(request)

    def recent_events(self, n: int, table: str | None = None) -> DataFrame:
        rows = self.events if table is None else self.events.filter(F.col("table_name") == table)
        return rows.orderBy(F.desc("pos")).limit(min(n, self.retained))

    def event_summary(self) -> DataFrame:
        return self.events.groupBy("table_name").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))

    def status(self) -> dict:
        """Scalars for a health page."""
        pending = self.store.current().filter(F.col("state").isin("QUEUED", "ACTIVE")).count()
        row = self.events.agg(F.count("*").alias("n"), F.max("pos").alias("top")).first()
        return {"pending_requests": pending, "observed_events": row.n, "last_position": row.top}

    def schemas(self) -> DataFrame:
        """table_name, column_name, type, position and key_ordinal (null outside the key) of the captured tables."""
        rows = [(c.table.display, f.name, f.dataType.simpleString(), k + 1, c.keys.index(f.name) + 1 if f.name in c.keys else None) for c, df in self.tables for k, f in enumerate(df.schema)]
        return self.events.sparkSession.createDataFrame(rows, "table_name string, column_name string, type string, position int, key_ordinal int")

    def schema_issues(self, known: DataFrame) -> DataFrame:
        """Columns that differ from a schema kept earlier (``schemas``), with why."""
        now, names = self.schemas(), ["table_name", "column_name"]
        both = now.join(known.select(*names, F.col("type").alias("was"), F.col("key_ordinal").alias("key_was")), names, "full_outer")
        code = F.when(F.col("was").isNull(), "ADDED").when(F.col("type").isNull(), "REMOVED").when(F.col("type") != F.col("was"), "TYPE").when(~F.col("key_ordinal").eqNullSafe(F.col("key_was")), "KEY")
        return both.withColumn("code", code).filter("code IS NOT NULL").select(*names, "was", "type", "code")

    def metrics(self) -> DataFrame:
        """Gauges by request state: how many there are and the oldest of them."""
        return self.store.current().groupBy("state").agg(F.count("*").alias("n"), F.min("seq").alias("oldest"))

    def startup_check(self) -> DataFrame:
        """One row for each captured table: whether its declared key exists, is unique and is never null."""
        frames = []
        for contract, df in self.tables:
            lost = [k for k in contract.keys if k not in df.columns]
            if lost:
                raise ValueError(f"{contract.table.display} has no key column {', '.join(lost)}")
            frames.append(chunks.key_violations(df, contract.table.display, contract.keys))
        if not frames:
            raise ValueError("no captured table")
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out


def rates(samples: DataFrame, source: str, ts: str, counters: list[str]) -> DataFrame:
    """A second's increase of each counter since the source's sample before; null for its first and for resets."""
    order = W.partitionBy(source).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    span = seconds - F.lag(seconds).over(order)
    rate = lambda c: F.when((F.col(c) >= F.lag(c).over(order)) & (span > 0), (F.col(c) - F.lag(c).over(order)) / span)
    return samples.select(source, ts, *[rate(c).alias(f"{c}_per_second") for c in counters])
