"""Runs dump requests against tables and a log: whole tables, one table, or a list of keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, reconcile
from .requests import Request, RequestStore


@dataclass
class Settings:
    """Defaults of a run, checked against each other."""

    chunk_size: int = 100
    flush_events: int = 100
    flush_seconds: float = 5.0
    heartbeat_seconds: float = 5.0
    key_limit: int = 500
    retained_events: int = 512

    def __post_init__(self):
        for name in ("chunk_size", "flush_events", "flush_seconds", "heartbeat_seconds", "key_limit", "retained_events"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")


@dataclass
class Coordinator:
    """tables: display name -> (rows with k and value). log: pos, table_name, k, op, value. Windows are laid over the log."""

    tables: dict[str, DataFrame]
    log: DataFrame
    store: RequestStore
    settings: Settings = field(default_factory=Settings)

    def dump(self, table: str) -> DataFrame:
        """Emitted rows of a whole table: all its chunks in one job, one window each."""
        rows = self.tables[table].select("k", "value")
        n = -(-rows.count() // self.settings.chunk_size)
        chunk = reconcile.with_windows(chunks.assign(rows, ["k"], self.settings.chunk_size), self.log.count(), n)
        return reconcile.emitted(chunk, self.log, table)

    def repair(self, table: str, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """Emitted rows of the keys, in the order of the request, and the keys that the table doesn't have.

        One window over the whole log, so any change of a key wins over its row.
        """
        spark = self.log.sparkSession
        asked = chunks.first_seen(spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "requested_key long, ordinal long"), "requested_key", "ordinal")
        found = chunks.targeted(self.tables[table].select("k", "value"), F.broadcast(asked), "k")
        top = self.log.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
        chunk = found.select("k", "value", "ordinal", F.lit(0).cast("long").alias("chunk_id"), F.lit(-1).cast("long").alias("lo"), F.lit(top + 1).cast("long").alias("hi"))
        return reconcile.emitted(chunk, self.log, table), chunks.missing(self.tables[table], asked, "k")

    def run_next(self, sink) -> Request | None:
        """Runs the oldest pending request: sink first, then the state. A failure marks the request and is raised."""
        row = self.store.next()
        if row is None:
            return None
        request = Request(row["request_id"], row["scope"], row["table_name"], tuple(row["keys"] or ()))
        self.store.move(request.request_id, ("QUEUED", "ACTIVE"), "ACTIVE")
        missing: tuple[str, ...] = ()
        try:
            if request.scope == "PRIMARY_KEYS":
                rows, gone = self.repair(request.table_name, request.keys)
                sink(rows)
                missing = tuple(str(r.requested_key) for r in gone.orderBy("ordinal").collect())  # at most key_limit
            else:
                for table in [request.table_name] if request.table_name else list(self.tables):
                    sink(self.dump(table))
        except Exception as e:
            self.store.move(request.request_id, ("ACTIVE",), "FAILED", reason=str(e)[:200] or type(e).__name__)
            raise
        self.store.move(request.request_id, ("ACTIVE",), "COMPLETED", missing=missing)
        return request
