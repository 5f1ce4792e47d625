"""Dump requests, progress and the rest of a source's state: checked values, transitions, and a journal of them."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPES = ("ALL_TABLES", "TABLE", "PRIMARY_KEYS")
STATES = ("QUEUED", "ACTIVE", "COMPLETED", "FAILED")
OPEN = ("QUEUED", "ACTIVE")
KEY_LIMIT = 500
REQUEST_FIELDS = ("request_id", "scope", "table_name", "keys", "state", "reason", "missing")


class StateError(Exception):
    """Stored state that can't be, or a change of it that isn't allowed."""


@dataclass(frozen=True)
class Request:
    request_id: str
    scope: str
    table_name: str | None = None
    keys: tuple[str, ...] = ()

    def __post_init__(self):
        keyed = self.scope == "PRIMARY_KEYS"
        if self.scope not in SCOPES:
            raise ValueError(f"scope {self.scope}")
        if (self.table_name is None) != (self.scope == "ALL_TABLES"):
            raise ValueError("a table is named exactly if the scope isn't ALL_TABLES")
        if bool(self.keys) != keyed:
            raise ValueError("keys are given exactly for PRIMARY_KEYS")
        if len(self.keys) > KEY_LIMIT:
            raise ValueError(f"over {KEY_LIMIT} keys")


@dataclass(frozen=True)
class Progress:
    """Progress of a job through one table. Keys are literals; tokens belong to the chunk that is under way."""

    job_id: str
    table_name: str
    fingerprint: str
    upper_bound: str | None = None
    last_completed: str | None = None
    start_after: str | None = None
    low: str | None = None
    high: str | None = None
    completed: bool = False

    def __post_init__(self):
        active = self.low is not None
        for wrong, why in (
            ((self.low is None) != (self.high is None), "one token without the other"),
            (not active and self.start_after is not None, "a chunk's start without tokens"),
            (self.start_after is not None and self.upper_bound is None, "a chunk's start without a bound"),
            (active and self.low == self.high, "equal tokens"),
            (active and self.start_after != self.last_completed, "the active chunk doesn't start at the last completed key"),
            (self.completed and self.last_completed is None, "completed without a last key"),
            (self.completed and (active or self.start_after is not None), "completed with an active chunk"),
            (self.last_completed is not None and self.upper_bound is None, "a last key without a bound"),
        ):
            if wrong:
                raise StateError(why)

    def bound(self, upper_bound: str | None) -> Progress:
        if self.upper_bound is not None:
            raise StateError("the bound is captured once")
        return replace(self, upper_bound=upper_bound)

    def begin(self) -> Progress:
        return replace(self, start_after=self.last_completed, low=uuid.uuid4().hex, high=uuid.uuid4().hex, completed=False)

    def complete(self, last_key: str | None, final: bool) -> Progress:
        """The active chunk is done; an empty chunk jumps to the bound."""
        return replace(self, last_completed=last_key if last_key is not None else self.upper_bound, start_after=None, low=None, high=None, completed=final)

    def restart(self) -> Progress:
        """The active chunk is forgotten, to be read again with new tokens."""
        return replace(self, start_after=None, low=None, high=None)


class Journal:
    """Rows appended to a Parquet table in a shared folder, each append under the version it makes.

    The state of a thing is its row of the newest version, which a query finds by aggregation; nothing is rewritten.
    An append names the version it follows: where another writer has been there, it fails and nothing is written.
    """

    SCHEMA = "version long, kind string, id string, seq long, gone boolean, body string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self) -> int:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n.removeprefix("at=")) for n in done if n.startswith("at=")), default=0)

    def append(self, rows: DataFrame, expected: int) -> int:
        """rows: kind, id, seq, gone, body. All of them count or, if this fails, none."""
        if self.version() != expected:
            raise StateError(f"version {self.version()}, not {expected}")
        rows = rows.select(F.lit(expected + 1).cast("long").alias("version"), "kind", "id", F.col("seq").cast("long"), "gone", "body")
        rows.coalesce(1).write.mode("error").parquet(f"{self.folder}/at={expected + 1}")
        return expected + 1

    def current(self, kind: str, upto: int | None = None) -> DataFrame:
        """id, seq and body of what there is of a kind."""
        upto = self.version() if upto is None else upto
        if not upto:
            return self.spark.createDataFrame([], "id string, seq long, body string")
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder}/at={v}" for v in range(1, upto + 1)])
        last = rows.filter(F.col("kind") == kind).groupBy("id").agg(F.max_by(F.struct("gone", "seq", "body"), "version").alias("r"))
        return last.filter("NOT r.gone").select("id", "r.seq", "r.body")

    def row(self, kind: str, key: str, body: dict | None, seq: int = 0) -> DataFrame:
        """One row to append; without a body the thing is gone."""
        return self.spark.createDataFrame([(kind, key, seq, body is None, json.dumps(body))], "kind string, id string, seq long, gone boolean, body string")


class RuntimeState:
    """Ownership, positions, progress and uncertainty signals of one source, and its requests, in one journal."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.journal = spark, Journal(spark, folder)
        self.requests = RequestStore(spark, folder)

    def _one(self, kind: str, key: str) -> dict | None:
        found = self.journal.current(kind).filter(F.col("id") == key).select("body").first()
        return json.loads(found.body) if found else None

    def _put(self, kind: str, key: str, body: dict | None) -> None:
        self.journal.append(self.journal.row(kind, key, body), self.journal.version())

    def claim(self, source_id: str) -> None:
        """A state folder belongs to the first source that claims it."""
        if not source_id.strip():
            raise ValueError("a source has a name")
        version = self.journal.version()
        owner = self._one("owner", "owner")
        if owner is not None and owner["source"] != source_id:
            raise StateError(f"the state belongs to {owner['source']}, not to {source_id}")
        if owner is None:
            self.journal.append(self.journal.row("owner", "owner", {"source": source_id}), version)

    def save_checkpoint(self, source_id: str, position: int) -> None:
        """The position that the sink has acknowledged; with it the bootstrap position goes, in one append."""
        rows = self.journal.row("checkpoint", source_id, {"position": position}).unionByName(self.journal.row("bootstrap", source_id, None))
        self.journal.append(rows, self.journal.version())

    def save_bootstrap(self, source_id: str, position: int) -> bool:
        """Where to begin before there is a checkpoint; once there is one, nothing is saved."""
        if self._one("checkpoint", source_id) is not None:
            return False
        self._put("bootstrap", source_id, {"position": position})
        return True

    def resume_position(self, source_id: str) -> int | None:
        for kind in ("checkpoint", "bootstrap"):
            if (found := self._one(kind, source_id)) is not None:
                return found["position"]
        return None

    def save_progress(self, progress: Progress) -> None:
        self._put("progress", f"{progress.job_id}/{progress.table_name}", asdict(progress))

    def progress(self, job_id: str, table_name: str) -> Progress | None:
        found = self._one("progress", f"{job_id}/{table_name}")
        return Progress(**found) if found else None

    def signal(self, source_id: str, reason: str) -> None:
        """A sign that a schema may have changed; invalidation clears it."""
        self._put("signal", f"{source_id}/{reason}", {"reason": reason})

    def invalidate(self, source_id: str, reason: str) -> None:
        """A source's key has changed: its bootstrap position, all progress and its signals go, open requests fail.

        One append, so a crash leaves all of it or none.
        """
        if not reason.strip():
            raise ValueError("a failure has a reason")
        version = self.journal.version()
        gone = [self.journal.current(kind, version).select(F.lit(kind).alias("kind"), "id", "seq") for kind in ("bootstrap", "progress", "signal")]
        gone[0], gone[2] = gone[0].filter(F.col("id") == source_id), gone[2].filter(F.col("id").startswith(f"{source_id}/"))
        rows = gone[0].unionByName(gone[1]).unionByName(gone[2]).withColumns({"gone": F.lit(True), "body": F.lit(None).cast("string")})
        open_ones = self.requests.current(version).filter(F.col("state").isin(*OPEN)).withColumns({"state": F.lit("FAILED"), "reason": F.lit(reason)})
        failed = open_ones.select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), "seq", F.lit(False).alias("gone"), F.to_json(F.struct(*REQUEST_FIELDS)).alias("body"))
        self.journal.append(rows.unionByName(failed), version)


class RequestStore:
    """Requests and their states as a journal of transitions; a change is conditional on the version it read."""

    SCHEMA = "request_id string, scope string, table_name string, keys array<string>, state string, reason string, missing array<string>"

    def __init__(self, spark: SparkSession, folder: str):
        self.journal = Journal(spark, folder)

    def current(self, version: int | None = None) -> DataFrame:
        """Requests with ``seq``, without finished ones that a newer completed one of the same table covers."""
        rows = self.journal.current("request", version).select("seq", F.from_json("body", self.SCHEMA).alias("r")).select("seq", "r.*")
        newest = rows.filter("state = 'COMPLETED'").groupBy(F.col("table_name").alias("covers")).agg(F.max("seq").alias("newest"))
        rows = rows.join(newest, rows["table_name"].eqNullSafe(newest["covers"]), "left")
        return rows.filter(F.col("state").isin(*OPEN) | F.col("newest").isNull() | (F.col("seq") >= F.col("newest"))).drop("covers", "newest")

    def _append(self, row: dict, seq: int, version: int) -> None:
        self.journal.append(self.journal.row("request", row["request_id"], {name: row[name] for name in REQUEST_FIELDS}, seq), version)

    def submit(self, request: Request) -> None:
        version = self.journal.version()
        seq = 1 + (self.journal.current("request", version).agg(F.max("seq")).first()[0] or 0)
        row = {"request_id": request.request_id, "scope": request.scope, "table_name": request.table_name, "keys": list(request.keys), "state": "QUEUED", "reason": None, "missing": []}
        self._append(row, seq, version)

    def next(self) -> dict | None:
        """The oldest request that isn't finished."""
        found = self.current().filter(F.col("state").isin(*OPEN)).orderBy("seq").limit(1).first()
        return found.asDict() if found else None

    def move(self, request_id: str, allowed: tuple[str, ...], state: str, reason: str | None = None, missing: tuple[str, ...] = ()) -> None:
        """Compare and set."""
        version = self.journal.version()
        found = self.current(version).filter(F.col("request_id") == request_id).first()
        if found is None or found.state not in allowed:
            raise StateError(f"{request_id} is {found and found.state}, not one of {allowed}")
        if (state == "FAILED") != bool(reason):
            raise StateError("a failure has a reason, nothing else has")
        if missing and found.scope != "PRIMARY_KEYS":
            raise StateError("only targeted requests miss keys")
        self._append(found.asDict() | {"state": state, "reason": reason, "missing": list(missing)}, found.seq, version)
