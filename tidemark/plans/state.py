"""Requests, progress, schema policy and the folds of the control plane."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.sources.tables import read

from . import base, snapshot

KEY_LIMIT = 500
FLUSH_EVENTS, FLUSH_AGE = 10, "2 hours"
BEAT = "3 hours"


def requests_by_state(spark, sf_dir):
    """The newest 50 failed requests (a page of the list)."""
    r = base.requests(spark, sf_dir).filter("state = 'FAILED'").select("request_id", "scope", "table_name", "state")
    return r.orderBy(F.desc("request_id")).limit(50)


def requests_count_by_state(spark, sf_dir):
    return base.requests(spark, sf_dir).groupBy(F.coalesce("state", F.lit("QUEUED")).alias("state")).agg(F.count("*").alias("n"))


def _split(spark, sf_dir):
    """Requests and their statuses as the two tables that a store keeps."""
    r = base.requests(spark, sf_dir)
    return r.select("request_id", "seq", "scope", "table_name", "n_keys"), r.filter("state IS NOT NULL").select("request_id", "state", "reason", "n_missing")


def requests_pending(spark, sf_dir):
    requests, status = _split(spark, sf_dir)
    both = requests.join(status, "request_id", "left")
    return both.filter("state IS NULL OR state = 'ACTIVE'").select("request_id", "seq", "scope", "table_name", F.coalesce("state", F.lit("QUEUED")).alias("state"))


def requests_pending_count(spark, sf_dir):
    return requests_pending(spark, sf_dir).agg(F.count("*").alias("pending"))


def next_request(spark, sf_dir):
    """The oldest pending request: one struct minimum, no sort."""
    rows = requests_pending(spark, sf_dir).agg(F.min(F.struct("seq", "request_id", "scope", "table_name", "state")).alias("r")).filter("r IS NOT NULL")
    return rows.select("r.request_id", "r.scope", "r.table_name", "r.state")


def requests_superseded(spark, sf_dir):
    """Terminal requests older than a completed one that covers them: of all tables, or of the same table."""
    requests, status = _split(spark, sf_dir)
    both = requests.join(status.filter("state IN ('COMPLETED', 'FAILED')"), "request_id").withColumn("covers", F.coalesce("table_name", F.lit("*")))
    newest = both.filter("state = 'COMPLETED'").groupBy("covers").agg(F.max("seq").alias("newest"))
    return both.join(newest, "covers").filter("seq < newest").select("request_id", "scope", "table_name", "state")


def request_validation(spark, sf_dir):
    r = base.requests(spark, sf_dir)
    code = (
        F.when((F.col("scope") == "ALL_TABLES") & F.col("table_name").isNotNull(), "TABLE_NOT_ALLOWED")
        .when((F.col("scope") != "ALL_TABLES") & F.col("table_name").isNull(), "TABLE_REQUIRED")
        .when((F.col("scope") == "PRIMARY_KEYS") & (F.col("n_keys") == 0), "KEYS_REQUIRED")
        .when((F.col("scope") != "PRIMARY_KEYS") & (F.col("n_keys") > 0), "KEYS_NOT_ALLOWED")
        .when(F.col("n_keys") > KEY_LIMIT, "TOO_MANY_KEYS")
    )
    return r.withColumn("code", code).filter("code IS NOT NULL").select("request_id", "scope", "n_keys", "code")


def request_status_violations(spark, sf_dir):
    r = base.requests(spark, sf_dir).filter("state IS NOT NULL")
    code = (
        F.when((F.col("state") == "FAILED") & F.col("reason").isNull(), "REASON_REQUIRED")
        .when((F.col("state") != "FAILED") & F.col("reason").isNotNull(), "REASON_NOT_ALLOWED")
        .when((F.col("scope") != "PRIMARY_KEYS") & (F.col("n_missing") > 0), "MISSING_KEYS_NOT_ALLOWED")
    )
    return r.withColumn("code", code).filter("code IS NOT NULL").select("request_id", "state", "code")


def _progress(spark, sf_dir):
    """Progress rows, one for each order, with every way of being inconsistent among them."""
    o = read(spark, sf_dir, "orders")
    m = F.col("o_custkey") % 16
    last = F.when(m % 2 == 1, F.col("o_custkey") % 100)
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.when((m < 8) | (m == 9), F.lit("low")).alias("low"),
        F.when(m < 7, F.lit("high")).when(m == 9, F.lit("low")).alias("high"),
        F.when((m < 6) | (m == 12), F.when(m == 5, 7).otherwise(last)).alias("start_after"),
        last.alias("last_completed"),
        F.when(m != 3, F.lit(90)).alias("upper_bound"),
        ((m == 13) | (m == 14) | (m == 1)).alias("completed"),
    )


def progress_violations(spark, sf_dir):
    p = _progress(spark, sf_dir)
    low, high, start, last, bound = (F.col(c).isNotNull() for c in ("low", "high", "start_after", "last_completed", "upper_bound"))
    code = (
        F.when(low != high, "ONE_TOKEN")
        .when(~low & start, "START_WITHOUT_TOKENS")
        .when(start & ~bound, "START_WITHOUT_BOUND")
        .when(low & (F.col("low") == F.col("high")), "EQUAL_TOKENS")
        .when(low & ~F.col("start_after").eqNullSafe(F.col("last_completed")), "START_IS_NOT_LAST")
        .when(F.col("completed") & ~last, "COMPLETED_WITHOUT_LAST")
        .when(F.col("completed") & (start | low | high), "COMPLETED_BUT_ACTIVE")
        .when(last & ~bound, "LAST_WITHOUT_BOUND")
    )
    return p.withColumn("code", code).filter("code IS NOT NULL").select("job_id", "code")


def dump_progress_done(spark, sf_dir):
    """Whether the bound is reached: there is none, or the last completed key is at it or beyond."""
    p = _progress(spark, sf_dir)
    done = F.col("upper_bound").isNull() | F.coalesce(F.col("last_completed") >= F.col("upper_bound"), F.lit(False))
    return p.select("job_id", done.alias("done"))


def bootstrap_position_guard(spark, sf_dir):
    """Bootstrap positions are saved only for sources (customers) that have no checkpoint (an urgent order in process)."""
    sources = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") * 2).alias("position"))
    saved = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("source_id"))
    return sources.join(saved, "source_id", "left_anti")


def uncertainty_signals(spark, sf_dir):
    """Occurrences of a signal by table (user) and reason (event type): how many, the first and the last."""
    e = read(spark, sf_dir, "events").filter("event_type IN ('error', 'view')")
    return e.groupBy("user_id", F.col("event_type").alias("reason")).agg(F.count("*").alias("occurrences"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def schema_status(spark, sf_dir):
    """Status of each table (customer) from two kinds of signal; a full dump outranks an uncertain schema."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_no"))
    e = read(spark, sf_dir, "events")
    kind = lambda name, flag: e.filter(F.col("event_type") == name).select(F.col("user_id").alias("table_no")).distinct().withColumn(flag, F.lit(True))
    both = c.join(kind("error", "full"), "table_no", "left").join(kind("view", "unsure"), "table_no", "left")
    return both.select("table_no", F.when(F.col("full"), "FULL_DUMP_REQUIRED").when(F.col("unsure"), "UNCERTAIN").otherwise("OK").alias("status"))


def _live(spark, sf_dir):
    """A live catalog that has drifted: orders lost a column, part has one more, supplier's key is text, region was renamed."""
    c = snapshot.schema_catalog(spark, sf_dir)
    name = F.when(F.col("table_name") == "shop.public.region", "shop.public.areas").otherwise(F.col("table_name"))
    kind = F.when(F.col("column_name") == "s_suppkey", "STRING").when(F.col("column_name") == "l_tax", "DECIMAL").otherwise(F.col("neutral_type"))
    rows = c.filter("column_name <> 'o_orderpriority'").select(name.alias("table_name"), "column_name", "position", kind.alias("neutral_type"), "primary_key")
    extra = spark.createDataFrame([("shop.public.part", "p_note", 7, "STRING", False)], rows.schema)
    return rows.unionByName(extra)


def schema_policy_decision(spark, sf_dir):
    """For each contract: TABLE_GONE, COLUMN_GONE, KEY_CHANGED, SCHEMA_CHANGED or UNCHANGED; extra live columns are ignored."""
    contract = snapshot.schema_catalog(spark, sf_dir)
    live = _live(spark, sf_dir).select("table_name", "column_name", F.col("neutral_type").alias("live_type"))
    tables = live.select("table_name").distinct().withColumn("there", F.lit(True))
    both = contract.join(live, ["table_name", "column_name"], "left").join(tables, "table_name", "left")
    differs = ~F.col("neutral_type").eqNullSafe(F.col("live_type"))
    found = both.groupBy("table_name").agg(
        F.max("there").alias("there"), F.max(F.col("live_type").isNull()).alias("gone"), F.max(differs & F.col("primary_key")).alias("key"), F.max(differs).alias("changed")
    )
    code = F.when(F.col("there").isNull(), "TABLE_GONE").when(F.col("gone"), "COLUMN_GONE").when(F.col("key"), "KEY_CHANGED").when(F.col("changed"), "SCHEMA_CHANGED").otherwise("UNCHANGED")
    return found.select("table_name", code.alias("decision"))


def pk_compatibility(spark, sf_dir):
    """Whether a decode update is safe: the same table, key columns and key types."""
    keys = lambda df: df.filter("primary_key").groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "neutral_type"))), ",").alias("key"))
    a, b = keys(snapshot.schema_catalog(spark, sf_dir)), keys(_live(spark, sf_dir)).withColumnRenamed("key", "live_key")
    return a.join(b, "table_name", "left").select("table_name", F.col("key").eqNullSafe(F.col("live_key")).alias("compatible"))


def checkpoint_flush_points(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return folds.flush_points(e, "user_id", "event_id", "ts", FLUSH_EVENTS, pd.Timedelta(FLUSH_AGE)).filter("flush").select("user_id", "event_id")


def heartbeat_due(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return folds.due_beats(e, "user_id", "event_id", "ts", pd.Timedelta(BEAT)).filter("due").select("user_id", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        requests_by_state, requests_count_by_state, requests_pending, requests_pending_count, next_request, requests_superseded, request_validation,
        request_status_violations, progress_violations, dump_progress_done, bootstrap_position_guard, uncertainty_signals, schema_status,
        schema_policy_decision, pk_compatibility, checkpoint_flush_points, heartbeat_due,
    )
}

_PROGRESS = """
    SELECT o_orderkey AS job_id, CASE WHEN m < 8 OR m = 9 THEN 'low' END AS low, CASE WHEN m < 7 THEN 'high' WHEN m = 9 THEN 'low' END AS high,
           CASE WHEN m < 6 OR m = 12 THEN CASE WHEN m = 5 THEN 7 WHEN m % 2 = 1 THEN o_custkey % 100 END END AS start_after,
           CASE WHEN m % 2 = 1 THEN o_custkey % 100 END AS last_completed, CASE WHEN m <> 3 THEN 90 END AS upper_bound, m IN (1, 13, 14) AS completed
    FROM (SELECT *, o_custkey % 16 AS m FROM orders) AS o"""
_PENDING = "SELECT request_id, seq, scope, table_name, coalesce(state, 'QUEUED') AS state FROM req WHERE state IS NULL OR state = 'ACTIVE'"
_CAT = snapshot.ORACLES["schema_catalog"]
_LIVE = f"""
    SELECT CASE WHEN table_name = 'shop.public.region' THEN 'shop.public.areas' ELSE table_name END AS table_name, column_name,
           CASE column_name WHEN 's_suppkey' THEN 'STRING' WHEN 'l_tax' THEN 'DECIMAL' ELSE neutral_type END AS live_type, primary_key
    FROM ({_CAT}) AS c WHERE column_name <> 'o_orderpriority' UNION ALL SELECT 'shop.public.part', 'p_note', 'STRING', false"""
_FOLD = """
    WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS ({first} UNION ALL {step}) SELECT user_id, event_id FROM f WHERE hit"""
ORACLES = {
    "requests_by_state": base.oracle("SELECT request_id, scope, table_name, state FROM req WHERE state = 'FAILED' ORDER BY request_id DESC LIMIT 50", "req"),
    "requests_count_by_state": base.oracle("SELECT coalesce(state, 'QUEUED') AS state, count(*) AS n FROM req GROUP BY 1", "req"),
    "requests_pending": base.oracle(_PENDING, "req"),
    "requests_pending_count": base.oracle(f"SELECT count(*) AS pending FROM ({_PENDING}) AS p", "req"),
    "next_request": base.oracle(f"SELECT request_id, scope, table_name, state FROM ({_PENDING}) AS p ORDER BY seq LIMIT 1", "req"),
    "requests_superseded": base.oracle(
        """SELECT request_id, scope, table_name, state FROM req a WHERE state IN ('COMPLETED', 'FAILED') AND seq < (
           SELECT max(seq) FROM req b WHERE state = 'COMPLETED' AND coalesce(b.table_name, '*') = coalesce(a.table_name, '*'))""", "req"),
    "request_validation": base.oracle(
        f"""SELECT * FROM (SELECT request_id, scope, n_keys, CASE WHEN scope = 'ALL_TABLES' AND table_name IS NOT NULL THEN 'TABLE_NOT_ALLOWED' WHEN scope <> 'ALL_TABLES' AND table_name IS NULL THEN 'TABLE_REQUIRED'
            WHEN scope = 'PRIMARY_KEYS' AND n_keys = 0 THEN 'KEYS_REQUIRED' WHEN scope <> 'PRIMARY_KEYS' AND n_keys > 0 THEN 'KEYS_NOT_ALLOWED' WHEN n_keys > {KEY_LIMIT} THEN 'TOO_MANY_KEYS' END AS code
            FROM req) AS x WHERE code IS NOT NULL""", "req"),
    "request_status_violations": base.oracle(
        """SELECT * FROM (SELECT request_id, state, CASE WHEN state = 'FAILED' AND reason IS NULL THEN 'REASON_REQUIRED' WHEN state <> 'FAILED' AND reason IS NOT NULL THEN 'REASON_NOT_ALLOWED'
           WHEN scope <> 'PRIMARY_KEYS' AND n_missing > 0 THEN 'MISSING_KEYS_NOT_ALLOWED' END AS code FROM req WHERE state IS NOT NULL) AS x WHERE code IS NOT NULL""", "req"),
    "progress_violations": f"""
        SELECT * FROM (SELECT job_id, CASE WHEN (low IS NULL) <> (high IS NULL) THEN 'ONE_TOKEN' WHEN low IS NULL AND start_after IS NOT NULL THEN 'START_WITHOUT_TOKENS'
            WHEN start_after IS NOT NULL AND upper_bound IS NULL THEN 'START_WITHOUT_BOUND' WHEN low = high THEN 'EQUAL_TOKENS' WHEN low IS NOT NULL AND start_after IS DISTINCT FROM last_completed THEN 'START_IS_NOT_LAST'
            WHEN completed AND last_completed IS NULL THEN 'COMPLETED_WITHOUT_LAST' WHEN completed AND (start_after IS NOT NULL OR low IS NOT NULL) THEN 'COMPLETED_BUT_ACTIVE'
            WHEN last_completed IS NOT NULL AND upper_bound IS NULL THEN 'LAST_WITHOUT_BOUND' END AS code FROM ({_PROGRESS}) AS p) AS x WHERE code IS NOT NULL""",
    "dump_progress_done": f"SELECT job_id, upper_bound IS NULL OR coalesce(last_completed >= upper_bound, false) AS done FROM ({_PROGRESS}) AS p",
    "bootstrap_position_guard": "SELECT c_custkey AS source_id, c_custkey * 2 AS position FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')",
    "uncertainty_signals": "SELECT user_id, event_type AS reason, count(*) AS occurrences, min(event_id) AS first_event, max(event_id) AS last_event FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2",
    "schema_status": """
        SELECT c_custkey AS table_no, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'FULL_DUMP_REQUIRED'
            WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type = 'view') THEN 'UNCERTAIN' ELSE 'OK' END AS status FROM customer""",
    "schema_policy_decision": f"""
        WITH l AS ({_LIVE}) SELECT c.table_name, CASE WHEN c.table_name NOT IN (SELECT table_name FROM l) THEN 'TABLE_GONE' WHEN bool_or(live_type IS NULL) THEN 'COLUMN_GONE'
            WHEN bool_or(c.primary_key AND neutral_type <> live_type) THEN 'KEY_CHANGED' WHEN bool_or(neutral_type <> live_type) THEN 'SCHEMA_CHANGED' ELSE 'UNCHANGED' END AS decision
        FROM ({_CAT}) AS c LEFT JOIN l ON c.table_name = l.table_name AND c.column_name = l.column_name GROUP BY c.table_name""",
    "pk_compatibility": f"""
        WITH l AS ({_LIVE}), k AS (SELECT c.table_name, bool_and(live_type IS NOT NULL AND live_type = neutral_type) AS compatible FROM (SELECT * FROM ({_CAT}) AS a WHERE primary_key) AS c
            LEFT JOIN l ON c.table_name = l.table_name AND c.column_name = l.column_name GROUP BY 1) SELECT * FROM k""",
    "checkpoint_flush_points": _FOLD.format(
        first=f"SELECT user_id, event_id, i, 1 AS n, ts AS t0, {FLUSH_EVENTS} <= 1 AS hit FROM e WHERE i = 1",
        step=f"""SELECT e.user_id, e.event_id, e.i, CASE WHEN f.hit THEN 1 ELSE f.n + 1 END, CASE WHEN f.hit THEN e.ts ELSE f.t0 END,
                 CASE WHEN f.hit THEN 1 ELSE f.n + 1 END >= {FLUSH_EVENTS} OR e.ts - CASE WHEN f.hit THEN e.ts ELSE f.t0 END >= INTERVAL '{FLUSH_AGE}' FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1"""),
    "heartbeat_due": _FOLD.format(
        first="SELECT user_id, event_id, i, ts AS t0, true AS hit FROM e WHERE i = 1",
        step=f"""SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts - f.t0 >= INTERVAL '{BEAT}' THEN e.ts ELSE f.t0 END, e.ts - f.t0 >= INTERVAL '{BEAT}' FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1"""),
}
