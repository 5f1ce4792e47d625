"""Reconciliation, apply, verification and event queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import apply, reconcile
from tidemark.operators.ordering import numbered, running_sums
from tidemark.sources.tables import CUSTOMER, ORDERS, operation, read

from . import base

ORDER = ["emit_pos", "origin_rank", "ordinal"]


def _emitted(spark, sf_dir):
    return reconcile.emitted(base.chunk(spark, sf_dir), base.log(spark, sf_dir), CUSTOMER)


def reconcile_current_state(spark, sf_dir):
    return reconcile.current_state(_emitted(spark, sf_dir), "emit_pos")


def reconcile_emitted_stream(spark, sf_dir):
    return reconcile.emitted_stream(base.chunk(spark, sf_dir), base.log(spark, sf_dir), CUSTOMER)


def chunk_survivors(spark, sf_dir):
    return reconcile.survivors(base.chunk(spark, sf_dir), base.log(spark, sf_dir), CUSTOMER)


def chunk_collisions(spark, sf_dir):
    return reconcile.collisions(base.chunk(spark, sf_dir), base.log(spark, sf_dir), CUSTOMER)


def chunk_completed(spark, sf_dir):
    """For each chunk its rows, those emitted and those a log event excluded."""
    chunk, log = base.chunk(spark, sf_dir), base.log(spark, sf_dir)
    rows = chunk.groupBy("chunk_id", "lo", "hi").agg(F.count("*").alias("n_rows"))
    out = reconcile.collisions(chunk, log, CUSTOMER).groupBy("chunk_id").agg(F.count("*").alias("gone"))
    gone = F.coalesce("gone", F.lit(0).cast("long"))
    return rows.join(out, "chunk_id", "left").select("chunk_id", "lo", "hi", "n_rows", (F.col("n_rows") - gone).alias("emitted"), gone.alias("excluded"))


def _controls(spark, sf_dir):
    w = base.chunk(spark, sf_dir).select("chunk_id", "lo", "hi").distinct()
    return w.select("chunk_id", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.lit("LOW").alias("kind")), F.struct(F.col("hi").alias("pos"), F.lit("HIGH").alias("kind")))).alias("c")).select("chunk_id", "c.pos", "c.kind")


def watermark_phase(spark, sf_dir):
    return reconcile.phases(base.log(spark, sf_dir), _controls(spark, sf_dir))


def _sessions(spark, sf_dir):
    """Control rows of sessions, one for each user: event types stand for the shapes a control row can break in."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    token = F.when(k == 55, None).when(k % 4 == 0, "low").when(k % 4 == 1, "high").when(k % 4 == 2, "other").otherwise(" ")
    return e.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "view").alias("is_control"),
        F.when(k == 50, "UPDATE").otherwise("WATERMARK").alias("op"),
        F.when(k == 51, "SELECT").otherwise("LOG").alias("origin"),
        (k != 52).alias("table_ok"),
        (k != 53).alias("key_ok"),
        (k != 54).alias("has_after"),
        token.alias("token"),
        F.when(k == 56, "int").otherwise("string").alias("token_type"),
        F.lit("low").alias("low_token"),
        F.lit("high").alias("high_token"),
        F.when(F.col("event_type") == "purchase", "run-0").alias("run_id"),
        F.when(k == 58, "int").otherwise("string").alias("run_type"),
        F.when(F.col("user_id") % 5 != 0, "run-0").alias("own_run"),
    )


def watermark_violations(spark, sf_dir):
    return reconcile.violations(_sessions(spark, sf_dir))


def own_run_watermarks(spark, sf_dir):
    """Control rows of this run; rows of other runs and all-null bootstrap rows are dropped."""
    return _sessions(spark, sf_dir).filter("is_control AND run_id = 'run-0' AND trim(token) <> ''").select("session", "seq", "token")


def stale_token_drain(spark, sf_dir):
    """Foreign tokens that name a run are drained where the session has a run; the others stay, to be an error."""
    return reconcile.without_stale(_sessions(spark, sf_dir).filter("is_control")).select("session", "seq", "token", "run_id")


def control_event_filter(spark, sf_dir):
    """What sinks see of a stream in which heartbeats (errors) and watermarks (signups) are mixed."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "HEARTBEAT").when(F.col("event_type") == "signup", "WATERMARK").otherwise("UPDATE")
    return apply.without_controls(e.select("event_id", "user_id", op.alias("op")))


def captured_only(spark, sf_dir):
    captured = spark.createDataFrame([(CUSTOMER,)], "table_name string")
    return base.log(spark, sf_dir).join(F.broadcast(captured), "table_name", "left_semi").select("pos", "table_name", "k", "op")


def _batched(spark, sf_dir):
    return base.log(spark, sf_dir).withColumn("batch", F.call_function("div", "pos", F.lit(2 * base.BATCH_EVENTS)))


def apply_statement_runs(spark, sf_dir):
    runs = apply.statement_runs(_batched(spark, sf_dir), "batch", "pos")
    return runs.groupBy("batch", "run", "table_name", "kind").agg(F.count("*").alias("n_events"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def apply_run_dedupe(spark, sf_dir):
    return apply.dedupe_runs(apply.statement_runs(_batched(spark, sf_dir), "batch", "pos"), "batch", "pos")


def apply_current_state(spark, sf_dir):
    """The log alone, folded to the last write of each key."""
    return reconcile.current_state(base.log(spark, sf_dir), "pos")


def apply_deletes(spark, sf_dir):
    return apply.deletes(base.customer_rows(spark, sf_dir), base.log(spark, sf_dir), CUSTOMER)


def ndjson_lines(spark, sf_dir):
    rows = _emitted(spark, sf_dir)
    select = F.col("origin") == "SELECT"
    rows = rows.withColumns({
        "value_text": F.format_string("%.2f", "value"),
        "position": F.concat(F.lit("pos:"), F.col("emit_pos").cast("string")),
        "tx": F.when(~select, F.concat(F.lit("tx-"), F.floor(F.col("emit_pos") / 10).cast("string"))),
        "dump_id": F.when(select, F.lit("dump-1")),
    })
    return apply.ndjson(rows).select("emit_pos", "k", "line")


def mirror_customer(spark, sf_dir):
    stream = base.log(spark, sf_dir).filter(F.col("table_name") == CUSTOMER)
    return apply.mirror(base.customer_rows(spark, sf_dir), stream, "k", "pos")


def apply_composite(spark, sf_dir):
    """A mirror of line items, whose key has two columns, after a log in which some are repriced, some deleted and some
    new: two events for every third, of which the last counts."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"))
    m = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    log = rows.filter(m < 4).withColumn("turn", F.explode(F.when(m == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    log = log.select(
        F.when(m == 2, -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("l_orderkey"),
        "l_linenumber",
        (F.col("l_quantity") + 1 + F.col("turn")).alias("l_quantity"),
        F.when(m != 1, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(m == 0, "DELETE").when(m == 2, "INSERT").otherwise("UPDATE").alias("op"),
        F.col("turn").alias("pos"),
    )
    return apply.typed_mirror(rows, log, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"], "pos")


def full_dump_guards(spark, sf_dir):
    """Truncated tables, changed keys and short tuples in a log of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "view", ORDERS).otherwise(CUSTOMER).alias("table_name"),
        F.when(k == 7, "TRUNCATE").when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE").alias("op"),
        (F.col("event_type") != "view").alias("captured"),
        F.col("user_id").alias("key"),
        F.when(k % 10 == 1, F.col("user_id") + 1).when(k % 2 == 0, F.col("user_id")).alias("old_key"),
        F.when(k % 25 == 3, 2).otherwise(3).alias("n_columns"),
        F.lit(3).alias("table_columns"),
    )
    return apply.needs_full_dump(e)


def mirror_row_count(spark, sf_dir):
    return mirror_customer(spark, sf_dir).agg(F.count("*").alias("n_rows"))


def mirror_first_non_null(spark, sf_dir):
    return mirror_customer(spark, sf_dir).filter("value IS NOT NULL").orderBy("k").limit(1)


def mirror_event_summary(spark, sf_dir):
    rows = _emitted(spark, sf_dir)
    return rows.groupBy("table_name").agg(F.count("*").alias("total"), F.count_if(F.col("origin") == "LOG").alias("log_events"), F.count_if(F.col("origin") == "SELECT").alias("select_events"))


def table_mapping(spark, sf_dir):
    """Events with their target table: an override where there is one, else the same name."""
    overrides = spark.createDataFrame([(ORDERS, "dw.public.order_views")], "table_name string, mapped string")
    rows = base.log(spark, sf_dir).join(F.broadcast(overrides), "table_name", "left")
    return rows.groupBy("table_name", F.coalesce("mapped", "table_name").alias("target")).agg(F.count("*").alias("n_events"))


def build_change_events(spark, sf_dir):
    """Before and after images by operation: INSERT has only an after, DELETE only a before, UPDATE both."""
    log = base.log(spark, sf_dir)
    order = W.partitionBy("table_name", "k").orderBy("pos")
    before = F.lag("value").over(order)
    has_before, has_after = F.col("op") != "INSERT", F.col("op") != "DELETE"
    return log.select("pos", "table_name", "k", "op", has_before.alias("has_before"), F.when(has_before, before).alias("before_value"), has_after.alias("has_after"), F.when(has_after, F.col("value")).alias("after_value"))


def pk_update_violations(spark, sf_dir):
    """Updates whose key differs between the images need a full dump; here an order moving between customers."""
    e = read(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("event_id")
    moved = e.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("new_key"), F.lag(F.get_json_object("props", "$.k")).over(order).alias("old_key"))
    return moved.filter((F.col("event_type") == "purchase") & (F.col("old_key") != F.col("new_key"))).select("event_id", "user_id", "old_key", "new_key", F.lit("FULL_DUMP_REQUIRED").alias("code"))


def tx_assembly(spark, sf_dir):
    """One row for each committed transaction, its events in log order."""
    return apply.transactions(apply.transaction_segments(base.log(spark, sf_dir)))


def event_summary_by_table(spark, sf_dir):
    return base.log(spark, sf_dir).groupBy("table_name").agg(F.count("*").alias("n_events"))


def event_totals(spark, sf_dir):
    return base.log(spark, sf_dir).agg(F.count("*").alias("observed"), F.least(F.count("*"), F.lit(512).cast("long")).alias("retained"))


def recent_events(spark, sf_dir):
    """The last 512 events in arrival order: a top-k, then numbers for the few rows left."""
    top = base.log(spark, sf_dir).select("pos", "table_name", "k", "op").orderBy(F.desc("pos")).limit(512)
    return top.withColumn("arrival", F.row_number().over(W.orderBy("pos")))


def recent_events_for_table(spark, sf_dir):
    top = base.log(spark, sf_dir).filter(F.col("table_name") == ORDERS).select("pos", "k", "op").orderBy(F.desc("pos")).limit(100)
    return top.withColumn("arrival", F.row_number().over(W.orderBy("pos")))


def resume_after_checkpoint(spark, sf_dir):
    """Events after the last commit that was acknowledged (half of the log)."""
    checkpoint = read(spark, sf_dir, "events").count() // 2 * 2
    return base.log(spark, sf_dir).filter(F.col("pos") > checkpoint).select("pos", "table_name", "k", "op")


def final_state_diff(spark, sf_dir):
    """Rows in which the source's final state and the reconciled one differ: an image is compared with null-safe equality."""
    a = mirror_customer(spark, sf_dir).select("k", F.col("value").alias("source_value"), F.lit(True).alias("in_source"))
    b = reconcile_current_state(spark, sf_dir).filter(F.col("table_name") == CUSTOMER).select("k", F.col("value").alias("sink_value"), F.lit(True).alias("in_sink"))
    both = a.join(b, "k", "full_outer")
    differs = ~(F.col("source_value").eqNullSafe(F.col("sink_value")) & F.col("in_source").eqNullSafe(F.col("in_sink")))
    return both.filter(differs).select("k", "source_value", "sink_value", F.coalesce("in_source", F.lit(False)).alias("in_source"), F.coalesce("in_sink", F.lit(False)).alias("in_sink"))


def _ledger(spark, sf_dir):
    """Source mutations: the log's events of customer with the image before them, numbered over all."""
    return numbered(_images(spark, sf_dir), ["pos"], "idx")


def _images(spark, sf_dir):
    """pos, k, op, before, value (the image after it): a key's before image is what its last event left."""
    rows = base.log(spark, sf_dir).filter(F.col("table_name") == CUSTOMER)
    before = F.when(F.col("op") != "INSERT", F.lag("value").over(W.partitionBy("k").orderBy("pos")))
    return rows.select("pos", "k", "op", before.alias("before"), "value")


def _surfaced(spark, sf_dir):
    """What a sink recorded: every event but those of every 97th position, and those of every 5th twice."""
    rows = _images(spark, sf_dir).filter((F.col("pos") / 2).cast("long") % 97 != 0)
    times = F.when((F.col("pos") / 2).cast("long") % 5 == 0, 2).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(F.col("pos").alias("log_pos"), "copy", "k", "op", "before", "value")


def ledger_match(spark, sf_dir):
    """Each surfaced LOG event with the first mutation of its key that has the same operation and images before and after."""
    l, s = _ledger(spark, sf_dir), _surfaced(spark, sf_dir)
    first = l.groupBy("k", "op", "before", "value").agg(F.min("idx").alias("idx"))
    hit = (s["k"] == first["k"]) & (s["op"] == first["op"]) & s["before"].eqNullSafe(first["before"]) & s["value"].eqNullSafe(first["value"])
    return s.join(first, hit).select("log_pos", "copy", s["k"], s["op"], "idx")


def ledger_missing(spark, sf_dir):
    l, s = _ledger(spark, sf_dir), _surfaced(spark, sf_dir)
    return l.join(s.select(F.col("log_pos").alias("pos")).distinct(), "pos", "left_anti").select("idx", "pos", "k", "op")


def ledger_skips(spark, sf_dir):
    """Surfaced events that come more than one mutation after all before them."""
    l, s = _ledger(spark, sf_dir), _surfaced(spark, sf_dir)
    seen = s.select(F.col("log_pos").alias("pos")).distinct().join(l.select("pos", "idx"), "pos")
    return numbered(seen, ["pos"], "n").withColumn("skipped", F.col("idx") - F.col("n")).transform(_steps)


def _steps(df):
    """Rows at which the number of skipped mutations rises, found by a join on the row number before."""
    before = df.select((F.col("n") + 1).alias("n"), F.col("skipped").alias("before"))
    return df.join(before, "n", "left").filter(F.col("skipped") > F.coalesce("before", F.lit(0))).select("pos", "idx", (F.col("skipped") - F.coalesce("before", F.lit(0))).alias("skipped"))


def refresh_contradictions(spark, sf_dir):
    """SELECT rows whose value isn't that of the key's last LOG event before them."""
    rows = _emitted(spark, sf_dir).filter(F.col("table_name") == CUSTOMER)
    order = W.partitionBy("k").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("origin") == "LOG", F.struct("op", "value")), ignorenulls=True).over(order)
    checked = rows.withColumn("last", last).filter("origin = 'SELECT' AND last IS NOT NULL")
    return checked.filter((F.col("last.op") == "DELETE") | ~F.col("last.value").eqNullSafe(F.col("value"))).select("k", "emit_pos", "value", F.col("last.op").alias("log_op"), F.col("last.value").alias("log_value"))


def mutation_coverage(spark, sf_dir):
    """LOG events that came out of reconciling against the mutations that the source made: none may be lost on the way."""
    out = _emitted(spark, sf_dir).filter((F.col("origin") == "LOG") & (F.col("table_name") == CUSTOMER)).select(F.lit(1).alias("out"))
    made = read(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.lit(0).alias("out"))
    counted = out.unionByName(made).agg(F.count_if(F.col("out") == 1).alias("log_events"), F.count_if(F.col("out") == 0).alias("mutations"))
    return counted.select("log_events", "mutations", (F.col("log_events") >= F.col("mutations")).alias("covered"))


def mutation_coverage_by_op(spark, sf_dir):
    """The same by operation for a sink that has lost events and has others twice: a repeat covers nothing."""
    made = read(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy(operation(F.col("event_type")).alias("op")).agg(F.count("*").alias("mutations"))
    out = _surfaced(spark, sf_dir).groupBy("op").agg(F.count("*").alias("events"), F.count_distinct("log_pos").alias("surfaced"))
    return made.join(out, "op", "left").select("op", "mutations", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("surfaced", F.lit(0)).alias("surfaced"), (F.coalesce("surfaced", F.lit(0)) >= F.col("mutations")).alias("covered"))


def heartbeat_interference(spark, sf_dir):
    """Heartbeats on this run's stream that another run wrote after this run was seen."""
    e = read(spark, sf_dir, "events").filter("event_type IN ('error', 'signup')").select("event_id", (F.col("event_type") == "signup").alias("is_own"), (F.col("user_id") % 2 == 0).alias("own_stream"))
    counted = running_sums(e, ["event_id"], {"own_seen": F.when(F.col("is_own") & F.col("own_stream"), 1).otherwise(0)})
    code = F.when(F.col("is_own") & ~F.col("own_stream"), "OWN_RUN_ON_FOREIGN_STREAM").when(~F.col("is_own") & F.col("own_stream") & (F.col("own_seen") > 0), "FOREIGN_RUN_ON_OWN_STREAM")
    return counted.withColumn("code", code).filter("code IS NOT NULL").select("event_id", "code")


def tap_chunk_events(spark, sf_dir):
    """What an observer sees of the chunks: selection, both watermarks, each collision, completion, in log order."""
    done = chunk_completed(spark, sf_dir)
    kinds = [("watermark.written", "lo", 0), ("chunk.selected", "lo", 1), ("watermark.received", "hi", 3), ("chunk.completed", "hi", 4)]
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(p).alias("pos"), F.lit(r).alias("rank")) for k, p, r in kinds]))
    rows = done.select("chunk_id", parts.alias("e")).select("chunk_id", "e.*", F.lit(-1).cast("long").alias("k"))
    hits = chunk_collisions(spark, sf_dir).select("chunk_id", F.lit("chunk.collision").alias("kind"), F.col("cause_pos").alias("pos"), F.lit(2).alias("rank"), "k")
    return numbered(rows.unionByName(hits), ["pos", "rank", "chunk_id", "k"], "tap_seq").select("tap_seq", "kind", "chunk_id", "pos", "k")


def tap_chunk_summary(spark, sf_dir):
    rows = tap_chunk_events(spark, sf_dir)
    return rows.groupBy("chunk_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "chunk.collision").alias("collisions"), F.min("pos").alias("opened"), F.max("pos").alias("closed"))


def tap_seq_gaps(spark, sf_dir):
    """Per run (user), gaps and repeats in a sequence; here the run's event numbers divided by a stride."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.call_function("div", "event_id", F.lit(150)).alias("seq"))
    order = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.max("seq").over(order)
    code = F.when(F.col("seq") > F.col("top") + 1, "GAP").when(F.col("seq") <= F.col("top"), "DUPLICATE")
    return e.withColumn("top", before).withColumn("code", code).filter("code IS NOT NULL").select("user_id", "event_id", "seq", "top", "code")


def runtime_metrics(spark, sf_dir):
    """Counters and timers by tag: count, total and largest milliseconds; values are whole microseconds."""
    e = read(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("micros"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("micros").alias("total_micros"), F.max("micros").alias("max_micros"))


def scenario_mutations(spark, sf_dir):
    """A deterministic stream of mutations, one for each event: six kinds in turn over hot and new ids."""
    kinds = ["insert-widget", "update-widget", "insert-gadget", "update-gadget", "delete-widget", "delete-gadget"]
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (i % 6 + 1).cast("int"))
    fresh = F.call_function("div", i, F.lit(6)) + F.when(F.split(kind, "-")[1] == "widget", 100).otherwise(200)
    return read(spark, sf_dir, "events").select(i.alias("idx"), kind.alias("kind"), F.when(kind.startswith("insert"), fresh).otherwise(i % 7 + 1).alias("id"))


QUERIES = {
    f.__name__: f
    for f in (
        reconcile_current_state, reconcile_emitted_stream, chunk_survivors, chunk_collisions, chunk_completed, watermark_phase, watermark_violations,
        own_run_watermarks, stale_token_drain, control_event_filter, captured_only, apply_statement_runs, apply_run_dedupe, apply_current_state,
        apply_deletes, apply_composite, full_dump_guards, ndjson_lines, mirror_customer, mirror_row_count, mirror_first_non_null, mirror_event_summary, table_mapping, build_change_events,
        pk_update_violations, tx_assembly, event_summary_by_table, event_totals, recent_events, recent_events_for_table, resume_after_checkpoint,
        final_state_diff, ledger_match, ledger_missing, ledger_skips, refresh_contradictions, mutation_coverage, mutation_coverage_by_op, heartbeat_interference,
        tap_chunk_events, tap_chunk_summary, tap_seq_gaps, runtime_metrics, scenario_mutations,
    )
}

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_SESSIONS = f"""
    SELECT user_id AS session, event_id AS seq, event_type <> 'view' AS is_control, CASE WHEN {_K} = 50 THEN 'UPDATE' ELSE 'WATERMARK' END AS op,
           CASE WHEN {_K} = 51 THEN 'SELECT' ELSE 'LOG' END AS origin, {_K} <> 52 AS table_ok, {_K} <> 53 AS key_ok, {_K} <> 54 AS has_after,
           CASE WHEN {_K} = 55 THEN NULL ELSE CASE {_K} % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'other' ELSE ' ' END END AS token,
           CASE WHEN {_K} = 56 THEN 'int' ELSE 'string' END AS token_type, CASE WHEN {_K} = 58 THEN 'int' ELSE 'string' END AS run_type,
           CASE WHEN event_type = 'purchase' THEN 'run-0' END AS run_id, CASE WHEN user_id % 5 <> 0 THEN 'run-0' END AS own_run FROM events"""
_RUNS = f"""
    SELECT *, CAST(sum(new) OVER (PARTITION BY batch ORDER BY pos) AS BIGINT) AS run FROM (
        SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER o OR table_name IS DISTINCT FROM lag(table_name) OVER o THEN 1 ELSE 0 END AS new
        FROM (SELECT *, pos // {2 * base.BATCH_EVENTS} AS batch, CASE WHEN op = 'DELETE' THEN 'DELETE' ELSE 'UPSERT' END AS kind FROM log) AS a
        WINDOW o AS (PARTITION BY batch ORDER BY pos)) AS b"""
_LASTOP = f"SELECT k, arg_max(op, pos) AS op, max(pos) AS pos FROM log WHERE table_name = '{CUSTOMER}' GROUP BY k"
_MIRROR = f"""
    SELECT coalesce(c.c_custkey, l.k) AS k, CASE WHEN l.k IS NULL THEN c.c_acctbal ELSE l.value END AS value
    FROM customer c FULL JOIN (SELECT k, op, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS r FROM log WHERE table_name = '{CUSTOMER}') AS x WHERE r = 1) AS l
    ON c.c_custkey = l.k WHERE coalesce(l.op, '') <> 'DELETE'"""
_COLLISIONS = f"""
    SELECT chunk_id, k, pos AS cause_pos, op AS cause_op FROM (
        SELECT c.chunk_id, c.k, l.pos, l.op, row_number() OVER (PARTITION BY c.chunk_id, c.k ORDER BY l.pos) AS r
        FROM chunk c JOIN log l ON l.table_name = '{CUSTOMER}' AND l.k = c.k AND l.pos > c.lo AND l.pos < c.hi) AS x WHERE r = 1"""
_DONE = f"""
    SELECT chunk_id, lo, hi, n_rows, n_rows - coalesce(gone, 0) AS emitted, coalesce(gone, 0) AS excluded
    FROM (SELECT chunk_id, lo, hi, count(*) AS n_rows FROM chunk GROUP BY ALL) AS a LEFT JOIN (SELECT chunk_id, count(*) AS gone FROM ({_COLLISIONS}) AS c GROUP BY chunk_id) AS b USING (chunk_id)"""
_IMAGES = f"SELECT pos, k, op, CASE WHEN op <> 'INSERT' THEN lag(value) OVER (PARTITION BY k ORDER BY pos) END AS before, value FROM log WHERE table_name = '{CUSTOMER}'"
_LEDGER = f"SELECT row_number() OVER (ORDER BY pos) AS idx, * FROM ({_IMAGES}) AS i"
_SURFACED = f"""
    SELECT pos AS log_pos, copy, k, op, before, value FROM ({_IMAGES}) AS i, (VALUES (1), (2)) AS c(copy)
    WHERE (pos // 2) % 97 <> 0 AND (copy = 1 OR (pos // 2) % 5 = 0)"""
_TAP = f"""
    SELECT row_number() OVER (ORDER BY pos, rank, chunk_id, k) AS tap_seq, kind, chunk_id, pos, k FROM (
        SELECT chunk_id, 'watermark.written' AS kind, lo AS pos, 0 AS rank, -1 AS k FROM done UNION ALL SELECT chunk_id, 'chunk.selected', lo, 1, -1 FROM done
        UNION ALL SELECT chunk_id, 'watermark.received', hi, 3, -1 FROM done UNION ALL SELECT chunk_id, 'chunk.completed', hi, 4, -1 FROM done
        UNION ALL SELECT chunk_id, 'chunk.collision', cause_pos, 2, k FROM ({_COLLISIONS}) AS c) AS x"""


def _json_line() -> str:
    return (
        """'{"tableId":"' || table_name || '","operationType":"' || op || '","captureOrigin":"' || origin || '","primaryKey":{"k":' || k || '},"beforeRow":null,"afterRow":' ||"""
        """ CASE WHEN op = 'DELETE' THEN 'null' ELSE '{"k":' || k || ',"value":"' || printf('%.2f', value) || '"}' END || ',"sourcePosition":"pos:' || emit_pos || '","transactionId":' ||"""
        """ CASE WHEN origin = 'SELECT' THEN 'null' ELSE '"tx-' || (emit_pos // 10) || '"' END || ',"dumpId":' || CASE WHEN origin = 'SELECT' THEN '"dump-1"' ELSE 'null' END || '}'"""
    )


ORACLES = {
    "reconcile_current_state": base.oracle("SELECT * FROM state", "state"),
    "reconcile_emitted_stream": base.oracle("SELECT emit_seq, emit_pos, origin, table_name, op, k, value FROM stream", "stream"),
    "chunk_survivors": base.oracle("SELECT k, value, ordinal, chunk_id, lo, hi FROM survivors", "survivors"),
    "chunk_collisions": base.oracle(_COLLISIONS, "log", "chunk"),
    "chunk_completed": base.oracle(_DONE, "log", "chunk"),
    "watermark_phase": base.oracle(
        """SELECT pos, CAST(lows AS BIGINT) AS lows, CAST(highs AS BIGINT) AS highs, CASE WHEN lows > highs THEN 'IN_WINDOW' WHEN lows = 0 THEN 'BEFORE' ELSE 'BETWEEN' END AS phase FROM (
           SELECT pos, kind, sum(CASE WHEN kind = 'LOW' THEN 1 ELSE 0 END) OVER o AS lows, sum(CASE WHEN kind = 'HIGH' THEN 1 ELSE 0 END) OVER o AS highs
           FROM (SELECT pos, 'EVENT' AS kind FROM log UNION ALL SELECT DISTINCT lo, 'LOW' FROM chunk UNION ALL SELECT DISTINCT hi, 'HIGH' FROM chunk) AS a WINDOW o AS (ORDER BY pos)) AS b
           WHERE kind = 'EVENT'""", "log", "chunk"),
    "watermark_violations": f"""
        WITH s AS ({_SESSIONS}), t AS (SELECT *,
            coalesce(sum(CASE WHEN is_control AND token = 'low' THEN 1 ELSE 0 END) OVER o, 0) > 0 AS saw_low,
            coalesce(sum(CASE WHEN is_control AND token = 'high' THEN 1 ELSE 0 END) OVER o, 0) > 0 AS saw_high
            FROM s WINDOW o AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT * FROM (SELECT session, seq, CASE WHEN op <> 'WATERMARK' THEN 'NOT_A_WATERMARK' WHEN origin <> 'LOG' THEN 'WRONG_ORIGIN' WHEN NOT table_ok THEN 'WRONG_TABLE'
            WHEN NOT key_ok THEN 'WRONG_KEY' WHEN NOT has_after THEN 'NO_AFTER_ROW' WHEN token IS NULL THEN 'BLANK_TOKEN'
            WHEN token_type <> 'string' THEN 'TOKEN_IS_NO_TEXT' WHEN trim(token) = '' THEN 'BLANK_TOKEN' WHEN token = 'other' AND own_run IS NOT NULL AND run_id IS NOT NULL AND run_type <> 'string' THEN 'RUN_IS_NO_TEXT'
            WHEN token = 'other' AND (run_id IS NULL OR own_run IS NULL OR run_type <> 'string') THEN 'UNKNOWN_TOKEN' WHEN token = 'low' AND saw_low THEN 'DUPLICATE_LOW' WHEN token = 'low' AND saw_high THEN 'LOW_AFTER_HIGH'
            WHEN token = 'high' AND saw_high THEN 'DUPLICATE_HIGH' WHEN token = 'high' AND NOT saw_low THEN 'HIGH_BEFORE_LOW' END AS code FROM t WHERE is_control) AS u WHERE code IS NOT NULL""",
    "own_run_watermarks": f"SELECT session, seq, token FROM ({_SESSIONS}) AS s WHERE is_control AND run_id = 'run-0' AND trim(token) <> ''",
    "stale_token_drain": f"SELECT session, seq, token, run_id FROM ({_SESSIONS}) AS s WHERE is_control AND NOT (coalesce(token, '') = 'other' AND token_type = 'string' AND run_id IS NOT NULL AND own_run IS NOT NULL AND run_type = 'string')",
    "control_event_filter": "SELECT event_id, user_id, 'UPDATE' AS op FROM events WHERE event_type NOT IN ('error', 'signup')",
    "captured_only": base.oracle(f"SELECT pos, table_name, k, op FROM log WHERE table_name = '{CUSTOMER}'", "log"),
    "apply_statement_runs": base.oracle(f"SELECT batch, run, table_name, kind, count(*) AS n_events, min(pos) AS first_pos, max(pos) AS last_pos FROM ({_RUNS}) AS r GROUP BY batch, run, table_name, kind", "log"),
    "apply_run_dedupe": base.oracle(
        f"""SELECT batch, run, table_name, kind, k, first_seq, pos AS last_seq, op, value FROM (SELECT *, min(pos) OVER w AS first_seq, row_number() OVER (PARTITION BY batch, run, k ORDER BY pos DESC) AS r
            FROM ({_RUNS}) AS a WINDOW w AS (PARTITION BY batch, run, k)) AS b WHERE r = 1""", "log"),
    "apply_current_state": base.oracle("SELECT table_name, k, value FROM (SELECT *, row_number() OVER (PARTITION BY table_name, k ORDER BY pos DESC) AS r FROM log) AS x WHERE r = 1 AND op <> 'DELETE'", "log"),
    "apply_deletes": base.oracle(f"SELECT c_custkey AS k, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT k FROM ({_LASTOP}) AS l WHERE op = 'DELETE')", "log"),
    "apply_composite": """
        WITH r AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, (l_orderkey + l_linenumber) % 6 AS m FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, l_linenumber, l_quantity + CASE m WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS l_quantity, CASE WHEN m <> 1 THEN l_extendedprice END AS l_extendedprice FROM r WHERE m <> 0
        UNION ALL SELECT -1 - l_orderkey, l_linenumber, l_quantity + 1, l_extendedprice FROM r WHERE m = 2""",
    "full_dump_guards": f"""
        SELECT * FROM (SELECT event_id AS pos, '{CUSTOMER}' AS table_name, CASE WHEN {_K} = 7 THEN 'TRUNCATED' WHEN event_type <> 'signup' AND {_K} % 10 = 1 THEN 'KEY_CHANGED'
            WHEN {_K} % 25 = 3 THEN 'SHORT_TUPLE' END AS code FROM events WHERE event_type <> 'view') AS x WHERE code IS NOT NULL""",
    "ndjson_lines": base.oracle(f"SELECT emit_pos, k, {_json_line()} AS line FROM emitted", "emitted"),
    "mirror_customer": base.oracle(_MIRROR, "log"),
    "mirror_row_count": base.oracle(f"SELECT count(*) AS n_rows FROM ({_MIRROR}) AS m", "log"),
    "mirror_first_non_null": base.oracle(f"SELECT * FROM ({_MIRROR}) AS m WHERE value IS NOT NULL ORDER BY k LIMIT 1", "log"),
    "mirror_event_summary": base.oracle("SELECT table_name, count(*) AS total, count(*) FILTER (WHERE origin = 'LOG') AS log_events, count(*) FILTER (WHERE origin = 'SELECT') AS select_events FROM emitted GROUP BY table_name", "emitted"),
    "table_mapping": base.oracle(f"SELECT table_name, CASE WHEN table_name = '{ORDERS}' THEN 'dw.public.order_views' ELSE table_name END AS target, count(*) AS n_events FROM log GROUP BY table_name", "log"),
    "build_change_events": base.oracle(
        """SELECT pos, table_name, k, op, op <> 'INSERT' AS has_before, CASE WHEN op <> 'INSERT' THEN lag(value) OVER (PARTITION BY table_name, k ORDER BY pos) END AS before_value,
           op <> 'DELETE' AS has_after, CASE WHEN op <> 'DELETE' THEN value END AS after_value FROM log""", "log"),
    "pk_update_violations": """
        SELECT event_id, user_id, old_key, new_key, 'FULL_DUMP_REQUIRED' AS code FROM (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS new_key,
            lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY event_id) AS old_key FROM events) AS x WHERE event_type = 'purchase' AND old_key <> new_key""",
    "tx_assembly": base.oracle("SELECT tx, max(pos) AS commit_pos, CAST(count(*) AS INTEGER) AS n_events, string_agg(op, ',' ORDER BY pos) AS ops FROM log GROUP BY tx", "log"),
    "event_summary_by_table": base.oracle("SELECT table_name, count(*) AS n_events FROM log GROUP BY table_name", "log"),
    "event_totals": "SELECT count(*) AS observed, least(count(*), 512) AS retained FROM events",
    "recent_events": base.oracle("SELECT *, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS arrival FROM (SELECT pos, table_name, k, op FROM log ORDER BY pos DESC LIMIT 512) AS x", "log"),
    "recent_events_for_table": base.oracle(f"SELECT *, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS arrival FROM (SELECT pos, k, op FROM log WHERE table_name = '{ORDERS}' ORDER BY pos DESC LIMIT 100) AS x", "log"),
    "resume_after_checkpoint": base.oracle("SELECT pos, table_name, k, op FROM log WHERE pos > (SELECT m // 2 * 2 FROM sizes)", "log"),
    "final_state_diff": base.oracle(
        f"""SELECT coalesce(a.k, b.k) AS k, a.value AS source_value, b.value AS sink_value, a.k IS NOT NULL AS in_source, b.k IS NOT NULL AS in_sink
            FROM ({_MIRROR}) AS a FULL JOIN (SELECT k, value FROM state WHERE table_name = '{CUSTOMER}') AS b ON a.k = b.k
            WHERE a.value IS DISTINCT FROM b.value OR a.k IS NULL OR b.k IS NULL""", "state"),
    "ledger_match": base.oracle(
        f"""WITH f AS (SELECT k, op, before, value, min(idx) AS idx FROM ({_LEDGER}) AS l GROUP BY k, op, before, value)
            SELECT log_pos, copy, s.k, s.op, idx FROM ({_SURFACED}) AS s JOIN f ON s.k = f.k AND s.op = f.op AND s.before IS NOT DISTINCT FROM f.before AND s.value IS NOT DISTINCT FROM f.value""", "log").replace(" WITH f AS", ", f AS", 1),
    "ledger_missing": base.oracle(f"SELECT idx, pos, k, op FROM ({_LEDGER}) AS l WHERE pos NOT IN (SELECT log_pos FROM ({_SURFACED}) AS s)", "log"),
    "ledger_skips": base.oracle(
        f"""SELECT pos, idx, idx - before - 1 AS skipped FROM (SELECT pos, idx, coalesce(lag(idx) OVER (ORDER BY pos), 0) AS before FROM ({_LEDGER}) AS l
            WHERE pos IN (SELECT log_pos FROM ({_SURFACED}) AS s)) AS x WHERE idx > before + 1""", "log"),
    "refresh_contradictions": base.oracle(
        f"""SELECT k, emit_pos, value, log_op, log_value FROM (SELECT *, last_value(CASE WHEN origin = 'LOG' THEN op END IGNORE NULLS) OVER o AS log_op,
            (last_value(CASE WHEN origin = 'LOG' THEN {{'v': value}} END IGNORE NULLS) OVER o).v AS log_value FROM emitted WHERE table_name = '{CUSTOMER}'
            WINDOW o AS (PARTITION BY k ORDER BY emit_pos, origin_rank, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS x
            WHERE origin = 'SELECT' AND log_op IS NOT NULL AND (log_op = 'DELETE' OR log_value IS DISTINCT FROM value)""", "emitted"),
    "mutation_coverage": base.oracle(
        f"""SELECT a AS log_events, b AS mutations, a >= b AS covered FROM (SELECT (SELECT count(*) FROM emitted WHERE origin = 'LOG' AND table_name = '{CUSTOMER}') AS a,
            (SELECT count(*) FROM log WHERE table_name = '{CUSTOMER}') AS b) AS x""", "emitted"),
    "mutation_coverage_by_op": base.oracle(
        f"""SELECT m.op, mutations, coalesce(events, 0) AS events, coalesce(surfaced, 0) AS surfaced, coalesce(surfaced, 0) >= mutations AS covered
            FROM (SELECT op, count(*) AS mutations FROM log WHERE table_name = '{CUSTOMER}' GROUP BY op) AS m
            LEFT JOIN (SELECT op, count(*) AS events, count(DISTINCT log_pos) AS surfaced FROM ({_SURFACED}) AS s GROUP BY op) AS x USING (op)""", "log"),
    "heartbeat_interference": """
        SELECT * FROM (SELECT event_id, CASE WHEN is_own AND NOT own_stream THEN 'OWN_RUN_ON_FOREIGN_STREAM' WHEN NOT is_own AND own_stream AND
            max(CASE WHEN is_own AND own_stream THEN 1 ELSE 0 END) OVER (ORDER BY event_id) > 0 THEN 'FOREIGN_RUN_ON_OWN_STREAM' END AS code
        FROM (SELECT event_id, event_type = 'signup' AS is_own, user_id % 2 = 0 AS own_stream FROM events WHERE event_type IN ('error', 'signup')) AS a) AS b WHERE code IS NOT NULL""",
    "tap_chunk_events": base.oracle(_TAP, "log", "chunk").replace(", chunk AS", ", chunk AS", 1),
    "tap_chunk_summary": "",
    "tap_seq_gaps": """
        SELECT * FROM (SELECT user_id, event_id, seq, top, CASE WHEN seq > top + 1 THEN 'GAP' WHEN seq <= top THEN 'DUPLICATE' END AS code FROM (
            SELECT user_id, event_id, event_id // 150 AS seq, max(event_id // 150) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) AS a) AS b
        WHERE code IS NOT NULL""",
    "runtime_metrics": "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_micros, max(CAST(round(value * 100) AS BIGINT)) AS max_micros FROM events GROUP BY event_type",
    "scenario_mutations": """
        SELECT event_id AS idx, kind, CASE WHEN kind LIKE 'insert%' THEN event_id // 6 + CASE WHEN kind LIKE '%widget' THEN 100 ELSE 200 END ELSE event_id % 7 + 1 END AS id
        FROM (SELECT event_id, ['insert-widget', 'update-widget', 'insert-gadget', 'update-gadget', 'delete-widget', 'delete-gadget'][event_id % 6 + 1] AS kind FROM events) AS x""",
}
_TAP_INLINE = _TAP.replace("FROM done", f"FROM ({_DONE}) AS done")
ORACLES["tap_chunk_events"] = base.oracle(_TAP_INLINE, "log", "chunk")
ORACLES["tap_chunk_summary"] = base.oracle(
    f"SELECT chunk_id, count(*) AS n_events, count(*) FILTER (WHERE kind = 'chunk.collision') AS collisions, min(pos) AS opened, max(pos) AS closed FROM ({_TAP_INLINE}) AS t GROUP BY chunk_id", "log", "chunk"
)
