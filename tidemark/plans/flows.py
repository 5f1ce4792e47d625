"""Queries that go through the library's own source, sink and streaming state."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import apply, chunks, preflight
from tidemark.operators.ordering import numbered
from tidemark.runtime import shared_dir
from tidemark.sources import log_source
from tidemark.sources.tables import CUSTOMER, as_changes, read
from tidemark.streaming import sinks, stateful

from . import base, streams


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def change_log_source(spark, sf_dir):
    """Events behind the last commit that was acknowledged (half of the log), read from that position by the source."""
    half = read(spark, sf_dir, "events").count() // 2
    rows = log_source.read_log(spark, f"{sf_dir}/events.parquet", position="event_id", start=half)
    return as_changes(spark, sf_dir, rows.filter(F.col("event_id") > half)).select("pos", "table_name", "k", "op")


def log_stream_to_sink(spark, sf_dir):
    """The log streamed by position into the sink of lines, in two runs of which the second goes on at the first's
    offset and finds nothing; what is committed."""
    folder = _folder(spark, "stream")
    for _ in range(2):
        events = log_source.stream_log(spark, f"{sf_dir}/events.parquet", position="event_id")
        rows = as_changes(spark, sf_dir, events)
        line = F.concat_ws(" ", "pos", "table_name", "k", "op").alias("line")
        sinks.stream_lines(rows.select(line), f"{folder}/lines", f"{folder}/checkpoint").awaitTermination()
    return sinks.read_lines(spark, f"{folder}/lines")


def ndjson_sink(spark, sf_dir):
    """The emitted stream as lines, written twice as the same batch: one copy is committed."""
    folder = _folder(spark, "ndjson")
    rows = streams.ndjson_lines(spark, sf_dir)
    for _ in range(2):
        sinks.write_lines(rows, folder, "emitted")
    return sinks.read_lines(spark, folder)


def reconcile_state_stream(spark, sf_dir):
    """The reconciled stream by streaming state: log, dumped rows and HIGHs as one recorded log."""
    folder = _folder(spark, "records")
    chunk = base.chunk(spark, sf_dir)
    records = stateful.log_records(base.log(spark, sf_dir)).unionByName(stateful.dump_records(chunk, CUSTOMER))
    records.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{folder}/log")
    span = chunk.agg(F.coalesce(F.max(F.col("hi") - F.col("lo")), F.lit(0))).first()[0]
    stream = stateful.reconcile(spark.readStream.schema(stateful.RECORD).parquet(f"{folder}/log"), span=span)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stateful.EMITTED).parquet(f"{folder}/rows")
    return numbered(rows, ["emit_pos", "origin_rank", "ordinal"], "emit_seq").drop("origin_rank", "ordinal")


def tx_event_numbers(spark, sf_dir):
    """Each event's number in its transaction, from counts of segments: no transaction is gathered."""
    return apply.numbered_in_transactions(base.log(spark, sf_dir), positions=64).select("pos", "tx", "tx_seq")


def dump_windows(spark, sf_dir):
    """Where the windows of a dump of orders end: 1,000 rows each, planned by one pass over the keys."""
    return chunks.window_ends(read(spark, sf_dir, "orders"), "o_orderkey", 1000)


def source_preflight(spark, sf_dir):
    """Findings on sources, one for each nation: settings and slots by its number, its suppliers as tables, and a
    publication for each region of it."""
    n = read(spark, sf_dir, "nation").withColumn("source", F.col("n_name"))
    k = F.col("n_nationkey")
    kind = F.when(k % 2 == 0, "mysql").otherwise("postgres").alias("kind")
    names = F.when(k % 2 == 0, F.array(F.lit("log_bin"), F.lit("binlog_format"), F.lit("BINLOG_ROW_IMAGE"))).otherwise(F.array(F.lit("wal_level"), F.lit("server_version")))
    value = F.when(F.col("name") == "log_bin", "on").when(F.col("name") == "binlog_format", F.when(k % 6 == 0, "STATEMENT").otherwise("ROW")).when(F.col("name") == "BINLOG_ROW_IMAGE", F.when(k % 8 == 0, "MINIMAL").otherwise("full"))
    value = value.otherwise(F.when(k % 3 == 0, "replica").otherwise("logical"))
    settings = n.withColumn("name", F.explode(names)).filter(~((k % 10 == 4) & (F.col("name") == "binlog_format"))).select("source", kind, "name", value.alias("value"))
    s = F.col("s_suppkey")
    tables = read(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == k).select(
        "source", kind, F.when(s % 11 == 0, F.concat(F.lit("a."), "s_name")).otherwise(F.col("s_name")).alias("table_name"), (s % 7).alias("key_columns"),
        F.when(s % 3 == 0, "DEFAULT").otherwise("FULL").alias("replica_identity"), (F.col("s_acctbal") > 0).alias("published"),
    )
    own = n.filter(k % 2 == 1)
    publications = own.select("source", F.concat_ws("_", F.lit("pub"), "n_regionkey").alias("publication"), F.lit(True).alias("inserts"), (k % 5 != 0).alias("updates"), (k % 7 != 0).alias("deletes"), (k % 9 != 0).alias("truncates"), (k != 11).alias("by_root"))
    slots = own.select("source", F.lit("slot").alias("slot"), F.when(k == 13, "test_decoding").otherwise("pgoutput").alias("plugin"), "n_name", (k == 17).alias("active"), (k == 19).alias("invalid"))
    slots = slots.select("source", "slot", "plugin", F.when(F.col("n_name").startswith("I"), "other").otherwise(F.col("n_name")).alias("database"), F.col("n_name").alias("own_database"), "active", "invalid")
    return preflight.findings(settings, tables, publications, slots)


def tap_row_events(spark, sf_dir):
    """What an observer sees of single rows, in log order: each event of the log, each row that a sink gets, a
    checkpoint behind every hundredth event, and each event that can't be applied."""
    log = base.log(spark, sf_dir)
    seen = log.select("pos", F.lit(0).alias("rank"), F.lit("cdc").alias("kind"), "k")
    wrong = streams.full_dump_guards(spark, sf_dir).select((F.col("pos") * 2).alias("pos"), F.lit(1).alias("rank"), F.lit("error").alias("kind"), F.lit(-1).cast("long").alias("k"))
    out = streams._emitted(spark, sf_dir).select(F.col("emit_pos").alias("pos"), F.lit(2).alias("rank"), F.lit("sink.event").alias("kind"), "k")
    flushed = numbered(log.select("pos"), ["pos"], "n").filter(F.col("n") % base.BATCH_EVENTS == 0)
    flushed = flushed.select("pos", F.lit(3).alias("rank"), F.lit("checkpoint.advanced").alias("kind"), F.lit(-1).cast("long").alias("k"))
    rows = seen.unionByName(wrong).unionByName(out).unionByName(flushed)
    return numbered(rows, ["pos", "rank", "k"], "tap_seq").select("tap_seq", "kind", "pos", "k")


def observed_counters(spark, sf_dir):
    """Counters and a gauge of a reconciling run, taken while its rows go to the sink of lines: no second pass."""
    rows = streams._emitted(spark, sf_dir)
    seen = Observation("run")
    counts = {"emitted": F.count(F.lit(1)), "log_events": F.count_if(F.col("origin") == "LOG"), "select_events": F.count_if(F.col("origin") == "SELECT"), "deletes": F.count_if(F.col("op") == "DELETE"), "position": F.max("emit_pos")}
    watched = rows.observe(seen, *[c.alias(k) for k, c in counts.items()])
    sinks.write_lines(watched.select(F.to_json(F.struct("emit_pos", "k")).alias("line")), _folder(spark, "observed"), "all")
    got = seen.get
    return spark.createDataFrame([(k, "gauge" if k == "position" else "counter", int(got[k])) for k in counts], "name string, kind string, value long")


QUERIES = {f.__name__: f for f in (change_log_source, log_stream_to_sink, ndjson_sink, reconcile_state_stream, tx_event_numbers, dump_windows, source_preflight, tap_row_events, observed_counters)}

ORACLES = {
    "tap_row_events": base.oracle(
        f"""SELECT row_number() OVER (ORDER BY pos, rank, k) AS tap_seq, kind, pos, k FROM (
            SELECT pos, 0 AS rank, 'cdc' AS kind, k FROM log
            UNION ALL SELECT 2 * pos, 1, 'error', -1 FROM ({streams.ORACLES["full_dump_guards"]}) AS g
            UNION ALL SELECT emit_pos, 2, 'sink.event', k FROM emitted
            UNION ALL SELECT pos, 3, 'checkpoint.advanced', -1 FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM log) AS b WHERE n % {base.BATCH_EVENTS} = 0) AS x""", "emitted"),
    "observed_counters": base.oracle(
        """SELECT unnest(['emitted', 'log_events', 'select_events', 'deletes', 'position']) AS name, unnest(['counter', 'counter', 'counter', 'counter', 'gauge']) AS kind,
            unnest([count(*), count(*) FILTER (WHERE origin = 'LOG'), count(*) FILTER (WHERE origin = 'SELECT'), count(*) FILTER (WHERE op = 'DELETE'), max(emit_pos)]) AS value FROM emitted""", "emitted"),
    "source_preflight": """
        WITH n AS (SELECT n_name AS source, n_nationkey AS k, n_regionkey FROM nation),
        t AS (SELECT source, k, s_suppkey AS s, s_acctbal, CASE WHEN s_suppkey % 11 = 0 THEN 'a.' || s_name ELSE s_name END AS object FROM supplier JOIN n ON s_nationkey = k),
        f AS (
            SELECT source, 'binlog_format' AS object, 'SETTING_MISSING' AS code FROM n WHERE k % 2 = 0 AND k % 10 = 4
            UNION ALL SELECT source, 'binlog_format', 'SETTING_WRONG' FROM n WHERE k % 6 = 0 AND k % 10 <> 4
            UNION ALL SELECT source, 'binlog_row_image', 'SETTING_WRONG' FROM n WHERE k % 8 = 0
            UNION ALL SELECT source, 'wal_level', 'SETTING_WRONG' FROM n WHERE k % 2 = 1 AND k % 3 = 0
            UNION ALL SELECT source, object, 'NO_KEY' FROM t WHERE s % 7 = 0
            UNION ALL SELECT source, object, 'BAD_NAME' FROM t WHERE s % 11 = 0
            UNION ALL SELECT source, object, 'REPLICA_IDENTITY' FROM t WHERE k % 2 = 1 AND s % 3 = 0
            UNION ALL SELECT source, object, 'NOT_PUBLISHED' FROM t WHERE k % 2 = 1 AND NOT coalesce(s_acctbal > 0, false)
            UNION ALL SELECT source, 'pub_' || n_regionkey, c FROM n, (VALUES ('NO_UPDATES', 5), ('NO_DELETES', 7), ('NO_TRUNCATES', 9)) AS z(c, m) WHERE k % 2 = 1 AND k % m = 0
            UNION ALL SELECT source, 'pub_' || n_regionkey, 'NOT_BY_ROOT' FROM n WHERE k = 11
            UNION ALL SELECT source, 'slot', c FROM n JOIN (VALUES ('WRONG_PLUGIN', 13), ('SLOT_IN_USE', 17), ('SLOT_INVALID', 19)) AS z(c, m) ON k = m
            UNION ALL SELECT source, 'slot', 'WRONG_DATABASE' FROM n WHERE k % 2 = 1 AND source LIKE 'I%')
        SELECT source, object, code FROM f
    """,
    "dump_windows": "SELECT max(o_orderkey) AS window_end FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS w FROM orders) AS x GROUP BY w",
    "change_log_source": streams.ORACLES["resume_after_checkpoint"],
    "log_stream_to_sink": base.oracle("SELECT pos || ' ' || table_name || ' ' || k || ' ' || op AS line FROM log", "log"),
    "ndjson_sink": f"SELECT line FROM ({streams.ORACLES['ndjson_lines']}) AS x",
    "reconcile_state_stream": streams.ORACLES["reconcile_emitted_stream"],
    "tx_event_numbers": base.oracle("SELECT pos, tx, row_number() OVER (PARTITION BY tx ORDER BY pos) AS tx_seq FROM log", "log"),
}
