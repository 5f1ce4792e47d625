"""Queries over recorded messages and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import key_columns
from tidemark.operators import control_plane
from tidemark.sources import message_log
from tidemark.sources.tables import read

from . import base


def _messages(spark, sf_dir):
    """The log as messages: before each row a table map, after each fifth row a commit; the last rows lack theirs."""
    e = read(spark, sf_dir, "events")
    kinds = {"INSERT": "WRITE", "UPDATE": "UPDATE", "DELETE": "DELETE"}
    log = base.log(spark, sf_dir)
    kind = F.col("op")
    for op, name in kinds.items():
        kind = F.when(F.col("op") == op, name).otherwise(kind)
    last = e.agg(F.max("event_id")).first()[0] or 0
    at, i = F.col("pos") * 2, F.floor(F.col("pos") / 2)
    row = lambda seq, k: F.struct(seq.alias("seq"), k.alias("kind"))
    parts = F.array(row(at, F.lit("TABLE_MAP")), row(at + 1, kind), row(at + 2, F.when((i % 5 == 4) & (i < last - 5), "COMMIT")))
    rows = log.withColumn("m", F.explode(parts)).filter("m.kind IS NOT NULL")
    is_row = F.col("m.kind").isin(*message_log.ROW_KINDS)
    return rows.select("m.seq", "m.kind", "table_name", F.when(is_row, F.col("k")).alias("k"), F.when(is_row, F.col("value")).alias("value"), F.lit(None).cast("string").alias("sql"), F.lit(None).cast("string").alias("database"))


def message_log_events(spark, sf_dir):
    return message_log.change_events(_messages(spark, sf_dir))


def queue_rates(spark, sf_dir):
    """Increase of each user's event counter a second, rounded to a millionth."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_id") + 1).alias("seen"))
    out = control_plane.rates(e, "user_id", "ts", ["seen"]).filter("seen_per_second IS NOT NULL")
    return out.groupBy("user_id").agg(F.count("*").alias("samples"), F.round(F.max("seen_per_second"), 6).alias("peak"))


def mutation_detail(spark, sf_dir):
    """Details of mutations as base64 of key=value lists and read back."""
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.lit("status="), "o_orderstatus", F.lit(";priority="), "o_orderpriority")
    coded = o.select("o_orderkey", F.base64(F.encode(text, "UTF-8")).alias("coded"))
    back = F.str_to_map(F.decode(F.unbase64("coded"), "UTF-8"), F.lit(";"), F.lit("="))
    return coded.select("o_orderkey", "coded", back["status"].alias("status"), back["priority"].alias("priority"))


def pk_stored_form(spark, sf_dir):
    """Stored forms of the composite keys of conversations, loaded back."""
    stored = key_columns.store([(F.lit(n), F.lit("INTEGER"), F.col(n).cast("string")) for n in ("conv_id", "turn")])
    back = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key_columns.load(stored).alias("back"))
    fields = F.array_join(F.transform("back", lambda p: F.concat(p["name"], F.lit("="), p["literal"])), ",")
    return back.select("conv_id", "turn", F.concat(F.lit("{"), fields, F.lit("}")).alias("literal"))


QUERIES = {f.__name__: f for f in (message_log_events, queue_rates, mutation_detail, pk_stored_form)}
ORACLES = {
    "message_log_events": base.oracle(
        """SELECT 2 * pos + 1 AS seq, tx, 2 * (max(pos) OVER (PARTITION BY tx)) + 2 AS commit_seq, table_name, k, op, value FROM log
           WHERE tx IN (SELECT event_id // 5 FROM events WHERE event_id % 5 = 4 AND event_id < (SELECT max(event_id) FROM events) - 5)""", "log"),
    "queue_rates": """
        SELECT user_id, count(*) AS samples, round(max(rate), 6) AS peak FROM (
            SELECT user_id, (event_id - lag(event_id) OVER o) / ((epoch_us(ts) - lag(epoch_us(ts)) OVER o) / 1000000) AS rate FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)) AS x
        WHERE rate IS NOT NULL GROUP BY user_id""",
    "mutation_detail": "SELECT o_orderkey, base64(encode('status=' || o_orderstatus || ';priority=' || o_orderpriority)) AS coded, o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "pk_stored_form": "SELECT conv_id, turn, '{conv_id=' || conv_id || ',turn=' || turn || '}' AS literal FROM conversations",
}
