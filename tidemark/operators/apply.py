"""Applying an ordered change stream: statement runs, collapse to the last write, deletes, NDJSON and mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTROL = ("WATERMARK", "HEARTBEAT")
OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def last(value: str, order: str) -> Column:
    """The value at the largest order. Operations go as numbers, so that a hash aggregate holds them."""
    if value != "op":
        return F.max_by(value, order)
    code = F.array_position(F.array(*map(F.lit, OPERATIONS)), F.col("op"))
    return F.element_at(F.array(*map(F.lit, OPERATIONS)), F.max_by(code, order).cast("int"))


def without_controls(stream: DataFrame) -> DataFrame:
    return stream.filter(~F.col("op").isin(*CONTROL))


def statement_runs(stream: DataFrame, batch: str, seq: str) -> DataFrame:
    """stream with ``kind`` and ``run``: consecutive events of a batch with the same table and statement kind.

    A batch is what a target transaction takes, so the window is bounded by it.
    """
    order = W.partitionBy(batch).orderBy(seq)
    kind = F.when(F.col("op") == "DELETE", "DELETE").otherwise("UPSERT")
    new = F.coalesce((F.col("kind") != F.lag("kind").over(order)) | (F.col("table_name") != F.lag("table_name").over(order)), F.lit(True))
    return stream.withColumn("kind", kind).withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(order)).drop("_new")


def dedupe_runs(runs: DataFrame, batch: str, seq: str) -> DataFrame:
    """The last event of each key inside a run, with the key's first place there."""
    groups = runs.groupBy(batch, "run", "table_name", "kind", "k").agg(
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), last("op", seq).alias("op"), last("value", seq).alias("value")
    )
    return groups


def deletes(mirror: DataFrame, stream: DataFrame, table: str) -> DataFrame:
    """mirror (k) without keys whose last event in the stream is a DELETE."""
    gone = stream.filter(F.col("table_name") == table).groupBy("k").agg(last("op", "pos").alias("op")).filter("op = 'DELETE'")
    return mirror.join(gone, "k", "left_anti")


def ndjson(stream: DataFrame) -> DataFrame:
    """``line``: one JSON object for each event, nulls written, in a fixed order of fields."""
    fields = F.struct(
        F.col("table_name").alias("tableId"),
        F.col("op").alias("operationType"),
        F.col("origin").alias("captureOrigin"),
        F.struct("k").alias("primaryKey"),
        F.lit(None).cast("struct<k:bigint>").alias("beforeRow"),
        F.when(F.col("op") != "DELETE", F.struct("k", F.col("value_text").alias("value"))).alias("afterRow"),
        F.col("position").alias("sourcePosition"),
        F.col("tx").alias("transactionId"),
        F.col("dump_id").alias("dumpId"),
    )
    return stream.select("emit_pos", "k", F.to_json(fields, {"ignoreNullFields": "false"}).alias("line"))


def write_ndjson(stream: DataFrame, path: str) -> None:
    ndjson(stream).select("line").write.mode("append").text(path)


def mirror(base: DataFrame, stream: DataFrame, key: str, order: str) -> DataFrame:
    """base (``key``, value) with the stream's last writes over it: keys deleted last are gone, others replaced."""
    writes = stream.groupBy(key).agg(last("op", order).alias("op"), last("value", order).alias("new_value"))
    both = base.join(writes, key, "full_outer")
    return both.filter(F.coalesce(F.col("op"), F.lit("")) != "DELETE").select(key, F.when(F.col("op").isNull(), F.col("value")).otherwise(F.col("new_value")).alias("value"))


def typed_mirror(base: DataFrame, stream: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """base (keys and values) with the stream's last writes over it, for keys of several columns and typed values."""
    writes = stream.groupBy(*keys).agg(last("op", order).alias("_op"), F.max_by(F.struct(*values), order).alias("_new"))
    both = base.join(writes, keys, "full_outer").filter(F.coalesce(F.col("_op"), F.lit("")) != "DELETE")
    return both.select(*keys, *[F.when(F.col("_op").isNull(), F.col(v)).otherwise(F.col(f"_new.{v}")).alias(v) for v in values])


def needs_full_dump(rows: DataFrame) -> DataFrame:
    """Events that can't be applied: a captured table was truncated, a key changed, or a tuple lacks columns.

    rows: pos, table_name, op, captured, key, old_key, n_columns, table_columns. Gives pos, table_name and code.
    """
    code = (
        F.when(F.col("op") == "TRUNCATE", "TRUNCATED")
        .when((F.col("op") == "UPDATE") & F.col("old_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("old_key")), "KEY_CHANGED")
        .when(F.col("n_columns") < F.col("table_columns"), "SHORT_TUPLE")
    )
    return rows.filter("captured").withColumn("code", code).filter("code IS NOT NULL").select("pos", "table_name", "code")


SEGMENT = 65_536


def transaction_segments(log: DataFrame, positions: int = SEGMENT) -> DataFrame:
    """tx, segment, first_pos, last_pos, n_events, ops: stretches of transactions, of at most ``positions`` positions.

    A position has one event, so no row holds more than that of a transaction, however many events it has, and a large
    one is spread over many tasks. What is between its segments is told by their numbers and counts.
    """
    rows = log.groupBy("tx", F.call_function("div", "pos", F.lit(positions)).alias("segment"))
    events = F.array_sort(F.collect_list(F.struct("pos", "op")))
    found = rows.agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_events"), events.alias("events"))
    return found.withColumn("ops", F.array_join(F.transform("events", lambda x: x["op"]), ",")).drop("events")


def transactions(segments: DataFrame) -> DataFrame:
    """tx, commit_pos, n_events and ops of whole transactions: a few segments each, one text as long as the result is."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "ops")))
    rows = segments.groupBy("tx").agg(F.max("last_pos").alias("commit_pos"), F.sum("n_events").cast("int").alias("n_events"), parts.alias("parts"))
    return rows.select("tx", "commit_pos", "n_events", F.array_join(F.transform("parts", lambda x: x["ops"]), ",").alias("ops"))


def numbered_in_transactions(log: DataFrame, positions: int = SEGMENT) -> DataFrame:
    """log with ``tx_seq``, the event's number in its transaction from 1: counts of the segments before, and a window in each."""
    segment = F.call_function("div", "pos", F.lit(positions))
    counts = log.groupBy("tx", segment.alias("_segment")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("tx").orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(W.partitionBy("tx", "_segment").orderBy("pos"))
    return log.withColumn("_segment", segment).join(before, ["tx", "_segment"]).withColumn("tx_seq", F.col("_before") + at).drop("_segment", "_before")
