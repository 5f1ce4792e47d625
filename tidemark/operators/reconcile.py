"""Merging snapshot chunks with a change log by LOW / HIGH watermark windows.

A chunk's row is dropped when a log event of the same table and key lies strictly between the chunk's LOW and HIGH
positions; the rows left come out at HIGH, after the log up to it, in the order of the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered, running_sums


def _share(part: Column, total: int, parts: int) -> Column:
    """part * total div parts in whole numbers, without a product that could overflow."""
    return part * (total // parts) + F.call_function("div", part * (total % parts), F.lit(parts))


def with_windows(chunks: DataFrame, n_events: int, n_chunks: int) -> DataFrame:
    """chunks with ``lo`` and ``hi``, odd positions spread over a log of ``n_events`` even ones."""
    c = F.col("chunk_id")
    lo, hi = (_share(c, n_events, n_chunks), _share(2 * c + 1, n_events, 2 * n_chunks)) if n_chunks else (F.lit(0), F.lit(0))
    return chunks.withColumn("lo", 2 * lo + 1).withColumn("hi", 2 * hi + 1)


def _inside(log: DataFrame, chunk: DataFrame, table: str):
    return (log["table_name"] == table) & (log["k"] == chunk["k"]) & (log["pos"] > chunk["lo"]) & (log["pos"] < chunk["hi"])


def survivors(chunk: DataFrame, log: DataFrame, table: str) -> DataFrame:
    """chunk (k, value, ordinal, chunk_id, lo, hi) without rows that a log event in the window supersedes.

    Windows are sorted into classes by the power of two of their length, and each class has bins of half that power. A
    window then ends in another bin than it begins in, so the first and the last position of a key's events in each bin
    tell all: in the first bin the last one, in the last bin the first one, between them any. Events are reduced to
    that before their shuffle, so a key with a third of the log is as many small rows as it has bins, in as many tasks.
    """
    length = F.col("hi") - F.col("lo")
    sized = chunk.select("k", "lo", "hi", (F.length(F.bin(length)) - 1).alias("_class")).filter(length >= 2)
    classes = sorted(r[0] for r in sized.select("_class").distinct().collect())  # 62 at most
    if not classes:
        return chunk
    own = log.filter(F.col("table_name") == table).select("k", "pos", F.explode(F.array(*map(F.lit, classes))).alias("_class"))
    bins = own.groupBy("k", "_class", F.expr("shiftright(pos, _class - 1)").alias("_bin")).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    probes = sized.distinct().withColumn("_bin", F.explode(F.expr("sequence(shiftright(lo, _class - 1), shiftright(hi, _class - 1))")))  # five at most
    gone = probes.join(bins, ["k", "_class", "_bin"]).filter((F.col("_last") > F.col("lo")) & (F.col("_first") < F.col("hi"))).select("k", "lo", "hi").distinct()
    return chunk.join(gone, ["k", "lo", "hi"], "left_anti").select(*chunk.columns)


def collisions(chunk: DataFrame, log: DataFrame, table: str) -> DataFrame:
    """The dropped rows, each with the first event that caused it."""
    own = log.filter(F.col("table_name") == table).select("table_name", "k", "pos", "op")
    pairs = chunk.join(own, _inside(own, chunk, table)).select(chunk["chunk_id"], chunk["k"], "pos", "op")
    return pairs.groupBy("chunk_id", "k").agg(F.min(F.struct("pos", "op")).alias("cause")).select("chunk_id", "k", F.col("cause.pos").alias("cause_pos"), F.col("cause.op").alias("cause_op"))


def emitted(chunk: DataFrame, log: DataFrame, table: str) -> DataFrame:
    """emit_pos, origin_rank, ordinal, origin, table_name, op, k, value of all events and surviving rows, unnumbered."""
    live = log.select(F.col("pos").alias("emit_pos"), F.lit(0).alias("origin_rank"), F.lit(0).cast("long").alias("ordinal"), F.lit("LOG").alias("origin"), "table_name", "op", "k", "value")
    rows = survivors(chunk, log, table).select(F.col("hi").alias("emit_pos"), F.lit(1).alias("origin_rank"), "ordinal", F.lit("SELECT").alias("origin"), F.lit(table).alias("table_name"), F.lit("UPDATE").alias("op"), "k", "value")
    return live.unionByName(rows)


def emitted_stream(chunk: DataFrame, log: DataFrame, table: str) -> DataFrame:
    """The emitted stream with ``emit_seq``, its total order from 1."""
    return numbered(emitted(chunk, log, table), ["emit_pos", "origin_rank", "ordinal"], "emit_seq").drop("origin_rank", "ordinal")


def current_state(stream: DataFrame, order: str) -> DataFrame:
    """Last write for each table and key, deleted keys left out: one aggregation, combined before its shuffle.

    order: a column that is unique for a key, such as the emitted position. The buffers are numbers, so rows are
    hashed, not sorted.
    """
    gone = F.when(F.col("op") == "DELETE", 1).otherwise(0)
    last = stream.groupBy("table_name", "k").agg(F.max_by(gone, order).alias("gone"), F.max_by("value", order).alias("value"))
    return last.filter("gone = 0").drop("gone")


def phases(log: DataFrame, controls: DataFrame) -> DataFrame:
    """pos and phase (BEFORE, IN_WINDOW, AFTER) of each log event: running counts of LOW and HIGH rows of all windows.

    controls: pos, kind. With windows one after another, an event is inside if more LOWs than HIGHs came before it.
    """
    both = log.select("pos", F.lit("EVENT").alias("kind")).unionByName(controls.select("pos", "kind"))
    counted = running_sums(both, ["pos"], {"lows": F.when(F.col("kind") == "LOW", 1).otherwise(0), "highs": F.when(F.col("kind") == "HIGH", 1).otherwise(0)})
    phase = F.when(F.col("lows") > F.col("highs"), "IN_WINDOW").when(F.col("lows") == 0, "BEFORE").otherwise("BETWEEN")
    return counted.filter("kind = 'EVENT'").select("pos", "lows", "highs", phase.alias("phase"))


def is_stale() -> Column:
    """Whether a foreign token is left over from a run and may be dropped: both the session and the row name a run."""
    return F.col("own_run").isNotNull() & (F.trim(F.coalesce("run_id", F.lit(""))) != "") & (F.col("run_type") == "string")


def without_stale(rows: DataFrame) -> DataFrame:
    """Control rows of sessions without those that are stale; a foreign token that isn't stays, to be an error."""
    text = (F.col("token_type") == "string") & (F.trim(F.coalesce("token", F.lit(""))) != "")
    foreign = text & (F.col("token") != F.col("low_token")) & (F.col("token") != F.col("high_token"))
    return rows.filter(~(foreign & is_stale()))


def violations(rows: DataFrame) -> DataFrame:
    """Errors in the control rows of sessions, one window to a session.

    rows: session, seq, is_control, op, origin, table_ok, key_ok, has_after, token, token_type, low_token, high_token,
    run_id, run_type, own_run. Gives session, seq, code for each row that breaks the order LOW, then HIGH, or the shape
    of a control row. Tokens and runs are texts; the token may not be null or blank. A token that isn't the window's is
    an error unless it is stale (``is_stale``).
    """
    upto = W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    low, high = F.col("token") == F.col("low_token"), F.col("token") == F.col("high_token")
    seen = lambda hit: F.coalesce(F.sum(F.when(F.col("is_control") & hit, 1).otherwise(0)).over(upto), F.lit(0)) > 0
    known = F.coalesce(low | high, F.lit(False))
    code = (
        F.when(F.col("op") != "WATERMARK", "NOT_A_WATERMARK")
        .when(F.col("origin") != "LOG", "WRONG_ORIGIN")
        .when(~F.col("table_ok"), "WRONG_TABLE")
        .when(~F.col("key_ok"), "WRONG_KEY")
        .when(~F.col("has_after"), "NO_AFTER_ROW")
        .when(F.col("token").isNull(), "BLANK_TOKEN")
        .when(F.col("token_type") != "string", "TOKEN_IS_NO_TEXT")
        .when(F.trim("token") == "", "BLANK_TOKEN")
        .when(~known & F.col("own_run").isNotNull() & F.col("run_id").isNotNull() & (F.col("run_type") != "string"), "RUN_IS_NO_TEXT")
        .when(~known & ~is_stale(), "UNKNOWN_TOKEN")
        .when(low & F.col("_low"), "DUPLICATE_LOW")
        .when(low & F.col("_high"), "LOW_AFTER_HIGH")
        .when(high & F.col("_high"), "DUPLICATE_HIGH")
        .when(high & ~F.col("_low"), "HIGH_BEFORE_LOW")
    )
    marked = rows.withColumn("_low", seen(low)).withColumn("_high", seen(high))
    return marked.filter("is_control").withColumn("code", code).filter("code IS NOT NULL").select("session", "seq", "code")
