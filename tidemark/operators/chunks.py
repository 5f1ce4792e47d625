"""Keyset chunks of a table: bounds, pages, assignment of all rows, and reads by key list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered


def upper_bound(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest key tuple, no row for an empty table: partial maxima of a struct, no sort."""
    top = df.agg(F.max(F.struct(*keys)).alias("_top")).filter("_top IS NOT NULL")
    return top.select(*[F.col(f"_top.{k}").alias(k) for k in keys])


def after(keys: Sequence[str], bound: Sequence, inclusive: bool = False) -> Column:
    """Key tuple > bound (>= if inclusive), as scalar comparisons; the leading one reaches the Parquet scan."""
    full = F.lit(inclusive)
    for key, value in reversed(list(zip(keys, bound, strict=True))):
        full = (F.col(key) > value) | ((F.col(key) == value) & full)
    return (F.col(keys[0]) >= bound[0]) & full


def up_to(keys: Sequence[str], bound: Sequence) -> Column:
    """Key tuple <= bound."""
    full = F.lit(True)
    for key, value in reversed(list(zip(keys, bound, strict=True))):
        full = (F.col(key) < value) | ((F.col(key) == value) & full)
    return (F.col(keys[0]) <= bound[0]) & full


def next_chunk(df: DataFrame, keys: Sequence[str], size: int, start_after: Sequence | None = None, stop_at: Sequence | None = None) -> DataFrame:
    """The next ``size`` rows by key with ``final_chunk``: whether no row follows inside the bounds.

    Reads size + 1 rows with a top-k, as a page query does.
    """
    if start_after is not None:
        df = df.filter(after(keys, start_after))
    if stop_at is not None:
        df = df.filter(up_to(keys, stop_at))
    page = df.orderBy(*keys).limit(size + 1)
    at = F.row_number().over(W.orderBy(*keys))  # over size + 1 rows at most
    more = F.count("*").over(W.partitionBy(F.lit(0).alias("_"))) > size
    return page.withColumn("_at", at).withColumn("final_chunk", ~more).filter(F.col("_at") <= size).drop("_at")


def assign(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """df with ``ordinal`` (from 0, by key) and ``chunk_id``, for all chunks of the table in one pass."""
    return numbered(df, list(keys), "ordinal").withColumn("ordinal", F.col("ordinal") - 1).withColumn("chunk_id", F.call_function("div", F.col("ordinal"), F.lit(size)))


def window_ends(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``window_end``: the last key of each window of ``rows`` rows, from one pass over the keys.

    With these a dump's windows are ranges of the key, which a scan finds by the files' statistics: on a table that lies
    in the order of its key each row is read once, however many windows there are.
    """
    at = numbered(df.select(key), [key], "_at")
    last = at.groupBy(F.call_function("div", F.col("_at") - 1, F.lit(rows)).alias("_window")).agg(F.max(key).alias("window_end"))
    return last.select("window_end")


def boundaries(assigned: DataFrame, key: str) -> DataFrame:
    """chunk_id, n_rows, first and last key, and the exclusive start of each chunk (the last key of the one before)."""
    rows = assigned.groupBy("chunk_id").agg(F.count("*").alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    before = rows.select((F.col("chunk_id") + 1).alias("chunk_id"), F.col("last_key").alias("start_after"))
    return rows.join(before, "chunk_id", "left")


def first_seen(requested: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Requested keys without repeats, each at its first place."""
    return requested.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def targeted(df: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Rows of the requested keys (``requested_key``, ``ordinal``)."""
    return requested.join(df, requested["requested_key"] == df[key])


def missing(df: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    return requested.join(df.select(key), requested["requested_key"] == df[key], "left_anti")


def key_violations(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """table_name, rows, null_keys, distinct_keys and whether the declared key holds."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_null", null_key)
    found = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~F.col("_null")).alias("distinct_keys"),
    )
    return found.select(F.lit(table).alias("table_name"), "n_rows", "null_keys", "distinct_keys", ((F.col("null_keys") == 0) & (F.col("n_rows") == F.col("distinct_keys"))).alias("key_holds"))
