"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Return to the system what this worker has freed: the allocators keep it, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, a function for ``mapInArrow``, and then ``give_back``: the next task, of any stage, finds a small worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers a thousand at a time, where the session keeps Spark's ten thousand: those are 20 MB of
    texts, several times over in the executor's direct memory and in the worker. Operators cut batches smaller anyway."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint where a count shows at most ``rows`` rows; else the frame as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


HOT_SHARE = 1000


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """rows joined with their group's row; ``count`` says how many of the rows each group has, ``total`` their sum.

    A group with over 1 / HOT_SHARE of all rows is hot: fewer than HOT_SHARE of them exist at any size, so they are
    broadcast and a hot key is in no shuffle. The others are joined by shuffle.
    """
    if total is None:
        total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot, rest = (groups.filter((F.col(count) * HOT_SHARE > total) == is_hot) for is_hot in (True, False))
    names = [c for c in groups.columns if c != key]
    by_hot = rows.join(F.broadcast(hot), key, "left")
    found = by_hot.filter(F.col(count).isNotNull())
    others = by_hot.filter(F.col(count).isNull()).drop(*names).join(rest, key)
    return found.unionByName(others)


def salt_hot(rows: DataFrame, groups: DataFrame, key: str, count: str, spread: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``_salt``, to be joined on the key and it.

    A group with over 1 / HOT_SHARE of all rows is cut into pieces of about that many rows, dealt by a hash of the
    ``spread`` columns; the group's row is repeated for each piece. The hot keys, fewer than HOT_SHARE, are broadcast.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    pieces = F.greatest(F.ceil(F.col(count) * HOT_SHARE / max(1, total)), F.lit(1))
    hot = groups.filter(F.col(count) * HOT_SHARE > total).select(key, pieces.alias("_pieces"))
    salt = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_pieces"))).otherwise(0)
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt.cast("long")).drop("_pieces")
    return rows, groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)))
