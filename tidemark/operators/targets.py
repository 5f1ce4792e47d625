"""Relational targets: statements, retries, names and failures. Rows go out by partition through a DB-API connection."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIRROR_PREFIX, MIRROR_LENGTH = "MIRROR_", 60


class TargetError(Exception):
    """A failure at the target. ``retryable`` ones are outages; the others break a contract and are raised."""

    retryable = False


class TargetUnavailable(TargetError):
    retryable = True


class TargetPreflightFailed(TargetError):
    """The check before the start found the target unfit."""


class TargetTableMissing(TargetPreflightFailed):
    pass


class TargetKeyMismatch(TargetError):
    """The target's key, or the key in a row's image, isn't the source's."""


class TargetColumnMissing(TargetPreflightFailed):
    pass


class TargetTypeMismatch(TargetPreflightFailed):
    """A column's type can't take the source's values."""


class TargetValueRejected(TargetError):
    """One value can't be made into its column's type."""


class TargetMetadataUnknown(TargetError):
    """The target doesn't tell its tables."""


class TargetOperationFailed(TargetError):
    """A statement failed for a reason of its own."""


def upsert_statement(dialect: str, table: str, keys: Sequence[str], others: Sequence[str]) -> str:
    """An upsert with placeholders for keys, then the other columns. dialect: ``postgres``, ``mysql`` or ``sqlite``."""
    tick = "`" if dialect == "mysql" else '"'
    mark = "?" if dialect == "sqlite" else "%s"
    name = lambda c: f"{tick}{c.replace(tick, 2 * tick)}{tick}"
    columns = [*keys, *others]
    insert = f"INSERT INTO {'.'.join(map(name, table.split('.')))} ({', '.join(map(name, columns))}) VALUES ({', '.join([mark] * len(columns))})"
    if dialect == "mysql":
        sets = ", ".join(f"{name(c)} = new_row.{name(c)}" for c in (others or keys[:1]))
        return f"{insert} AS new_row ON DUPLICATE KEY UPDATE {sets}"
    action = "DO UPDATE SET " + ", ".join(f"{name(c)} = EXCLUDED.{name(c)}" for c in others) if others else "DO NOTHING"
    return f"{insert} ON CONFLICT ({', '.join(map(name, keys))}) {action}"


def delete_statement(dialect: str, table: str, keys: Sequence[str]) -> str:
    tick = "`" if dialect == "mysql" else '"'
    mark = "?" if dialect == "sqlite" else "%s"
    name = lambda c: f"{tick}{c.replace(tick, 2 * tick)}{tick}"
    return f"DELETE FROM {'.'.join(map(name, table.split('.')))} WHERE " + " AND ".join(f"{name(k)} = {mark}" for k in keys)


def mirror_name(database: str | None, schema: str | None, table: str, display: str) -> str:
    """Upper-case mirror table name; a long one is cut and ends in a hash of the table's display name."""
    text = re.sub("_+", "_", re.sub("[^A-Za-z0-9_]", "_", f"{database or ''}_{schema or ''}_{table}"))
    text = text.removeprefix("_")
    if len(text) > MIRROR_LENGTH:
        text = f"{text[: MIRROR_LENGTH - 9]}_{text_hash(display):x}"
    return (MIRROR_PREFIX + text).upper()


def text_hash(text: str) -> int:
    """31-polynomial of UTF-16 units mod 2^32."""
    units, value = text.encode("utf-16-be"), 0
    for i in range(0, len(units), 2):
        value = (value * 31 + int.from_bytes(units[i : i + 2], "big")) % (1 << 32)
    return value


def retrying(action: Callable[[], object], sleep: Callable[[float], None] = time.sleep, first: float = 0.05, most: float = 5.0) -> object:
    """Runs an action until it ends; outages are waited out with growing pauses, other failures are raised."""
    pause = first
    while True:
        try:
            return action()
        except TargetError as e:
            if not e.retryable:
                raise
            sleep(pause)
            pause = min(most, 2 * pause)


def collapse(stream: DataFrame, keys: Sequence[str] = ("k",), values: Sequence[str] = ("value",), order: str = "pos") -> DataFrame:
    """The last event of each key, composite or not, with all its columns; ties can't be, as positions are unique."""
    last = stream.groupBy(*keys).agg(F.max_by(F.struct("op", *values), order).alias("_last"), F.max(order).alias(order))
    return last.select(*keys, "_last.*", order)


def check_keys(stream: DataFrame, keys: Sequence[str], images: Sequence[str] = ()) -> DataFrame:
    """stream; a row fails where a key is null, or where its image has another key (``images``, in order of the keys;
    all null in rows without an image)."""
    null = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])
    broken = F.when(null != "", F.concat(F.lit("null key: "), null))
    if images:
        there = F.coalesce(*[F.col(i).cast("string") for i in images]).isNotNull()
        same = F.lit(True)
        for k, i in zip(keys, images, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(i))
        broken = broken.when((F.col("op") != "DELETE") & there & ~same, F.lit("the image has another key"))
    return stream.withColumn("_bad", broken).withColumn(keys[0], F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast(stream.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))).drop("_bad")


def apply_by_partition(stream: DataFrame, connect: Callable[[], object], dialect: str, table: str, keys: Sequence[str] = ("k",), values: Sequence[str] = ("value",), order: str = "pos", images: Sequence[str] = ()) -> None:
    """Collapsed upserts and deletes, each partition in one transaction of its own; keys don't meet across partitions."""
    upsert, delete = upsert_statement(dialect, table, keys, values), delete_statement(dialect, table, keys)

    def write(rows: Iterable) -> None:
        ups, gone = [], []
        for r in rows:
            key = tuple(r[k] for k in keys)
            (gone.append(key) if r["op"] == "DELETE" else ups.append((*key, *(r[v] for v in values))))
        if not ups and not gone:
            return
        connection = connect()
        try:
            cursor = connection.cursor()
            if ups:
                cursor.executemany(upsert, ups)
            if gone:
                cursor.executemany(delete, gone)
            connection.commit()
        finally:
            connection.close()

    collapse(check_keys(stream, keys, images), keys, values, order).foreachPartition(write)
