"""Row numbers and running sums over a whole table's order, without sending the table to one task.

Rows are range-partitioned by the order and numbered inside their partition; one row for each partition gives the
offset. The partitioned keys are checkpointed, so both steps see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import checkpoint


def _ranged(df: DataFrame, order: list) -> DataFrame:
    return checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _offsets(ranged: DataFrame, value: Column) -> DataFrame:
    """One row for each partition: there are no more than the session's shuffle partitions, so it is broadcast."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    return F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))


def numbered(df: DataFrame, order: list, name: str = "seq") -> DataFrame:
    """df with ``name``: the row's number in the order, from 1. The order must be unique."""
    ranged = _ranged(df, order)
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)).cast("long")
    return ranged.join(_offsets(ranged, F.lit(1)), "_part").withColumn(name, inside + F.col("_before")).drop("_part", "_before")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with a running sum, this row included, for each of ``sums``. The order must be unique."""
    ranged = _ranged(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), order)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged
    for k in sums:
        out = out.join(_offsets(ranged, F.col(f"_v_{k}")).withColumnRenamed("_before", f"_b_{k}"), "_part")
        out = out.withColumn(k, F.sum(f"_v_{k}").over(inside) + F.col(f"_b_{k}"))
    return out.drop("_part", *[f"_v_{k}" for k in sums], *[f"_b_{k}" for k in sums])
