"""Source tables with declared keys, and the change log that the driver's ``events`` table holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableId:
    database: str
    schema: str
    name: str

    def __post_init__(self):
        if not all(part and part.strip() for part in (self.database, self.schema, self.name)):
            raise ValueError("a table id has no blank part")

    @property
    def display(self) -> str:
        return f"{self.database}.{self.schema}.{self.name}"

    @classmethod
    def parse(cls, text: str, parts: str = "three", database: str = "", schema: str = "public") -> TableId:
        """parts: ``three`` (database.schema.table), ``schema`` (schema.table) or ``database`` (database.table)."""
        found = text.split(".")
        if len(found) != (3 if parts == "three" else 2):
            raise ValueError(f"not a name of the {parts} form: {text}")
        if parts == "three":
            return cls(*found)
        return cls(database, *found) if parts == "schema" else cls(found[0], schema, found[1])


@dataclass(frozen=True)
class TableContract:
    """A captured table: its id, its declared key columns in order, and columns to leave out."""

    table: TableId
    keys: tuple[str, ...]
    ignored: tuple[str, ...] = ()

    def selected(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.ignored or c in self.keys]


def _contract(name: str, *keys: str, ignored: tuple[str, ...] = ()) -> TableContract:
    return TableContract(TableId("shop", "public", name), keys, ignored)


CONTRACTS = {
    c.table.name: c
    for c in (
        _contract("region", "r_regionkey"),
        _contract("nation", "n_nationkey"),
        _contract("customer", "c_custkey", ignored=("c_mktsegment",)),
        _contract("supplier", "s_suppkey"),
        _contract("part", "p_partkey"),
        _contract("orders", "o_orderkey"),
        _contract("lineitem", "l_orderkey", "l_linenumber"),
        _contract("events", "event_id"),
        _contract("conversations", "conv_id", "turn"),
    )
}
CUSTOMER = CONTRACTS["customer"].table.display
ORDERS = CONTRACTS["orders"].table.display
STRIDE = 7919


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def operation(event_type: Column) -> Column:
    return F.when(event_type == "signup", "INSERT").when(event_type == "error", "DELETE").otherwise("UPDATE")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, table_name, k, op, value, tx, ts: every event as a change of one row.

    Positions are even, so control rows at odd ones never tie. A fixed stride addresses the events to all customers,
    so that all chunks see changes in their windows; views are changes of another table. Five events are a
    transaction.
    """
    return as_changes(spark, sf_dir, read(spark, sf_dir, "events"))


def as_changes(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Rows of events as changes of a log (``change_log``)."""
    n = read(spark, sf_dir, "customer").count()
    op = operation(F.col("event_type"))
    return events.select(
        (F.col("event_id") * 2).alias("pos"),
        F.when(F.col("event_type") == "view", ORDERS).otherwise(CUSTOMER).alias("table_name"),
        (F.col("event_id") * STRIDE % n).alias("k"),
        op.alias("op"),
        F.when(op != "DELETE", F.col("value")).alias("value"),
        F.call_function("div", "event_id", F.lit(5)).alias("tx"),
        "ts",
    )
