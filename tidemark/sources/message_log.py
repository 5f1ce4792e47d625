"""Recorded log messages to change events.

A recorded log is rows (JSON lines, Parquet or a file stream) of seq, kind, table_name, k, value, sql, database: the
kinds are BEGIN, TABLE_MAP, WRITE, UPDATE, DELETE, QUERY and COMMIT. Rows between two commits are one transaction and
become visible at its commit; rows after the last one are not committed and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import classify
from tidemark.operators.ordering import running_sums

SCHEMA = "seq long, kind string, table_name string, k long, value double, sql string, database string"
ROW_KINDS = {"WRITE": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE"}


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def change_events(messages: DataFrame) -> DataFrame:
    """seq, tx, commit_seq, table_name, k, op, value of all committed row messages."""
    commit = F.when(F.col("kind") == "COMMIT", 1).otherwise(0)
    counted = running_sums(messages, ["seq"], {"commits": commit})
    tx = F.col("commits") - commit
    rows = counted.filter(F.col("kind").isin(*ROW_KINDS)).select("seq", tx.alias("tx"), "table_name", "k", F.col("kind").alias("_kind"), "value")
    ends = counted.filter("kind = 'COMMIT'").select(tx.alias("tx"), F.col("seq").alias("commit_seq"))
    op = F.col("_kind")
    for kind, name in ROW_KINDS.items():
        op = F.when(F.col("_kind") == kind, name).otherwise(op)
    return rows.join(ends, "tx").select("seq", "tx", "commit_seq", "table_name", "k", op.alias("op"), F.when(F.col("_kind") != "DELETE", F.col("value")).alias("value"))


def fatal_statements(messages: DataFrame, databases: list[str], tables: list[str]) -> DataFrame:
    """QUERY messages that the log can't be read past."""
    decision = classify.statement(F.col("sql"), F.col("database"), databases, tables)
    return messages.filter("kind = 'QUERY'").withColumn("decision", decision).filter("decision = 'FAIL_CLOSED'").select("seq", "sql")
