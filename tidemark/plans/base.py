"""Fixtures that the registered queries share, and the same as SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunks, reconcile
from tidemark.sources import tables

CHUNK = 100
BATCH_EVENTS = 100

# SQL of the fixtures; the names are those of the DataFrame functions below.
CTES = {
    "sizes": "SELECT (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM events) AS m",
    "log": f"""
        SELECT 2 * event_id AS pos, CASE WHEN event_type = 'view' THEN '{tables.ORDERS}' ELSE '{tables.CUSTOMER}' END AS table_name,
               (event_id * {tables.STRIDE}) % n_customers AS k,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
               CASE WHEN event_type <> 'error' THEN value END AS value, event_id // 5 AS tx, ts
        FROM events, sizes""",
    "chunk0": f"""
        SELECT c_custkey AS k, c_acctbal AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal,
               (row_number() OVER (ORDER BY c_custkey) - 1) // {CHUNK} AS chunk_id
        FROM customer""",
    "chunk": """
        SELECT chunk0.*, 2 * ((chunk_id * m) // n) + 1 AS lo, 2 * (((2 * chunk_id + 1) * m) // (2 * n)) + 1 AS hi
        FROM chunk0, sizes, (SELECT max(chunk_id) + 1 AS n FROM chunk0) AS z""",
    "survivors": f"""
        SELECT * FROM chunk c WHERE NOT EXISTS (
            SELECT 1 FROM log l WHERE l.table_name = '{tables.CUSTOMER}' AND l.k = c.k AND l.pos > c.lo AND l.pos < c.hi)""",
    "emitted": f"""
        SELECT pos AS emit_pos, 0 AS origin_rank, 0 AS ordinal, 'LOG' AS origin, table_name, op, k, value FROM log
        UNION ALL
        SELECT hi, 1, ordinal, 'SELECT', '{tables.CUSTOMER}', 'UPDATE', k, value FROM survivors""",
    "stream": """
        SELECT row_number() OVER (ORDER BY emit_pos, origin_rank, ordinal) AS emit_seq, emit_pos, origin, table_name, op, k, value, origin_rank, ordinal
        FROM emitted""",
    "state": """
        SELECT table_name, k, value FROM (
            SELECT *, row_number() OVER (PARTITION BY table_name, k ORDER BY emit_pos DESC, origin_rank DESC, ordinal DESC) AS r FROM emitted
        ) AS x WHERE r = 1 AND op <> 'DELETE'""",
    "req": f"""
        SELECT o_orderkey AS request_id, o_orderkey AS seq,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'ALL_TABLES' WHEN '2-HIGH' THEN 'PRIMARY_KEYS' ELSE 'TABLE' END AS scope,
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_custkey % 2 = 0 THEN '{tables.CUSTOMER}' ELSE '{tables.ORDERS}' END AS table_name,
               CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey % 700 ELSE 0 END AS n_keys,
               CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN 'ACTIVE' ELSE CASE WHEN o_totalprice > 400000 THEN 'FAILED' ELSE 'COMPLETED' END END AS state,
               CASE WHEN o_orderstatus = 'F' AND o_totalprice > 420000 THEN 'drift' END AS reason,
               CASE WHEN o_orderstatus = 'F' THEN o_custkey % 3 ELSE 0 END AS n_missing
        FROM orders""",
}
NEEDS = {
    "log": ["sizes"], "chunk": ["sizes", "chunk0"], "survivors": ["log", "chunk"], "emitted": ["log", "survivors"], "stream": ["emitted"], "state": ["emitted"],
}


def oracle(body: str, *names: str) -> str:
    """body with the fixtures in ``names``, and those they need, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " if order else "") + body


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.change_log(spark, sf_dir)


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of customer: k, value, ordinal, chunk_id, lo, hi."""
    rows = customer_rows(spark, sf_dir)
    n = -(-rows.count() // CHUNK)
    return reconcile.with_windows(chunks.assign(rows, ["k"], CHUNK), tables.read(spark, sf_dir, "events").count(), n)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump requests, one for each order: scope, table, number of keys, and the status fields where there is one."""
    o = tables.read(spark, sf_dir, "orders")
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    done = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderkey").alias("seq"),
        F.when(urgent, "ALL_TABLES").when(high, "PRIMARY_KEYS").otherwise("TABLE").alias("scope"),
        F.when(~urgent, F.when(F.col("o_custkey") % 2 == 0, tables.CUSTOMER).otherwise(tables.ORDERS)).alias("table_name"),
        F.when(high, F.col("o_custkey") % 700).otherwise(F.lit(0).cast("long")).alias("n_keys"),
        F.when(F.col("o_orderstatus") == "P", "ACTIVE").when(done & (F.col("o_totalprice") > 400000), "FAILED").when(done, "COMPLETED").alias("state"),
        F.when(done & (F.col("o_totalprice") > 420000), "drift").alias("reason"),
        F.when(done, F.col("o_custkey") % 3).otherwise(F.lit(0).cast("long")).alias("n_missing"),
    )
