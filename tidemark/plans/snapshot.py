"""Scans, chunks, targeted reads, schema catalog and key contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import chunks
from tidemark.sources import tables
from tidemark.sources.tables import CONTRACTS, read

from . import base

REQUESTED = "SELECT o_custkey * 2 AS requested_key, o_orderkey AS ordinal FROM orders"


def _requested(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") * 2).alias("requested_key"), F.col("o_orderkey").alias("ordinal"))


def upper_bound_pk(spark, sf_dir):
    return chunks.upper_bound(read(spark, sf_dir, "customer"), ["c_custkey"])


def upper_bound_pk_composite(spark, sf_dir):
    return chunks.upper_bound(read(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def next_chunk(spark, sf_dir):
    return chunks.next_chunk(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 100)


def next_chunk_bounded(spark, sf_dir):
    return chunks.next_chunk(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 100, (24,), (90,))


def next_chunk_composite(spark, sf_dir):
    return chunks.next_chunk(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 50, (3, 1))


def chunk_assignment(spark, sf_dir):
    return chunks.assign(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100)


def chunk_boundaries(spark, sf_dir):
    return chunks.boundaries(chunk_assignment(spark, sf_dir), "o_orderkey")


def requested_keys_distinct(spark, sf_dir):
    return chunks.first_seen(_requested(spark, sf_dir), "requested_key", "ordinal")


def targeted_repair_rows(spark, sf_dir):
    found = chunks.targeted(read(spark, sf_dir, "customer"), requested_keys_distinct(spark, sf_dir), "c_custkey")
    return found.select("ordinal", "c_custkey", "c_name", "c_acctbal")


def targeted_repair_missing(spark, sf_dir):
    return chunks.missing(read(spark, sf_dir, "customer"), requested_keys_distinct(spark, sf_dir), "c_custkey")


def targeted_repair_collated(spark, sf_dir):
    """Requested names in another case find their rows by the column's collation."""
    asked = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("requested"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return asked.join(rows, F.collate(F.col("requested"), "UTF8_LCASE") == F.collate(F.col("n_name"), "UTF8_LCASE")).select("requested", "n_nationkey", "n_name")


NEUTRAL = {"bigint": "INTEGER", "int": "INTEGER", "double": "FLOAT", "string": "STRING", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "binary": "BINARY"}


def neutral_type(kind: str) -> str:
    """Neutral family of a Spark type name; nested types are unsupported."""
    return "DECIMAL" if kind.startswith("decimal") else NEUTRAL.get(kind, "UNSUPPORTED")


def catalog_rows(df, contract):
    return [
        (contract.table.display, c, i, neutral_type(kind), c in contract.keys, contract.keys.index(c) + 1 if c in contract.keys else None)
        for i, (c, kind) in enumerate(df.dtypes, 1)
    ]


def schema_catalog(spark, sf_dir):
    rows = [r for name, c in CONTRACTS.items() for r in catalog_rows(read(spark, sf_dir, name), c)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, neutral_type string, primary_key boolean, key_ordinal int")


def _catalog_oracle():
    keys = ", ".join(f"('{c.table.name}', '{k}', {i})" for c in CONTRACTS.values() for i, k in enumerate(c.keys, 1))
    names = ", ".join(f"'{n}'" for n in CONTRACTS)
    return f"""
        WITH k(t, c, o) AS (VALUES {keys})
        SELECT 'shop.public.' || table_name AS table_name, column_name, CAST(ordinal_position AS INTEGER) AS position,
               CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INTEGER' WHEN data_type = 'DOUBLE' THEN 'FLOAT'
                    WHEN data_type = 'VARCHAR' THEN 'STRING' WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE 'UNSUPPORTED' END AS neutral_type,
               o IS NOT NULL AS primary_key, CAST(o AS INTEGER) AS key_ordinal
        FROM information_schema.columns LEFT JOIN k ON t = table_name AND c = column_name WHERE table_name IN ({names})"""


def pk_contract_check(spark, sf_dir):
    return reduce(lambda a, b: a.unionByName(b), [chunks.key_violations(read(spark, sf_dir, n), n, c.keys) for n, c in CONTRACTS.items()])


def _contract_oracle():
    one = "SELECT '{n}' AS table_name, count(*) AS n_rows, count(*) FILTER (WHERE {null}) AS null_keys, count(DISTINCT ({keys})) FILTER (WHERE NOT ({null})) AS distinct_keys FROM {n}"
    parts = [one.format(n=n, null=" OR ".join(f"{k} IS NULL" for k in c.keys), keys=", ".join(c.keys)) for n, c in CONTRACTS.items()]
    return f"SELECT *, null_keys = 0 AND n_rows = distinct_keys AS key_holds FROM ({' UNION ALL '.join(parts)}) AS x"


def selected_columns(spark, sf_dir):
    """Columns of the contract without the ignored one: it isn't read."""
    df = read(spark, sf_dir, "customer")
    return df.select(*CONTRACTS["customer"].selected(df))


QUERIES = {
    f.__name__: f
    for f in (
        upper_bound_pk, upper_bound_pk_composite, next_chunk, next_chunk_bounded, next_chunk_composite, chunk_assignment, chunk_boundaries,
        requested_keys_distinct, targeted_repair_rows, targeted_repair_missing, targeted_repair_collated, schema_catalog, pk_contract_check, selected_columns,
    )
}

_CHUNKS = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk_id FROM orders"
_DISTINCT = f"SELECT requested_key, min(ordinal) AS ordinal FROM ({REQUESTED}) AS r GROUP BY requested_key"
ORACLES = {
    "upper_bound_pk": "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 1",
    "upper_bound_pk_composite": "SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 1",
    "next_chunk": "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) <= 100 AS final_chunk FROM customer ORDER BY c_custkey LIMIT 100",
    "next_chunk_bounded": """
        WITH p AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey > 24 AND c_custkey <= 90)
        SELECT c_custkey, c_name, (SELECT count(*) FROM p) <= 100 AS final_chunk FROM p ORDER BY c_custkey LIMIT 100""",
    "next_chunk_composite": """
        WITH p AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id > 3 OR (conv_id = 3 AND turn > 1))
        SELECT conv_id, turn, role, (SELECT count(*) FROM p) <= 50 AS final_chunk FROM p ORDER BY conv_id, turn LIMIT 50""",
    "chunk_assignment": _CHUNKS,
    "chunk_boundaries": f"""
        WITH b AS (SELECT chunk_id, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM ({_CHUNKS}) AS c GROUP BY chunk_id)
        SELECT *, lag(last_key) OVER (ORDER BY chunk_id) AS start_after FROM b""",
    "requested_keys_distinct": _DISTINCT,
    "targeted_repair_rows": f"SELECT ordinal, c_custkey, c_name, c_acctbal FROM ({_DISTINCT}) AS r JOIN customer ON c_custkey = requested_key",
    "targeted_repair_missing": f"SELECT * FROM ({_DISTINCT}) AS r WHERE requested_key NOT IN (SELECT c_custkey FROM customer)",
    "targeted_repair_collated": "SELECT lower(a.n_name) AS requested, b.n_nationkey, b.n_name FROM nation a JOIN nation b ON lower(a.n_name) = lower(b.n_name)",
    "schema_catalog": _catalog_oracle(),
    "pk_contract_check": _contract_oracle(),
    "selected_columns": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer",
}
