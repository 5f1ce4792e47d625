"""Normalisation, coercion, literals, positions and classifiers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classify, key_columns, literals, normalize, positions
from tidemark.operators.ordering import numbered
from tidemark.sources.tables import read

from . import snapshot

# Texts and statements that the tables' ids choose from, with what is expected of each where SQL can't say it.
BOOLEANS = (("t", True), ("TRUE", True), (" yes ", True), ("1", True), ("On", True), ("f", False), ("false", False), (" NO", False), ("0", False), ("off", False))
STATEMENTS = (
    ("SET autocommit = 1", None, "SESSION"),
    ("truncate table shop.customer", "shop", "FAIL_CLOSED"),
    ("ALTER TABLE t ADD c INT", "other", "OTHER_DATABASE"),
    ("DROP TABLE `shop` . `customer`", "other", "FAIL_CLOSED"),
    ("GRANT SELECT ON *.* TO u", "shop", "BENIGN"),
    ("CREATE DEFINER=root VIEW v AS SELECT 1", "shop", "BENIGN"),
    ("create unique index i on customer (id)", "shop", "BENIGN"),
    ("ANALYZE LOCAL TABLE customer", "shop", "BENIGN"),
    ("FLUSH", "shop", "BENIGN"),
    ("RESET MASTER", "shop", "BENIGN"),
    ("CREATE TABLE shop.new_one (id INT)", "shop", "FAIL_CLOSED"),
    ("LOAD DATA INFILE 'x'", "shop", "FAIL_CLOSED"),
    ("ALTER TABLE shop.customers ADD c INT", None, "FAIL_CLOSED"),
)
FAILURES = (
    ("28000", "login", "FAIL_HARD_CONTRACT_BREACH"),
    ("08006", "gone", "RETRYABLE_AVAILABILITY"),
    ("42P01", "connection refused", "FAIL_HARD_CONTRACT_BREACH"),
    (None, "Connection RESET by peer", "RETRYABLE_AVAILABILITY"),
    ("HY000", "Unknown database 'x'", "FAIL_HARD_CONTRACT_BREACH"),
    ("HY000", "password authentication failed", "FAIL_HARD_CONTRACT_BREACH"),
    (None, None, "FAIL_HARD_CONTRACT_BREACH"),
    ("57P01", "server temporarily unavailable", "RETRYABLE_AVAILABILITY"),
    ("3D000", "broken pipe", "FAIL_HARD_CONTRACT_BREACH"),
)
LABELS = ((None, "count"), ("batched-threshold", "count"), ("batched-time", "time"), ("stage-end", "boundary"), ("shutdown", "boundary"))
# Which neutral types a target column takes besides its own.
TAKES = {
    "STRING": ("BOOLEAN", "INTEGER", "FLOAT", "DECIMAL", "JSON", "DATE", "TIME", "TIMESTAMP", "UUID", "XML", "ENUM_STRING"),
    "BOOLEAN": ("INTEGER", "STRING"),
    "INTEGER": ("BOOLEAN", "STRING"),
    "FLOAT": ("INTEGER", "DECIMAL", "STRING"),
    "DECIMAL": ("INTEGER", "FLOAT", "STRING"),
    "DATE": ("TIMESTAMP", "STRING"),
    "TIME": ("TIMESTAMP", "STRING"),
    "TIMESTAMP": ("DATE", "STRING"),
    "UUID": ("STRING",),
    "JSON": ("STRING",),
    "XML": ("STRING",),
    "ENUM_STRING": ("STRING",),
    "BINARY": (),
    "UNSUPPORTED": (),
}


def compatible(source: str, target: str) -> bool:
    return source == target or source in TAKES[target]


def _pick(rows, key, at: int = 0):
    """The text of ``rows`` that an integer column chooses."""
    return F.element_at(F.array(*[F.lit(r[at]).cast("string") for r in rows]), (F.col(key) % len(rows) + 1).cast("int"))


def _pick_sql(rows, key, at: int = 0) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(rows)} " + " ".join(f"WHEN {i} THEN {text(r[at])}" for i, r in enumerate(rows)) + " END"


def normalize_boolean(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", normalize.boolean(_pick(BOOLEANS, "event_id")).alias("value"))


def normalize_integer(spark, sf_dir):
    text = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", normalize.integer(text).cast("long").alias("value"))


def normalize_decimal(spark, sf_dir):
    """Doubles by their shortest text, written out again as text."""
    return read(spark, sf_dir, "orders").select("o_orderkey", normalize.decimal_of_double(F.col("o_totalprice"), 18, 2).cast("string").alias("value"))


def _time_forms(ts: str, key: str) -> tuple:
    """Texts of a timestamp column in four forms."""
    plain = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    forms = (plain, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.concat(plain, F.lit("+02:00")), F.concat(F.lit("at "), plain))
    out = forms[3]
    for i in range(3):
        out = F.when(F.col(key) % 4 == i, forms[i]).otherwise(out)
    return out


def normalize_timestamp(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", normalize.timestamp_text(_time_forms("ts", "event_id")).alias("value"))


def normalize_time(spark, sf_dir):
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 3 == 0, clock).when(F.col("event_id") % 3 == 1, F.concat(clock, F.lit("+0200"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd "), F.date_format("ts", "HH:mm")))
    return read(spark, sf_dir, "events").select("event_id", normalize.time_text(text).alias("value"))


def normalize_binary(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\\x"), F.hex(F.encode("props", "UTF-8")))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.lower(F.hex(normalize.binary(text))).alias("value"))


def decode_tuple(spark, sf_dir):
    """Positional tuples to the columns of the contract; positions that it doesn't select are dropped."""
    wire = read(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("wire"))
    at = F.split("wire", r"\|")
    return wire.select(at[0].cast("long").alias("o_orderkey"), at[2].alias("o_orderstatus"), at[3].alias("o_orderpriority"))


ADAPTIVE = (("INTEGER", "12", "INTEGER"), ("INTEGER", "12.5", "DECIMAL"), ("INTEGER", "abc", "STRING"), ("BOOLEAN", "7", "INTEGER"), ("BOOLEAN", "yes", "BOOLEAN"), ("DATE", "2024-02-30x", "STRING"), ("DECIMAL", "1e5", "DECIMAL"), ("UUID", "2024-01-02", "DATE"), ("STRING", "5", "STRING"))


def adaptive_decode(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    declared, text = _pick(ADAPTIVE, "event_id"), _pick(ADAPTIVE, "event_id", 1)
    return e.select("event_id", declared.alias("declared"), text.alias("text"), normalize.adaptive_family(declared, text).alias("decoded"))


def coercion_matrix(spark, sf_dir):
    rows = [(s, t, compatible(s, t)) for s in TAKES for t in TAKES]
    return spark.createDataFrame(rows, "source_type string, target_type string, compatible boolean")


def coerce_values(spark, sf_dir):
    """Booleans to integers, timestamps to dates, times and ISO text, numbers to text."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("bool_as_integer"),
        F.to_date("ts").cast("string").alias("ts_as_date"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("ts_as_time"),
        F.date_format(F.to_date("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("date_as_ts"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("instant_as_text"),
        F.col("user_id").cast("string").alias("integer_as_text"),
    )


def pk_order(spark, sf_dir):
    """Typed order and text order of the same keys."""
    keys = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("text"))
    return numbered(numbered(keys, ["c_custkey"], "typed_rank"), ["text"], "text_rank").drop("text")


def _lsn(spark, sf_dir):
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.hex(i % 7), F.lit("/"), F.hex(i * 7919 % 4294967296)).alias("lsn"))


def lsn_parse(spark, sf_dir):
    p = positions.lsn(F.col("lsn"))
    return _lsn(spark, sf_dir).select("event_id", "lsn", p["high"].alias("high"), p["low"].alias("low"), positions.lsn_text(p["high"], p["low"]).alias("again"))


def lsn_order(spark, sf_dir):
    rows = _lsn(spark, sf_dir).withColumn("at", positions.lsn(F.col("lsn")))
    return numbered(rows, ["at", "event_id"], "rank").select("event_id", "lsn", "rank")


def _binlog(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(F.lit("binlog."), F.lpad((i % 13).cast("string"), 6, "0"), F.lit(":"), (i * 31).cast("string"), F.when(i % 2 == 0, ";gtid=a-b:1-9").otherwise(""))
    return read(spark, sf_dir, "events").select("event_id", text.alias("position"))


def binlog_position_parse(spark, sf_dir):
    p = positions.binlog(F.col("position"))
    return _binlog(spark, sf_dir).select("event_id", p["prefix"].alias("prefix"), p["file_no"].alias("file_no"), p["offset"].alias("log_offset"), p["gtids"].alias("gtids"))


def binlog_position_order(spark, sf_dir):
    p = positions.binlog(F.col("position"))
    rows = _binlog(spark, sf_dir).select("event_id", F.struct(p["prefix"], p["file_no"], p["offset"]).alias("at"))
    return numbered(rows, ["at", "event_id"], "rank").select("event_id", "rank")


def pk_literal_single(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        "o_orderkey",
        literals.single(F.col("o_orderkey"), "bigint").alias("integer_literal"),
        literals.single((F.col("o_custkey") % 2 == 0), "boolean").alias("boolean_literal"),
        literals.single(price, "decimal(18,2)").alias("decimal_literal"),
        literals.single(F.col("o_orderdate"), "timestamp_ntz").alias("timestamp_literal"),
        literals.single(F.to_date("o_orderdate"), "date").alias("date_literal"),
        literals.single(F.encode("o_orderpriority", "UTF-8"), "binary").alias("binary_literal"),
    )


def _page_literal():
    return literals.composite({"url": F.concat(F.col("url"), F.lit(",{}\\")), "page_id": F.col("page_id").cast("string")})


def pk_literal_composite(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", _page_literal().alias("literal"))


def pk_literal_roundtrip(spark, sf_dir):
    """Literals parsed back, and their stored form loaded back."""
    found = pk_literal_composite(spark, sf_dir).select("page_id", key_columns.parse(F.col("literal"), ["url", "page_id"])["values"].alias("v"))
    stored = key_columns.store([(F.lit("url"), F.lit("STRING"), F.col("v")[0]), (F.lit("page_id"), F.lit("INTEGER"), F.col("v")[1])])
    back = found.withColumn("back", key_columns.load(stored))
    return back.select("page_id", F.col("back")[0]["literal"].alias("url"), F.col("back")[1]["literal"].cast("long").alias("key"))


def schema_fingerprint(spark, sf_dir):
    """SHA-256 over the table's name and each column's name, types, key flag and nullability, in order."""
    rows = snapshot.schema_catalog(spark, sf_dir)
    part = F.concat_ws(":", "column_name", "neutral_type", "neutral_type", F.col("primary_key").cast("string"), F.lit("true"))
    parts = F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("|"), part).alias("text"))))
    text = rows.groupBy("table_name").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return text.select("table_name", F.sha2(F.concat("table_name", "text"), 256).alias("fingerprint"))


def payload_encode(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    names = ["o_orderkey", "o_orderpriority", "note", "empty"]
    o = o.select("o_orderkey", "o_orderpriority", F.concat(F.lit("a=b,{"), F.col("o_orderstatus"), F.lit("}\\")).alias("note"), F.lit(None).cast("string").alias("empty"))
    fields = [F.concat(F.lit(f"{n}="), literals.payload(F.col(n), dict(o.dtypes)[n])) for n in names]
    return o.select("o_orderkey", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("payload"))


def ddl_classify(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", _pick(STATEMENTS, "event_id").alias("statement"), _pick(STATEMENTS, "event_id", 1).alias("database"))
    return e.select("event_id", "statement", classify.statement(F.col("statement"), F.col("database"), ["shop"], ["shop.customer", "shop.orders"]).alias("decision"))


def failure_classify(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", classify.failure(_pick(FAILURES, "event_id"), _pick(FAILURES, "event_id", 1)).alias("disposition"))


def checkpoint_reason(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", classify.checkpoint_reason(_pick(LABELS, "event_id")).alias("reason"))


def target_preflight(spark, sf_dir):
    """Problems of a target that has the first four columns, text for every float, and one key column a table."""
    source = snapshot.schema_catalog(spark, sf_dir)
    target = source.filter("position <= 4").select("table_name", "column_name", F.when(F.col("neutral_type") == "FLOAT", "STRING").otherwise(F.when(F.col("neutral_type") == "TIMESTAMP", "INTEGER").otherwise(F.col("neutral_type"))).alias("target_type"), (F.col("key_ordinal") == 1).alias("target_key"))
    pairs = coercion_matrix(spark, sf_dir).withColumnRenamed("source_type", "neutral_type")
    both = source.join(target, ["table_name", "column_name"], "left").join(F.broadcast(pairs), ["neutral_type", "target_type"], "left")
    problem = (
        F.when(F.col("target_type").isNull(), "MISSING_COLUMN")
        .when(F.col("primary_key") & ~F.coalesce("target_key", F.lit(False)), "KEY_MISMATCH")
        .when(~F.coalesce("compatible", F.lit(False)), "TYPE_MISMATCH")
    )
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("table_name", "column_name", "problem")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_boolean, normalize_integer, normalize_decimal, normalize_timestamp, normalize_time, normalize_binary, decode_tuple, adaptive_decode,
        coercion_matrix, coerce_values, pk_order, lsn_parse, lsn_order, binlog_position_parse, binlog_position_order, pk_literal_single,
        pk_literal_composite, pk_literal_roundtrip, schema_fingerprint, payload_encode, ddl_classify, failure_classify, checkpoint_reason, target_preflight,
    )
}

_ESC = r"regexp_replace({}, '([\\,={{}}])', '\\\1', 'g')"
_CAT = snapshot.ORACLES["schema_catalog"]
_LSN = "SELECT event_id, upper(to_hex(event_id % 7)) || '/' || upper(to_hex(event_id * 7919 % 4294967296)) AS lsn, event_id % 7 AS high, event_id * 7919 % 4294967296 AS low FROM events"
_PAIRS = ", ".join(f"('{s}', '{t}')" for t, sources in TAKES.items() for s in (t, *sources) if not (s == t == ""))
ORACLES = {
    "normalize_boolean": f"SELECT event_id, {_pick_sql(BOOLEANS, 'event_id', 1)} AS value FROM events",
    "normalize_integer": "SELECT o_orderkey, o_custkey AS value FROM orders",
    "normalize_decimal": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders",
    "normalize_timestamp": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000000') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000000Z')
            WHEN 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000000Z') ELSE 'at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') END AS value FROM events""",
    "normalize_time": "SELECT event_id, CASE event_id % 3 WHEN 2 THEN strftime(ts, '%H:%M:00') ELSE strftime(ts, '%H:%M:%S.%f') END AS value FROM events",
    "normalize_binary": "SELECT event_id, lower(hex(encode(props))) AS value FROM events",
    "decode_tuple": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "adaptive_decode": f"SELECT event_id, {_pick_sql(ADAPTIVE, 'event_id')} AS declared, {_pick_sql(ADAPTIVE, 'event_id', 1)} AS text, {_pick_sql(ADAPTIVE, 'event_id', 2)} AS decoded FROM events",
    "coercion_matrix": f"""
        WITH t(x) AS (VALUES {', '.join(f"('{t}')" for t in TAKES)}), p(s, t) AS (VALUES {_PAIRS})
        SELECT a.x AS source_type, b.x AS target_type, (a.x, b.x) IN (SELECT (s, t) FROM p) AS compatible FROM t a, t b""",
    "coerce_values": """
        SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS bool_as_integer, strftime(ts, '%Y-%m-%d') AS ts_as_date, strftime(ts, '%H:%M:%S.%f') AS ts_as_time,
            strftime(ts, '%Y-%m-%dT00:00:00') AS date_as_ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS instant_as_text, CAST(user_id AS VARCHAR) AS integer_as_text FROM events""",
    "pk_order": "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS typed_rank, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS text_rank FROM customer",
    "lsn_parse": f"SELECT event_id, lsn, high, low, lsn AS again FROM ({_LSN}) AS x",
    "lsn_order": f"SELECT event_id, lsn, row_number() OVER (ORDER BY high, low, event_id) AS rank FROM ({_LSN}) AS x",
    "binlog_position_parse": "SELECT event_id, 'binlog' AS prefix, event_id % 13 AS file_no, event_id * 31 AS log_offset, CASE WHEN event_id % 2 = 0 THEN 'a-b:1-9' END AS gtids FROM events",
    "binlog_position_order": "SELECT event_id, row_number() OVER (ORDER BY event_id % 13, event_id * 31) AS rank FROM events",
    "pk_literal_single": """
        SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS integer_literal, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS boolean_literal,
            rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS decimal_literal, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp_literal,
            strftime(o_orderdate, '%Y-%m-%d') AS date_literal, lower(hex(encode(o_orderpriority))) AS binary_literal FROM orders""",
    "pk_literal_composite": "SELECT page_id, '{url=' || " + _ESC.format("(url || ',{}\\')") + " || ',page_id=' || page_id || '}' AS literal FROM pages",
    "pk_literal_roundtrip": "SELECT page_id, url || ',{}\\' AS url, page_id AS key FROM pages",
    "schema_fingerprint": f"""
        SELECT table_name, sha256(table_name || string_agg('|' || column_name || ':' || neutral_type || ':' || neutral_type || ':' || CASE WHEN primary_key THEN 'true' ELSE 'false' END || ':true', '' ORDER BY position)) AS fingerprint
        FROM ({_CAT}) AS c GROUP BY table_name""",
    "payload_encode": "SELECT o_orderkey, '{o_orderkey=Long:' || o_orderkey || ',o_orderpriority=str:' || o_orderpriority || ',note=str:a\\=b\\,\\{' || o_orderstatus || '\\}\\\\,empty=null}' AS payload FROM orders",
    "ddl_classify": f"SELECT event_id, {_pick_sql(STATEMENTS, 'event_id')} AS statement, {_pick_sql(STATEMENTS, 'event_id', 2)} AS decision FROM events",
    "failure_classify": f"SELECT event_id, {_pick_sql(FAILURES, 'event_id', 2)} AS disposition FROM events",
    "checkpoint_reason": f"SELECT event_id, {_pick_sql(LABELS, 'event_id', 1)} AS reason FROM events",
    "target_preflight": f"""
        SELECT * FROM (SELECT table_name, column_name, CASE WHEN position > 4 THEN 'MISSING_COLUMN' WHEN primary_key AND key_ordinal <> 1 THEN 'KEY_MISMATCH'
            WHEN neutral_type IN ('TIMESTAMP', 'UNSUPPORTED') THEN 'TYPE_MISMATCH' END AS problem FROM ({_CAT}) AS c) AS x WHERE problem IS NOT NULL""",
}
