"""Neutral values, literals, positions and classifiers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import classify, literals, normalize, positions
from tidemark.operators import folds, targets
from tidemark.operators.ordering import numbered, running_sums
from tidemark.sources.tables import TableId


def values(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.v for r in rows.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_booleans(spark):
    assert values(spark, normalize.boolean, ["T", " yes", "0", "off", None]) == [True, True, False, False, None]
    with pytest.raises(PySparkException):
        values(spark, normalize.boolean, ["maybe"])


def test_integers_are_exact(spark):
    assert [int(v) for v in values(spark, normalize.integer, ["12", " 7.0 ", "99999999999999999999"])] == [12, 7, 99999999999999999999]
    with pytest.raises(PySparkException):
        values(spark, normalize.integer, ["1.5"])


def test_timestamps_keep_what_they_cannot_read(spark):
    got = values(spark, normalize.timestamp_text, ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05.5", "2024-01-02T03:04:05+01:00", "soon", None])
    assert got == ["2024-01-02T03:04:05.000000Z", "2024-01-02T03:04:05.500000", "2024-01-02T02:04:05.000000Z", "soon", None]


def test_times(spark):
    assert values(spark, normalize.time_text, ["10:11", "10:11:12.5+02", "2024-01-01 09:08:07Z", None]) == ["10:11:00", "10:11:12.5", "09:08:07", None]
    with pytest.raises(PySparkException):
        values(spark, normalize.time_text, ["noon"])


def test_binary_and_uuid(spark):
    assert [bytes(v) for v in values(spark, normalize.binary, ["\\x00ff", "é"])] == [b"\x00\xff", b"\xe9"]
    assert values(spark, normalize.uuid, ["0A000000-0000-0000-0000-00000000000f"]) == ["0a000000-0000-0000-0000-00000000000f"]
    with pytest.raises(PySparkException):
        values(spark, normalize.uuid, ["no"])


@pytest.mark.parametrize("value", ["a,b", "x=y", "{z}", "tail\\", "\\,={}", "", "é"])
def test_literals_round_trip(spark, value):
    rows = spark.createDataFrame([(value, "7")], "a string, b string")
    text = rows.select(literals.composite({"a": F.col("a"), "b": F.col("b")}).alias("x")).first().x
    assert literals.parse(text, ["a", "b"]) == {"a": value, "b": "7"}
    parts = [("a", "STRING", value), ("b", "INTEGER", "7")]
    assert literals.load(literals.store(parts)) == parts


def test_literal_forms_and_errors():
    assert literals.parse("12", ["id"]) == {"id": "12"}
    assert literals.parse("(1, 2)", ["a", "b"]) == {"a": "1", "b": " 2"}
    for bad in ("{a=1}", "{a=1,a=2}", "{a=1,b=2\\}", "(1)", "1,2", "{a,b=2}"):
        with pytest.raises(ValueError):
            literals.parse(bad, ["a", "b"])


def test_positions_order_by_number(spark):
    rows = spark.createDataFrame([("0/FFFFFFFF",), ("1/0",), ("0/A",)], "x string")
    assert [r.x for r in rows.orderBy(positions.lsn(F.col("x"))).collect()] == ["0/A", "0/FFFFFFFF", "1/0"]
    p = spark.range(1).select(positions.binlog(F.lit("bin.log.000012:34;gtid=u:1-5")).alias("p")).first().p
    assert tuple(p) == ("bin.log", 12, 34, "u:1-5")


def test_numbering_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r.n for r in numbered(df, ["k"], "n").orderBy("k").collect()] == list(range(1, 1001))
    sums = running_sums(df, ["k"], {"s": F.col("k")}).orderBy("k").collect()
    assert all(r.s == r.k * (r.k + 1) // 2 for r in sums)
    assert numbered(df.filter("k < 0"), ["k"], "n").count() == 0


def test_folds_reset(spark):
    import datetime as dt

    import pandas as pd

    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 10, 11, 30])] + [(2, 9, start)]
    df = spark.createDataFrame(rows, "s int, seq int, ts timestamp")
    flush = {(r.s, r.seq): r.flush for r in folds.flush_points(df, "s", "seq", "ts", 3, pd.Timedelta("5s")).collect()}
    assert [k for k, v in flush.items() if v] == [(1, 2), (1, 5)]
    due = {(r.s, r.seq): r.due for r in folds.due_beats(df, "s", "seq", "ts", pd.Timedelta("10s")).collect()}
    assert sorted(k for k, v in due.items() if v) == [(1, 0), (1, 3), (1, 5), (2, 9)]


def test_target_statements_against_sqlite(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "t" ("k" INTEGER PRIMARY KEY, "value" REAL)')
        c.execute("INSERT INTO t VALUES (1, 1.0), (2, 2.0)")
    rows = [(0, 1, "DELETE", None), (2, 3, "INSERT", 3.0), (4, 2, "UPDATE", 9.0), (6, 1, "INSERT", 5.0), (8, 3, "DELETE", None)]
    df = spark.createDataFrame(rows, "pos long, k long, op string, value double").repartition(3)
    targets.apply_by_partition(df, lambda: sqlite3.connect(path, timeout=30), "sqlite", "t")
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, 5.0), (2, 9.0)]


def test_composite_keys_several_columns_and_broken_keys(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE t (a INTEGER, b TEXT, v REAL, w TEXT, PRIMARY KEY (a, b))')
        c.execute("INSERT INTO t VALUES (1, 'x', 1.0, 'old'), (2, 'x', 2.0, 'old'), (1, 'y', 3.0, 'old')")
    schema = "pos long, a long, b string, op string, v double, w string, after_a long, after_b string"
    rows = [(0, 1, "x", "UPDATE", 9.0, "n", 1, "x"), (2, 1, "y", "DELETE", None, None, None, None), (4, 3, "z", "INSERT", 5.0, None, 3, "z"), (6, 1, "x", "UPDATE", 10.0, "m", 1, "x")]
    keys, values = ("a", "b"), ("v", "w")

    def put(rows):
        df = spark.createDataFrame(rows, schema).repartition(3)
        targets.apply_by_partition(df, lambda: sqlite3.connect(path, timeout=30), "sqlite", "t", keys, values, images=("after_a", "after_b"))

    put(rows)
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT * FROM t ORDER BY a, b").fetchall() == [(1, "x", 10.0, "m"), (2, "x", 2.0, "old"), (3, "z", 5.0, None)]
    for bad, why in (((8, 1, "x", "UPDATE", 1.0, "q", 2, "x"), "another key"), ((8, None, "x", "INSERT", 1.0, "q", None, "x"), "null key")):
        with pytest.raises(PySparkException, match=why):
            put([bad])
    kinds = [t for t in vars(targets).values() if isinstance(t, type) and issubclass(t, targets.TargetError) and not t.retryable and t is not targets.TargetError]
    assert len(kinds) == 8


def test_folds_against_a_walk(spark):
    import random

    import pandas as pd

    rng = random.Random(2)
    rows, t = [], {1: 0.0, 2: 0.0, 3: 0.0}
    for seq in range(900):
        s = rng.choice([1, 1, 1, 2, 3])
        t[s] += rng.choice([0.1, 0.5, 4.0, -2.0])
        rows.append((s, seq, t[s]))
    df = spark.createDataFrame(rows, "s int, seq int, at double").withColumn("ts", F.timestamp_seconds("at"))
    flush, due = set(), set()
    for s in t:
        count, first, last = 0, None, None
        for _, seq, at in (r for r in rows if r[0] == s):
            at = round(at * 1e6)
            first = at if not count else first
            count += 1
            if count >= 7 or at - first >= 5_000_000:
                flush.add((s, seq))
                count = 0
            if last is None or at < last or at - last >= 3_000_000:
                due.add((s, seq))
                last = at
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert {(r.s, r.seq) for r in folds.flush_points(df, "s", "seq", "ts", 7, pd.Timedelta("5s")).filter("flush").collect()} == flush
        assert {(r.s, r.seq) for r in folds.due_beats(df, "s", "seq", "ts", pd.Timedelta("3s")).filter("due").collect()} == due
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)


def test_target_text_and_retries():
    assert targets.upsert_statement("postgres", "s.t", ["id"], []).endswith('ON CONFLICT ("id") DO NOTHING')
    assert targets.upsert_statement("mysql", "t", ["id"], ["v"]).endswith("AS new_row ON DUPLICATE KEY UPDATE `v` = new_row.`v`")
    assert targets.delete_statement("mysql", "t", ["a", "b"]) == "DELETE FROM `t` WHERE `a` = %s AND `b` = %s"
    assert targets.mirror_name("db", None, "my-table", "db..my-table") == "MIRROR_DB_MY_TABLE"
    long = targets.mirror_name("d" * 40, "s", "t" * 40, "x")
    assert len(long) <= 67
    assert targets.text_hash("hello") == 99162322
    tries = []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise targets.TargetUnavailable("down")
        return "done"

    assert targets.retrying(action, sleep=lambda s: None) == "done"
    with pytest.raises(targets.TargetKeyMismatch):
        targets.retrying(lambda: (_ for _ in ()).throw(targets.TargetKeyMismatch("k")))


def test_table_names():
    assert TableId.parse("a.b.c").display == "a.b.c"
    assert TableId.parse("s.t", "schema", database="d").display == "d.s.t"
    for bad in ("a.b", "a..c"):
        with pytest.raises(ValueError):
            TableId.parse(bad)


def test_statements_by_verb_and_object(spark):
    cases = [
        ("set names utf8", None, "SESSION"),
        ("TRUNCATE orders", "shop", "FAIL_CLOSED"),
        ("create table x (i int)", "shop", "FAIL_CLOSED"),
        ("alter table `shop` . `orders` add c int", "other", "FAIL_CLOSED"),
        ("alter table shop.orders_old add c int", "other", "OTHER_DATABASE"),
        ("drop table x", "other", "OTHER_DATABASE"),
        ("create definer = `a`@`b` view v as select 1", "shop", "BENIGN"),
        ("create unique index i on t (a)", "shop", "BENIGN"),
        ("optimize local table t", "shop", "BENIGN"),
        ("flush", "shop", "BENIGN"),
        ("insert into t values (1)", "shop", "FAIL_CLOSED"),
        (None, "shop", "FAIL_CLOSED"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, sql string, db string, want string")
    found = rows.select("i", "want", classify.statement(F.col("sql"), F.col("db"), ["shop"], ["shop.orders"]).alias("got")).orderBy("i").collect()
    assert [r.got for r in found] == [r.want for r in found]
