"""Each finding of the preflight, and none for a source that is as it must be."""

from tidemark.operators import preflight

SETTINGS = "source string, kind string, name string, value string"
TABLES = "source string, kind string, table_name string, key_columns int, replica_identity string, published boolean"
PUBLICATIONS = "source string, publication string, inserts boolean, updates boolean, deletes boolean, truncates boolean, by_root boolean"
SLOTS = "source string, slot string, plugin string, database string, own_database string, active boolean, invalid boolean"


def found(df):
    return sorted((r.source, r.object, r.code) for r in df.collect())


def test_settings(spark):
    rows = [("a", "mysql", "LOG_BIN", "on"), ("a", "mysql", "binlog_format", "row"), ("a", "mysql", "binlog_row_image", "FULL"), ("b", "mysql", "binlog_format", "MIXED"), ("b", "mysql", "log_bin", None), ("c", "postgres", "wal_level", "Logical"), ("d", "oracle", "x", "y")]
    assert found(preflight.setting_findings(spark.createDataFrame(rows, SETTINGS))) == [("b", "binlog_format", "SETTING_WRONG"), ("b", "binlog_row_image", "SETTING_MISSING"), ("b", "log_bin", "SETTING_MISSING")]


def test_tables(spark):
    rows = [("a", "mysql", "t", 1, None, None), ("a", "mysql", "a.b", 0, None, None), ("p", "postgres", "t", 2, "FULL", True), ("p", "postgres", "u", None, "DEFAULT", None), ("p", "postgres", "é" * 32, 1, "FULL", True), ("p", "postgres", None, 1, "FULL", True)]
    want = [("a", "a.b", "BAD_NAME"), ("a", "a.b", "NO_KEY"), ("p", "u", "NOT_PUBLISHED"), ("p", "u", "NO_KEY"), ("p", "u", "REPLICA_IDENTITY"), ("p", "é" * 32, "BAD_NAME"), ("p", None, "BAD_NAME")]
    assert sorted(found(preflight.table_findings(spark.createDataFrame(rows[:-1], TABLES)))) == sorted(want[:-1])
    assert [tuple(r) for r in preflight.table_findings(spark.createDataFrame(rows[-1:], TABLES)).collect()] == want[-1:]


def test_publications_and_slots(spark):
    pubs = spark.createDataFrame([("p", "whole", True, True, True, True, True), ("p", "part", False, False, False, None, False)], PUBLICATIONS)
    assert [c for _, o, c in found(preflight.publication_findings(pubs)) if o == "part"] == ["NOT_BY_ROOT", "NO_DELETES", "NO_INSERTS", "NO_TRUNCATES", "NO_UPDATES"]
    slots = spark.createDataFrame([("p", "good", "pgoutput", "d", "d", False, False), ("p", "bad", "wal2json", "e", "d", True, True)], SLOTS)
    got = found(preflight.slot_findings(slots))
    assert [c for _, _, c in got] == ["SLOT_INVALID", "SLOT_IN_USE", "WRONG_DATABASE", "WRONG_PLUGIN"]
    assert {o for _, o, _ in got} == {"bad"}
    nothing = [spark.createDataFrame([], s) for s in (SETTINGS, TABLES, PUBLICATIONS, SLOTS)]
    assert preflight.findings(*nothing).count() == 0
