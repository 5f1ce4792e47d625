"""Requests, progress and the coordinator."""

import pytest

from tidemark.operators.coordinator import Coordinator, Settings
from tidemark.operators.requests import Progress, Request, RequestStore, StateError


def test_request_rules():
    Request("1", "ALL_TABLES")
    Request("1", "PRIMARY_KEYS", "t", ("1",))
    for bad in (("1", "TABLE"), ("1", "ALL_TABLES", "t"), ("1", "PRIMARY_KEYS", "t"), ("1", "TABLE", "t", ("1",)), ("1", "SOME", "t"), ("1", "PRIMARY_KEYS", "t", tuple("x" * 501))):
        with pytest.raises(ValueError):
            Request(*bad)


@pytest.mark.parametrize(
    "fields",
    [
        {"low": "a"}, {"start_after": "1", "upper_bound": "9"}, {"low": "a", "high": "a"}, {"low": "a", "high": "b", "upper_bound": "9", "last_completed": "1"},
        {"completed": True}, {"completed": True, "last_completed": "1", "upper_bound": "9", "low": "a", "high": "b", "start_after": "1"},
        {"last_completed": "1"}, {"low": "a", "high": "b", "start_after": "1"},
    ],
)
def test_progress_that_cannot_be(fields):
    with pytest.raises(StateError):
        Progress("j", "t", "f", **fields)


def test_progress_moves():
    p = Progress("j", "t", "f").bound("9").begin()
    assert p.low != p.high
    assert p.restart().low is None
    p = p.complete("4", final=False).begin()
    assert p.start_after == "4"
    p = p.complete(None, final=True)
    assert (p.last_completed, p.completed) == ("9", True)
    with pytest.raises(StateError):
        p.bound("10")


def test_store_compares_and_sets(spark, tmp_path):
    store = RequestStore(spark, str(tmp_path / "requests"))
    assert store.next() is None
    for i in range(3):
        store.submit(Request(f"r{i}", "TABLE", "t"))
    assert store.next()["request_id"] == "r0"
    store.move("r0", ("QUEUED",), "ACTIVE")
    with pytest.raises(StateError):
        store.move("r0", ("QUEUED",), "ACTIVE")
    with pytest.raises(StateError):
        store.move("r0", ("ACTIVE",), "FAILED")
    store.move("r0", ("ACTIVE",), "FAILED", reason="drift")
    store.move("r1", ("QUEUED",), "COMPLETED")
    assert [r.request_id for r in store.current().orderBy("seq").collect()] == ["r1", "r2"]
    stale = store.journal.version()
    store.move("r2", ("QUEUED",), "ACTIVE")
    with pytest.raises(StateError):
        store.journal.append(store.journal.row("request", "r2", None), stale)


def test_coordinator(spark, tmp_path):
    table = spark.createDataFrame([(k, float(k)) for k in range(250)], "k long, value double")
    log = spark.createDataFrame([(2 * i, "a.b.t", i % 50, "UPDATE", 1000.0 + i) for i in range(300)], "pos long, table_name string, k long, op string, value double")
    store = RequestStore(spark, str(tmp_path / "requests"))
    runner = Coordinator({"a.b.t": table}, log, store)
    store.submit(Request("all", "ALL_TABLES"))
    store.submit(Request("keys", "PRIMARY_KEYS", "a.b.t", ("249", "3", "999", "249")))
    seen = []
    assert runner.run_next(lambda df: seen.append(df.collect())).request_id == "all"
    assert runner.run_next(lambda df: seen.append(df.collect())).request_id == "keys"
    assert runner.run_next(seen.append) is None
    assert sum(r.origin == "LOG" for r in seen[0]) == 300
    assert {r.k for r in seen[0] if r.origin == "SELECT"} >= set(range(50, 250))
    assert [r.k for r in seen[1] if r.origin == "SELECT"] == [249]
    assert store.current().filter("request_id = 'keys'").first().missing == ["999"]
    store.submit(Request("bad", "TABLE", "a.b.t"))
    with pytest.raises(ZeroDivisionError):
        runner.run_next(lambda df: 1 / 0)
    assert store.current().filter("request_id = 'bad'").first().state == "FAILED"
    with pytest.raises(ValueError):
        Settings(chunk_size=0)


def test_control_plane(spark, tmp_path):
    from tidemark.operators.control_plane import ControlPlane
    from tidemark.sources.tables import CONTRACTS, TableContract, TableId

    store = RequestStore(spark, str(tmp_path / "requests"))
    events = spark.createDataFrame([(2 * i, "a.b.t", i, "UPDATE") for i in range(20)], "pos long, table_name string, k long, op string")
    contract = TableContract(TableId("a", "b", "t"), ("k",))
    plane = ControlPlane(store, events, [(contract, events)])
    plane.submit(Request("1", "TABLE", "a.b.t"))
    with pytest.raises(ValueError):
        plane.submit(Request("2", "TABLE", "a.b.other"))
    assert plane.status() == {"pending_requests": 1, "observed_events": 20, "last_position": 38}
    assert [r.pos for r in plane.recent_events(2).collect()] == [38, 36]
    assert plane.requests("QUEUED").count() == 1
    assert plane.startup_check().first().key_holds
    with pytest.raises(ValueError):
        plane.requests("SOMETHING")
    with pytest.raises(ValueError):
        ControlPlane(store, events, [(CONTRACTS["orders"], events)]).startup_check()


def test_recorded_messages(spark, tmp_path):
    from tidemark.sources import message_log

    rows = [(1, "BEGIN"), (2, "WRITE"), (3, "DELETE"), (4, "COMMIT"), (5, "QUERY"), (6, "UPDATE")]
    df = spark.createDataFrame([(s, k, "a.b.t", s, 1.0, "TRUNCATE t" if k == "QUERY" else None, "a") for s, k in rows], message_log.SCHEMA)
    df.write.json(str(tmp_path / "log"))
    read = message_log.read_messages(spark, str(tmp_path / "log"))
    assert sorted((r.seq, r.op, r.commit_seq, r.value) for r in message_log.change_events(read).collect()) == [(2, "INSERT", 4, 1.0), (3, "DELETE", 4, None)]
    assert [r.seq for r in message_log.fatal_statements(read, ["a"], ["a.t"]).collect()] == [5]
