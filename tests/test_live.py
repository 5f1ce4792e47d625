"""Dumps into a running log, restarts, the pump, and the state they keep."""

import pytest
from faults import FaultPlan, PlannedFault
from pyspark.sql import functions as F

from tidemark.operators.live import ControlLog, LiveDump, Pump
from tidemark.operators.requests import Progress, Request, RuntimeState, StateError

EVENT = "pos long, table_name string, k long, op string, value double"


def events(spark, *rows):
    return spark.createDataFrame([(p, "t", k, op, v) for p, k, op, v in rows], EVENT)


def table(spark, n=7):
    return spark.createDataFrame([(k, float(k)) for k in range(n)], "k long, value double")


def build(spark, folder, plan=None, rows=3, source=None):
    log, state = ControlLog(spark, f"{folder}/log", "run-1"), RuntimeState(spark, f"{folder}/state")
    return LiveDump("s", {"t": source or (lambda: table(spark))}, log, state, rows, plan or FaultPlan())


def folded(batches):
    """Last write of each key of what a sink has seen, in order."""
    state = {}
    for batch in batches:
        for r in sorted(batch, key=lambda r: (r.emit_pos, r.origin_rank, r.ordinal)):
            state[r.k] = None if r.op == "DELETE" else r.value
    return {k: v for k, v in state.items() if v is not None}


@pytest.mark.parametrize("place", ["after-begin", "before-high", "before-sink", "after-sink", "after-checkpoint"])
def test_a_dump_that_is_killed_goes_on_at_its_window(spark, tmp_path, place):
    seen, plan = [], FaultPlan(delay={"before-read": 0.01})
    dump = build(spark, tmp_path, plan)
    dump.log.append(events(spark, (2, 1, "UPDATE", 50.0)))
    changed = []

    def source():
        if not changed:  # the source changes between LOW and the read of the first window
            changed.append(1)
            dump.log.append(events(spark, (100, 2, "DELETE", None), (102, 5, "UPDATE", 70.0)))
        return table(spark)

    source()
    changed.clear()
    dump.tables["t"] = source
    done = []

    def sink(df):
        seen.append(df.collect())
        done.append(1)
        if len(done) == 1:
            plan.fail[place] = 1

    with pytest.raises(PlannedFault):
        dump.table("job", "t", sink)
    before = dump.state.progress("job", "t")
    assert not before.completed
    again = LiveDump("s", dump.tables, ControlLog(spark, f"{tmp_path}/log", "run-2"), RuntimeState(spark, f"{tmp_path}/state"), 3, plan)
    assert again.table("job", "t", sink) >= 2
    assert again.state.progress("job", "t").completed
    assert again.table("job", "t", sink) == 0
    assert {r.k for b in seen for r in b if r.origin == "SELECT"} >= {0, 3, 4, 6}
    tokens = [r.token for r in again.log.read().filter("op = 'WATERMARK'").collect()]
    assert len(tokens) == len(set(tokens))


def test_rows_changed_inside_the_window_lose(spark, tmp_path):
    dump, seen = build(spark, tmp_path, rows=10), []
    dump.log.append(events(spark, (2, 1, "UPDATE", 50.0)))

    def source():
        return table(spark)

    def during(step):
        if step == "after-read":
            dump.log.append(events(spark, (dump.log.top() + 1, 3, "UPDATE", 99.0), (dump.log.top() + 2, 4, "DELETE", None)))

    dump.tables["t"], dump.at = source, during
    assert dump.table("job", "t", lambda df: seen.append(df.collect())) == 1
    assert folded(seen) == {0: 0.0, 1: 1.0, 2: 2.0, 3: 99.0, 5: 5.0, 6: 6.0}
    assert {r.k for r in seen[0] if r.origin == "SELECT"} == {0, 1, 2, 5, 6}


def test_pump_serves_requests_then_the_stream(spark, tmp_path):
    dump, seen, now = build(spark, tmp_path, rows=4), [], [0.0]
    dump.log.append(events(spark, (2, 1, "UPDATE", 50.0)))
    requests = dump.state.requests
    requests.submit(Request("all", "ALL_TABLES"))
    requests.submit(Request("keys", "PRIMARY_KEYS", "t", ("6", "99")))

    def clock():
        now[0] += 1
        return now[0]

    assert Pump(dump, clock).run(lambda df: seen.append(df.collect())) == ["all", "keys"]
    states = {r.request_id: (r.state, r.missing) for r in requests.current().collect()}
    assert states == {"all": ("COMPLETED", []), "keys": ("COMPLETED", ["99"])}
    dump.log.append(events(spark, (dump.log.top() + 1, 1, "UPDATE", 51.0)))
    assert Pump(dump, clock).run(lambda df: seen.append(df.collect())) == []
    assert folded(seen)[1] == 51.0
    assert [r.k for r in seen[-1]] == [1]
    beats = dump.log.read().filter("op = 'HEARTBEAT'").count()
    assert 1 <= beats < now[0]
    stopped = Pump(dump, clock, stopped=True)
    assert stopped.run(seen.append) == []


def test_a_request_that_fails_stays_active_and_is_taken_up(spark, tmp_path):
    plan = FaultPlan(fail={"before-sink": 1})
    dump, seen = build(spark, tmp_path, plan, rows=10), []
    dump.log.append(events(spark, (2, 1, "UPDATE", 50.0)))
    dump.state.requests.submit(Request("r", "TABLE", "t"))
    with pytest.raises(PlannedFault):
        Pump(dump, lambda: 0.0).run(seen.append)
    assert dump.state.requests.next()["state"] == "ACTIVE"
    assert Pump(dump, lambda: 0.0).run(lambda df: seen.append(df.collect())) == ["r"]
    with pytest.raises(ValueError):
        FaultPlan(fail={"somewhere": 1})


def test_ownership_positions_and_invalidation(spark, tmp_path):
    state = RuntimeState(spark, str(tmp_path))
    with pytest.raises(ValueError):
        state.claim(" ")
    state.claim("s")
    state.claim("s")
    with pytest.raises(StateError):
        state.claim("other")
    assert state.resume_position("s") is None
    assert state.save_bootstrap("s", 5)
    assert state.resume_position("s") == 5
    state.save_progress(Progress("j", "t", "f", upper_bound="9"))
    state.signal("s", "column added")
    for k in range(3):
        state.requests.submit(Request(f"r{k}", "TABLE", "t"))
    state.requests.move("r0", ("QUEUED",), "COMPLETED")
    version = state.journal.version()
    state.invalidate("s", "the key has changed")
    assert state.journal.version() == version + 1
    assert state.resume_position("s") is None
    assert state.progress("j", "t") is None
    assert state.journal.current("signal").count() == 0
    assert {r.request_id: (r.state, r.reason) for r in state.requests.current().collect()} == {"r0": ("COMPLETED", None), "r1": ("FAILED", "the key has changed"), "r2": ("FAILED", "the key has changed")}
    state.save_checkpoint("s", 7)
    assert not state.save_bootstrap("s", 8)
    assert state.resume_position("s") == 7
    state.claim("s")


def test_windows_read_each_row_once(spark, tmp_path):
    """Planned ranges of the key, on a table in its order: what the scans of all windows read is little more than the table."""
    n, rows = 40_000, 4_000
    spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("double").alias("value")).repartitionByRange(8, "k").sortWithinPartitions("k").write.option("parquet.page.row.count.limit", 1000).parquet(str(tmp_path / "t"))
    log, state = ControlLog(spark, f"{tmp_path}/log", "run-1"), RuntimeState(spark, f"{tmp_path}/state")
    dump = LiveDump("s", {"t": lambda: spark.read.parquet(str(tmp_path / "t"))}, log, state, rows)
    progress = Progress("job", "t", "").bound(str(n - 1))
    ends = list(dump._ends("t", progress))
    assert ends == list(range(rows - 1, n, rows))
    read = 0
    for before, end in zip([None, *map(str, ends)], ends, strict=False):
        part = dump._range("t", before, end)
        assert len(part.collect()) == rows
        read += part._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert n <= read <= 1.6 * n
