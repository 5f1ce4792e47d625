"""Golden reconciler cases, random logs against a plain fold, and the batch against the streaming form."""

import random

import pytest

from tidemark.operators import reconcile
from tidemark.streaming.jobs import MirrorStream, ReconcileStream, discard, fan_out

T, OTHER = "db.public.t", "db.public.other"
LOG = "pos long, table_name string, k long, op string, value double"
CHUNK = "k long, value double, ordinal long, chunk_id long, lo long, hi long"
OPS = {"i": "INSERT", "u": "UPDATE", "d": "DELETE"}


def build(spark, keys, script, composite=False):
    """script: i0 L u2 d3 H; a word with a dot names another table."""
    log, lo, hi = [], None, None
    for n, word in enumerate(script.split()):
        if word in "LH":
            lo, hi = (2 * n + 1, hi) if word == "L" else (lo, 2 * n + 1)
            continue
        table, word = (OTHER, word[6:]) if word.startswith("other.") else (T, word)
        log.append((2 * n, table, int(word[1:]), OPS[word[0]], None if word[0] == "d" else float(n)))
    chunk = [(k, 100.0 + k, i, 0, lo, hi) for i, k in enumerate(keys)]
    return spark.createDataFrame(chunk, CHUNK), spark.createDataFrame(log, LOG)


def emitted(spark, keys, script):
    chunk, log = build(spark, keys, script)
    rows = reconcile.emitted_stream(chunk, log, T).orderBy("emit_seq").collect()
    assert [r.emit_seq for r in rows] == list(range(1, len(rows) + 1))
    return " ".join(f"{'' if r.table_name == T else 'other.'}{'s' if r.origin == 'SELECT' else r.op[0].lower()}{r.k}" for r in rows)


@pytest.mark.parametrize(
    ("keys", "script", "expected"),
    [
        ([1, 2], "L u2 H", "u2 s1"),
        ([1, 2, 3], "i0 L u2 d3 H i4", "i0 u2 d3 s1 i4"),
        ([1, 2], "L other.u2 H", "other.u2 s1 s2"),
        ([], "L H", ""),
        ([1, 2, 3], "L u1 u2 d3 H", "u1 u2 d3"),
        ([1, 2], "u1 L H u2", "u1 s1 s2 u2"),
        (list(range(50)), "L " + " ".join(f"u{i}" for i in range(30)) + " " + " ".join(f"i{i}" for i in range(100, 110)) + " H",
         " ".join(f"u{i}" for i in range(30)) + " " + " ".join(f"i{i}" for i in range(100, 110)) + " " + " ".join(f"s{i}" for i in range(30, 50))),
    ],
)
def test_golden(spark, keys, script, expected):
    assert emitted(spark, keys, script) == expected


def test_survivors_carry_the_high_position(spark):
    chunk, log = build(spark, [1, 2], "L u2 H")
    assert [(r.k, r.emit_pos) for r in reconcile.emitted(chunk, log, T).filter("origin = 'SELECT'").collect()] == [(1, 5)]


def control(seq, token="low", **other):
    row = {"session": 1, "seq": seq, "is_control": True, "op": "WATERMARK", "origin": "LOG", "table_ok": True, "key_ok": True, "has_after": True, "token": token, "token_type": "string", "low_token": "low", "high_token": "high", "run_id": None, "run_type": "string", "own_run": "mine"}
    return row | other


@pytest.mark.parametrize(
    ("rows", "code"),
    [
        ([control(1), control(2)], "DUPLICATE_LOW"),
        ([control(1), control(2, "high"), control(3, "high")], "DUPLICATE_HIGH"),
        ([control(1, "high")], "HIGH_BEFORE_LOW"),
        ([control(1, "x", run_id="r"), control(2, "high"), control(3, "low")], "HIGH_BEFORE_LOW"),
        ([control(1, "x")], "UNKNOWN_TOKEN"),
        ([control(1, origin="SELECT")], "WRONG_ORIGIN"),
        ([control(1, table_ok=False)], "WRONG_TABLE"),
        ([control(1, key_ok=False)], "WRONG_KEY"),
        ([control(1, has_after=False)], "NO_AFTER_ROW"),
        ([control(1, " ")], "BLANK_TOKEN"),
        ([control(1, op="UPDATE")], "NOT_A_WATERMARK"),
        ([control(1, None)], "BLANK_TOKEN"),
        ([control(1, "7", token_type="int")], "TOKEN_IS_NO_TEXT"),
        ([control(1, "x", run_id="7", run_type="int")], "RUN_IS_NO_TEXT"),
        ([control(1, "x", run_id=" ")], "UNKNOWN_TOKEN"),
        ([control(1, "x", run_id="r", own_run=None)], "UNKNOWN_TOKEN"),
        ([control(1), control(2, "bogus")], "UNKNOWN_TOKEN"),
    ],
)
def test_invalid_sequences(spark, rows, code):
    schema = "session long, seq long, is_control boolean, op string, origin string, table_ok boolean, key_ok boolean, has_after boolean, token string, token_type string, low_token string, high_token string, run_id string, run_type string, own_run string"
    found = reconcile.violations(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).orderBy("seq").collect()
    assert found[0].code == code


def test_valid_and_stale_sequences(spark):
    schema = "session long, seq long, is_control boolean, op string, origin string, table_ok boolean, key_ok boolean, has_after boolean, token string, token_type string, low_token string, high_token string, run_id string, run_type string, own_run string"
    rows = [control(1, "old", run_id="run-9"), control(2), control(3, "high")]
    assert reconcile.violations(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).count() == 0


def random_case(seed, n_keys=60, n_events=400, size=7):
    rng = random.Random(seed)
    log = [(2 * i, rng.choice([T, T, T, OTHER]), rng.randrange(n_keys + 5), (op := rng.choice(list(OPS.values()))), None if op == "DELETE" else round(rng.random(), 3)) for i in range(n_events)]
    chunks = -(-n_keys // size)
    chunk = []
    for k in range(n_keys):
        c = k // size
        chunk.append((k, 500.0 + k, k, c, 2 * (c * n_events // chunks) + 1, 2 * ((2 * c + 1) * n_events // (2 * chunks)) + 1))
    return chunk, log


def fold(chunk, log, anti_join=True):
    """The stream and the state by walking the log."""
    out, windows = [], {}
    for k, value, ordinal, c, lo, hi in chunk:
        windows.setdefault((c, lo, hi), {})[k] = (ordinal, value)
    points = sorted([(lo, 0, c) for c, lo, hi in windows] + [(hi, 2, c) for c, lo, hi in windows] + [(p, 1, e) for e, p in enumerate(r[0] for r in log)])
    rows_of = {c: rows for (c, _, _), rows in windows.items()}
    active = {}
    for pos, kind, what in points:
        if kind == 0:
            active[what] = dict(rows_of[what])
        elif kind == 2:
            out += [(pos, "SELECT", T, "UPDATE", k, v) for k, (_, v) in sorted(active.pop(what).items(), key=lambda x: x[1][0])]
        else:
            p, table, k, op, value = log[what]
            out.append((p, "LOG", table, op, k, value))
            if table == T and anti_join:
                for rows in active.values():
                    rows.pop(k, None)
    state = {}
    for _, _, table, op, k, value in out:
        state.pop((table, k), None)
        if op != "DELETE":
            state[(table, k)] = value
    return out, state


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    chunk, log = random_case(seed)
    expected, state = fold(chunk, log)
    assert state != fold(chunk, log, anti_join=False)[1]  # the case does test the anti-join
    c, l = spark.createDataFrame(chunk, CHUNK), spark.createDataFrame(log, LOG)
    stream = reconcile.emitted_stream(c, l, T)
    got = [(r.emit_pos, r.origin, r.table_name, r.op, r.k, r.value) for r in stream.orderBy("emit_seq").collect()]
    assert got == expected
    final = reconcile.current_state(reconcile.emitted(c, l, T), "emit_pos").collect()
    assert {(r.table_name, r.k): r.value for r in final} == state


def test_streaming_equals_batch(spark, tmp_path):
    chunk, log = random_case(3)
    source = str(tmp_path / "log")
    for i in range(0, len(log), 90):
        spark.createDataFrame(log[i : i + 90], LOG).coalesce(1).write.mode("append").parquet(source)
    folder = str(tmp_path / "out")
    c = spark.createDataFrame(chunk, CHUNK)
    files = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    job = ReconcileStream(c, T, folder)
    job.start(files).awaitTermination()
    got = sorted((r.emit_pos, r.origin, r.k, r.value) for r in job.emitted().collect())
    expected = sorted((r[0], r[1], r[4], r[5]) for r in fold(chunk, log)[0])
    assert sorted(map(str, got)) == sorted(map(str, expected))
    job.start(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)).awaitTermination()
    assert job.emitted().count() == len(expected)


def test_mirror_stream(spark, tmp_path):
    _, log = random_case(4)
    log = [r for r in log if r[1] == T]
    source = str(tmp_path / "log")
    for i in range(0, len(log), 100):
        spark.createDataFrame(log[i : i + 100], LOG).coalesce(1).write.mode("append").parquet(source)
    mirror = MirrorStream(spark, str(tmp_path / "out"))
    mirror.start(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)).awaitTermination()
    assert {r.k: r.value for r in mirror.version().collect()} == {k: v for (_, k), v in fold([], log)[1].items()}


def test_fan_out_needs_a_sink(spark):
    with pytest.raises(ValueError):
        fan_out(spark.range(1), [])
    seen = []
    fan_out(spark.range(3), [discard, lambda df: seen.append(df.count())])
    assert seen == [3]


def test_composite_keys(spark):
    key = "struct<account: string, region: string>"
    chunk = [((a, r), 1.0, i, 0, 1, 5) for i, (a, r) in enumerate([("a1", "EU"), ("a1", "US"), ("a2", "EU")])]
    c = spark.createDataFrame(chunk, f"k {key}, value double, ordinal long, chunk_id long, lo long, hi long")
    l = spark.createDataFrame([(2, T, ("a1", "US"), "UPDATE", 9.0)], f"pos long, table_name string, k {key}, op string, value double")
    stream = reconcile.emitted_stream(c, l, T).orderBy("emit_seq").collect()
    assert [(r.origin, tuple(r.k)) for r in stream] == [("LOG", ("a1", "US")), ("SELECT", ("a1", "EU")), ("SELECT", ("a2", "EU"))]
    state = reconcile.current_state(reconcile.emitted(c, l, T), "emit_pos").collect()
    assert {tuple(r.k): r.value for r in state} == {("a1", "US"): 9.0, ("a1", "EU"): 1.0, ("a2", "EU"): 1.0}
