"""Hot keys and large transactions: results as by hand, and no task that gathers one of them."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import apply, folds, reconcile

LOG = "pos long, table_name string, k long, op string, value double"
CHUNK = "k long, value double, ordinal long, chunk_id long, lo long, hi long, note string"


def test_windows_of_all_lengths_and_a_key_with_half_the_log(spark):
    rng = random.Random(1)
    log = [(p, "t" if rng.random() < 0.9 else "u", 5 if rng.random() < 0.5 else rng.choice([None, *range(60)]), "UPDATE", 1.0) for p in range(-500, 4000) if rng.random() < 0.7]
    chunk = []
    for i in range(600):
        lo = rng.randrange(-600, 4000)
        chunk.append((rng.choice([None, 5, *range(60)]), 1.0, i, i // 50, lo, lo + rng.choice([0, 1, 2, 3, 4, 7, 8, 9, 64, 1000, 4600]), "x"))
    chunk += chunk[:5]
    got = reconcile.survivors(spark.createDataFrame(chunk, CHUNK), spark.createDataFrame(log, LOG), "t")
    assert got.columns == [c.split()[0] for c in CHUNK.split(", ")]
    by_key = {}
    for p, t, k, *_ in log:
        if t == "t" and k is not None:
            by_key.setdefault(k, []).append(p)
    want = [c for c in chunk if not any(c[4] < p < c[5] for p in by_key.get(c[0], []))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_hot_key_is_reduced_before_its_shuffle(spark):
    """Half a million events of one key are a few bins' first and last positions on each side of the join."""
    events = spark.range(0, 1_000_000, 2, 8).select(F.col("id").alias("pos"), F.lit("t").alias("table_name"), F.lit(7).cast("long").alias("k"), F.lit("UPDATE").alias("op"), F.lit(1.0).alias("value"))
    chunk = spark.createDataFrame([(7, 1.0, i, i, 1 + 10_000 * i, 8001 + 10_000 * i, "") for i in range(100)] + [(8, 1.0, 100, 0, 1, 8001, "")], CHUNK)
    left = reconcile.survivors(chunk, events, "t")
    assert [r.k for r in left.collect()] == [8]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "_first" in plan
    assert "partial_min(pos" in plan  # reduced in the task that reads it


def test_a_transaction_of_a_million_rows(spark):
    log = spark.range(0, 1_000_000, 1, 8).select(F.col("id").alias("pos"), F.when(F.col("id") % 100_000 == 5, F.col("id")).otherwise(-1).alias("tx"), F.when(F.col("id") % 3 == 0, "INSERT").otherwise("DELETE").alias("op"))
    segments = apply.transaction_segments(log)
    sizes = segments.agg(F.max("n_events"), F.count("*")).first()
    assert sizes[0] <= apply.SEGMENT
    assert sizes[1] == 10 + 16
    big = apply.transactions(segments).filter("tx = -1").first()
    assert (big.commit_pos, big.n_events) == (999_999, 999_990)
    assert big.ops.split(",")[:7] == ["INSERT", "DELETE", "DELETE", "INSERT", "DELETE", "INSERT", "DELETE"]
    assert big.ops.count("INSERT") == sum(p % 3 == 0 for p in range(1_000_000) if p % 100_000 != 5)
    numbers = apply.numbered_in_transactions(log).filter("tx = -1").agg(F.min("tx_seq"), F.max("tx_seq"), F.count_distinct("tx_seq")).first()
    assert tuple(numbers) == (1, 999_990, 999_990)


def plain_flush(times, most, age):
    out, count, first = [], 0, None
    for t in times:
        first = t if not count else first
        count += 1
        out.append(count == most or t - first >= age)
        count = 0 if out[-1] else count
    return out


def plain_beats(times, interval):
    out, last = [], None
    for t in times:
        out.append(last is None or t < last or t - last >= interval)
        last = t if out[-1] else last
    return out


@pytest.mark.parametrize("steps", [[0, 1, 2, 40], [-30, -1, 0, 1, 2, 40], [1]])
def test_folds_of_one_stream_in_many_tasks(spark, steps, request):
    """A stream with most of the events, and small ones beside it: parts are folded by themselves and put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with parts of a size worth a task
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rng, rows, t = random.Random(len(steps)), [], 0
    for i in range(6000):
        t += rng.choice(steps)
        rows.append(("big" if i % 10 else f"s{i % 70}", i, t))
    df = spark.createDataFrame(rows, "s string, seq long, t long").withColumn("ts", F.timestamp_micros(1_700_000_000_000_000 + F.col("t") * 1_000_000)).repartition(3)
    flushed = folds.flush_points(df, "s", "seq", "ts", 100, pd.Timedelta("300s"))
    beats = folds.due_beats(df, "s", "seq", "ts", pd.Timedelta("75s"))
    assert flushed.filter("s = 'big'").select(F.spark_partition_id()).distinct().count() > 1
    by_stream = {}
    for s, seq, t in rows:
        by_stream.setdefault(s, []).append((seq, t))
    for found, name, plain in ((flushed, "flush", lambda x: plain_flush(x, 100, 300)), (beats, "due", lambda x: plain_beats(x, 75))):
        got = {(r.s, r.seq): r[name] for r in found.collect()}
        want = {(s, seq): hit for s, own in by_stream.items() for (seq, _), hit in zip(own, plain([t for _, t in own]), strict=True)}
        assert got == want


def test_parts_of_a_fold_are_as_the_whole():
    rng = random.Random(1)
    for _ in range(400):
        times, t = [], 0
        for _ in range(rng.randint(2, 120)):
            t += rng.choice([-7, -1, 0, 1, 2, 5] if rng.random() < 0.5 else [0, 1, 30])
            times.append(t)
        cuts = [0, *sorted(rng.sample(range(1, len(times)), rng.randint(0, min(4, len(times) - 1)))), len(times)]
        for fold, plain in ((folds.Flush(m := rng.choice([1, 2, 5, 9]), a := rng.choice([1, 4, 1000])), plain_flush(times, m, a)), (folds.Beat(d := rng.choice([1, 4, 1000])), plain_beats(times, d))):
            state, places = folds.EMPTY, []
            for lo, hi in itertools.pairwise(cuts):
                part = np.array(times[lo:hi], np.int64)
                after, own = fold.walk(state, part)
                assert fold.through(state, fold.summary(part)) == after
                state, places = after, places + [lo + p for p in own]
            assert places == [i for i, hit in enumerate(plain) if hit]


def test_rows_without_a_stream_are_one_stream(spark):
    rows = [(None if i % 3 else i % 2, i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "s long, seq long, t long").withColumn("ts", F.timestamp_micros(F.col("t") * 1_000_000))
    got = {r.seq: r.due for r in folds.due_beats(df, "s", "seq", "ts", pd.Timedelta("10s")).collect()}
    for stream in (None, 0, 1):
        own = [i for s, i, _ in rows if s == stream]
        assert [got[i] for i in own] == plain_beats(own, 10)
    assert folds.flush_points(df.limit(0), "s", "seq", "ts", 3, pd.Timedelta("1s")).count() == 0
