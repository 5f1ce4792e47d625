"""The reconciler on streaming state against the batch form, whole and killed on the way."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.streaming import stateful

LOG = "pos long, table_name string, k long, op string, value double"
CHUNK = "k long, value double, ordinal long, chunk_id long, lo long, hi long"


def fixture(spark, seed, events=300, keys=25, size=5):
    """A log in which one key has a third of all events, and windows over it, some of them empty, some side by side."""
    rng = random.Random(seed)
    log = []
    for i in range(events):
        k = 3 if rng.random() < 0.33 else rng.randrange(keys)
        op = rng.choice(["INSERT", "UPDATE", "DELETE"])
        log.append((2 * i + 2, "t" if rng.random() < 0.8 else "u", k, op, None if op == "DELETE" else float(rng.randrange(9))))
    rows = []
    for c in range(-(-keys // size)):
        lo = 2 * rng.randrange(events - 1) + 1
        hi = lo + 2 * rng.choice([0, 1, 5, 40])
        rows += [(k, None if k % 7 == 0 else k / 2, k, c, lo, hi) for k in range(c * size, min(keys, (c + 1) * size))]
    return spark.createDataFrame(log, LOG), spark.createDataFrame(rows, CHUNK)


def files(spark, log, chunk, folder, seed, n=6):
    """Records in the order of positions, cut into files at random."""
    recorded = F.greatest(F.col("lo"), F.col("lo") + 1 + F.pmod(F.xxhash64("k", F.lit(seed)), F.greatest(F.col("hi") - F.col("lo") - 1, F.lit(1))))
    rows = stateful.log_records(log).unionByName(stateful.dump_records(chunk, "t", F.least(recorded, F.col("hi") - 1))).orderBy("pos").toPandas()
    top = int(rows["pos"].max())
    cuts = sorted(random.Random(seed).sample(range(2, top), n - 1))
    for i, (a, b) in enumerate(zip([-1, *cuts], [*cuts, top], strict=True)):
        part = rows[(rows["pos"] > a) & (rows["pos"] <= b)].astype(object)
        data = [tuple(None if x != x else x for x in r) for r in part.itertuples(index=False)]
        types = [int, str, str, int, str, float, int, int, int, int]
        data = [tuple(None if x is None else t(x) for t, x in zip(types, r, strict=True)) for r in data]
        spark.createDataFrame(data, stateful.RECORD).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def run(spark, source, out, upto=None, fail_at=None):
    """The stream over the first ``upto`` files, to the end of what there is."""
    read = spark.readStream.schema(stateful.RECORD).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)

    def broken(batches):
        for b in batches:
            if fail_at is not None and (b["emit_pos"] >= fail_at).any():
                raise RuntimeError("planned")
            yield b

    emitted = stateful.reconcile(read, span=100).mapInPandas(broken, stateful.EMITTED)
    query = emitted.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def same(spark, out, log, chunk):
    want = reconcile.emitted(chunk, log, "t").selectExpr("emit_pos", "origin", "table_name", "op", "k", "value", "origin_rank", "ordinal")
    got = spark.read.schema(stateful.EMITTED).parquet(f"{out}/rows").select(*want.columns)
    assert got.exceptAll(want).collect() == []
    assert want.exceptAll(got).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch_form(spark, tmp_path, seed):
    log, chunk = fixture(spark, seed)
    files(spark, log, chunk, tmp_path / "in", seed)
    run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    same(spark, tmp_path / "out", log, chunk)
    assert reconcile.survivors(chunk, log, "t").count() < chunk.count()  # events did take rows away


def test_killed_and_started_again(spark, tmp_path):
    log, chunk = fixture(spark, 3)
    files(spark, log, chunk, tmp_path / "in", 3)
    for at in (90, 400):
        with pytest.raises(Exception, match="planned"):
            run(spark, str(tmp_path / "in"), str(tmp_path / "out"), fail_at=at)
    run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    same(spark, tmp_path / "out", log, chunk)


def test_a_window_longer_than_the_span_is_an_error(spark, tmp_path):
    chunk = spark.createDataFrame([(1, 1.0, 0, 0, 1, 301)], CHUNK)
    files(spark, spark.createDataFrame([(2, "t", 1, "UPDATE", 1.0)], LOG), chunk, tmp_path / "in", 1, n=2)
    with pytest.raises(Exception, match="span"):
        run(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_state_is_by_bucket_and_keeps_values_as_they_are(spark, tmp_path):
    """Thousands of keys are a few states, so Python and the store are called once for a bucket; NaN isn't null, large
    ordinals stay whole, rows that repeat a key all come, and keys that are null touch no others."""
    big = (1 << 53) + 1
    log = spark.createDataFrame([(2 * i + 2, "t", i % 3000, "UPDATE", float("nan") if i % 5 else None) for i in range(6000)] + [(20_001, "t", None, "DELETE", None)], LOG)
    rows = [(k, float("nan") if k % 2 else None, big + k, k // 1000, lo, lo + 1001) for k in range(3000) for lo in [2000 * (k // 1000) + 1]]
    chunk = spark.createDataFrame([*rows, (7, 1.5, big + 5000, 0, 1, 3), (7, 1.5, big + 5001, 0, 1, 3), (None, 2.5, big + 5002, 9, 20_000, 20_003)], CHUNK)
    (stateful.log_records(log).unionByName(stateful.dump_records(chunk, "t"))).repartitionByRange("pos").write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(stateful.RECORD).parquet(str(tmp_path / "in"))
    query = stateful.reconcile(read, span=1001, buckets=8).writeStream.format("parquet").option("path", f"{tmp_path}/out/rows").option("checkpointLocation", f"{tmp_path}/out/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) <= 8
    same(spark, tmp_path / "out", log, chunk)
