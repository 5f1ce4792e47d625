"""The log as a source with offsets, and the sink of lines with commits, killed and started again."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.sources import log_source
from tidemark.streaming import sinks


def write_log(spark, folder, lo, hi, name):
    rows = spark.range(lo, hi).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("k"), F.lit("UPDATE").alias("op"))
    rows.coalesce(1).sortWithinPartitions("pos").write.option("parquet.block.size", 4096).parquet(f"{folder}/{name}")


def lines(df):
    return df.select(F.to_json(F.struct("pos", "k")).alias("line"))


def test_plan_prunes_row_groups():
    groups = [log_source.Group("a", 0, 10, 0, 9), log_source.Group("a", 1, 10, 10, 19), log_source.Group("b", 0, 10, 20, 29), log_source.Group("b", 1, 5, 0, -1)]
    parts = log_source.plan(groups, 9, 24, 100)
    assert [(p.file, p.groups) for p in parts] == [("a", (1,)), ("b", (0,))]
    assert [(p.file, p.groups) for p in log_source.plan(groups, -1, 99, 10)] == [("a", (0,)), ("a", (1,)), ("b", (0,))]
    assert log_source.plan(groups, 29, 99, 10) == []


def test_batch_from_a_position(spark, tmp_path):
    for i in range(4):
        write_log(spark, tmp_path, 100 * i, 100 * (i + 1), f"f{i}")
    log = log_source.read_log(spark, str(tmp_path), start=149, rowsPerPartition=60)
    assert sorted(r.pos for r in log.collect()) == list(range(150, 400))
    narrow = log.filter("pos > 250 AND pos <= 260 AND k = 1")
    assert sorted(r.pos for r in narrow.collect()) == [p for p in range(251, 261) if p % 7 == 1]
    assert narrow.rdd.getNumPartitions() == 1  # one file's groups can hold such positions
    assert log_source.read_log(spark, str(tmp_path), start=399).count() == 0
    with pytest.raises(Exception, match="FileNotFound|no Parquet"):
        log_source.read_log(spark, str(tmp_path / "f0" / "_nothing"))


def test_stream_goes_on_behind_its_offset(spark, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "out")

    def run(fail=False):
        rows = log_source.stream_log(spark, source, start=20)
        if fail:
            rows = rows.withColumn("k", F.when(F.col("pos") == 150, F.raise_error(F.lit("planned"))).otherwise(F.col("k")))
        query = sinks.stream_lines(lines(rows), out, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return query

    write_log(spark, source, 0, 100, "a")
    first = run()
    assert re.findall(r"\d+", str(first.lastProgress.sources[0].endOffset)) == ["99"]
    write_log(spark, source, 100, 200, "b")
    with pytest.raises(Exception, match="planned"):
        run(fail=True)
    assert sinks.read_lines(spark, out).count() == 79  # what the failed batch wrote doesn't count
    run()
    write_log(spark, source, 200, 250, "c")
    run()
    run()
    got = sorted(json.loads(r.line)["pos"] for r in sinks.read_lines(spark, out).collect())
    assert got == list(range(21, 250))


def test_a_batch_that_runs_twice_leaves_one_copy(spark, tmp_path):
    rows = lines(spark.range(50).select(F.col("id").alias("pos"), F.col("id").alias("k")).repartition(3))
    assert sinks.read_lines(spark, str(tmp_path)).count() == 0
    for batch in ("0", "0", "1", "0"):
        sinks.write_lines(rows, str(tmp_path), batch)
    assert sinks.read_lines(spark, str(tmp_path)).count() == 100
    assert len(list((tmp_path / "parts").iterdir())) == sum(len(parts) for _, parts in sinks.commits(str(tmp_path)))
    sinks.write_lines(rows.limit(0), str(tmp_path), "2")
    assert [b for b, _ in sinks.commits(str(tmp_path))] == ["0", "1", "2"]
    with pytest.raises(Exception, match="line end"):
        sinks.write_lines(spark.createDataFrame([("a\nb",)], "line string"), str(tmp_path), "3")
    with pytest.raises(Exception, match="name"):
        rows.write.format(sinks.FORMAT).mode("append").save(str(tmp_path))


def test_fan_out_after_a_failure_in_the_second_sink(spark, tmp_path):
    source, one, two = str(tmp_path / "log"), str(tmp_path / "one"), tmp_path / "two"
    write_log(spark, source, 0, 40, "a")
    two.write_text("in the way")  # the second sink can't write
    run = lambda: sinks.stream_to_all(lines(log_source.stream_log(spark, source)), [one, str(two)], str(tmp_path / "checkpoint")).awaitTermination()
    with pytest.raises(Exception):  # noqa: B017
        run()
    two.unlink()
    run()
    for sink in (one, str(two)):
        assert sinks.read_lines(spark, sink).count() == 40
    with pytest.raises(ValueError, match="no sink"):
        sinks.stream_to_all(spark.range(1), [], "x")
