"""Structured Streaming forms of reconciliation and apply. Each micro-batch writes under its own number, so a batch
that runs again overwrites what it wrote: sinks see every event at least once and the files hold it once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import apply, reconcile


def _epochs(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches under a folder, by Hadoop's file system, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch="))


def _before(spark: SparkSession, folder: str, epoch: int) -> DataFrame | None:
    """What the last batch before this one wrote."""
    found = [e for e in _epochs(spark, folder) if e < epoch]
    return spark.read.parquet(f"{folder}/epoch={found[-1]}") if found else None


class ReconcileStream:
    """The reconciler over a streamed log, in log order from batch to batch.

    chunk: k, value, ordinal, chunk_id, lo, hi. A batch writes its events and the rows of windows that closed in it.
    Keys that an open window has seen change are carried from batch to batch under ``touched`` until it closes, so a
    batch reads what the one before it left and the chunks of windows that are open or close in it.
    """

    def __init__(self, chunk: DataFrame, table: str, folder: str):
        self.chunk, self.table, self.folder = chunk, table, folder

    def start(self, log: DataFrame) -> StreamingQuery:
        writer = log.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(availableNow=True).start()

    def _batch(self, log: DataFrame, epoch: int) -> None:
        spark = log.sparkSession
        log = log.persist()
        try:
            top = log.agg(F.max("pos")).first()[0]
            if top is None:
                return
            seen = _before(spark, f"{self.folder}/progress", epoch)
            last = seen.agg(F.max("top")).first()[0] if seen is not None else -1
            own = log.filter(F.col("table_name") == self.table)
            chunk = self.chunk.filter((F.col("hi") > last) & (F.col("lo") < top))
            inside = (own["k"] == chunk["k"]) & (own["pos"] > chunk["lo"]) & (own["pos"] < chunk["hi"])
            touched = own.join(chunk, inside).select(chunk["chunk_id"], chunk["k"], chunk["hi"])
            carried = _before(spark, f"{self.folder}/touched", epoch)
            touched = (touched if carried is None else touched.unionByName(carried)).distinct().persist()
            touched.filter(F.col("hi") > top).write.mode("overwrite").parquet(f"{self.folder}/touched/epoch={epoch}")
            closing = chunk.filter(F.col("hi") <= top)
            left = closing.join(touched.select("chunk_id", "k"), ["chunk_id", "k"], "left_anti")
            none = own.filter(F.lit(False))
            live = reconcile.emitted(closing.filter(F.lit(False)), log, self.table)
            rows = reconcile.emitted(left, none, self.table)
            live.unionByName(rows).write.mode("overwrite").parquet(f"{self.folder}/emitted/epoch={epoch}")
            touched.unpersist()
            spark.createDataFrame([(top,)], "top long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/progress/epoch={epoch}")
        finally:
            log.unpersist()

    def emitted(self) -> DataFrame:
        spark = self.chunk.sparkSession
        return spark.read.parquet(*[f"{self.folder}/emitted/epoch={e}" for e in _epochs(spark, f"{self.folder}/emitted")])


class MirrorStream:
    """A mirror table kept by last write wins, in buckets by hash of the key.

    A batch is collapsed by key, and only the buckets that its keys are in get a new version; a list of them says which
    version of a bucket is the newest. So the work of a batch goes with its keys, up to the number of buckets.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def start(self, stream: DataFrame, key: str = "k", order: str = "pos") -> StreamingQuery:
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

        def batch(df: DataFrame, epoch: int) -> None:
            df = apply.without_controls(df).persist()
            try:
                touched = sorted(r.bucket for r in df.select(bucket).distinct().collect())  # no more than there are buckets
                base = self.version(epoch - 1, touched)
                base = base if base is not None else df.sparkSession.createDataFrame([], f"{key} long, value double")
                rows = apply.mirror(base, df, key, order).select("*", bucket)
                rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/mirror/epoch={epoch}")
                df.sparkSession.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/touched/epoch={epoch}")
            finally:
                df.unpersist()

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def version(self, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest complete version, or the newest up to a number, of all buckets or of some."""
        found = [e for e in _epochs(self.spark, f"{self.folder}/touched") if upto is None or e <= upto]
        if not found:
            return None
        paths = [f"{self.folder}/touched/epoch={e}" for e in found]
        lists = self.spark.read.option("basePath", f"{self.folder}/touched").parquet(*paths)
        newest = lists.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
        newest = newest if buckets is None else newest.filter(F.col("bucket").isin(buckets))
        by_epoch = {r.epoch: r.buckets for r in newest.groupBy("epoch").agg(F.collect_list("bucket").alias("buckets")).collect()}
        jvm, out = self.spark._jvm, []
        for epoch, own in by_epoch.items():
            for b in own:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/mirror/epoch={epoch}/bucket={b}")
                if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):  # a bucket may be empty
                    out.append(path.toString())
        return self.spark.read.parquet(*out) if out else None


def fan_out(df: DataFrame, sinks: list) -> None:
    """One batch to several sinks in order; a failure stops the rest and is raised."""
    if not sinks:
        raise ValueError("no sink is configured; configure a no-op one to discard on purpose")
    df.persist()
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("append").save()
