"""Getting this package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each Spark application, as Spark's own Python file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    archive = shutil.make_archive(os.path.join(folder, "tidemark_package"), "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(os.path.abspath(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session may name none and gets a temporary one; a cluster may not.

    A folder on one machine would leave the executors' parts on their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its lineage ends, and lost executors take nothing along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_scratch: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read from there.

    Unlike ``checkpoint`` the rows are computed once, not twice, and the size that Spark plans with is that of the
    files: estimates of a checkpoint are those of its plan and grow with each join of a loop. Order and partitions
    are not kept.
    """
    spark = df.sparkSession
    folder = _scratch[-1] if _scratch else f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's intermediate files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``saved`` writes inside is deleted at the end, so no frame that reads it may be used after that."""
    _scratch.append(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove(spark, _scratch.pop())
