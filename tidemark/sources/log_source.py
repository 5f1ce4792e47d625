"""A change log in Parquet files as a Spark data source, ``tidemark_log``, for batch and for streams.

An offset is a position: a stream that starts again goes on behind the position in its own checkpoint, and nothing else
is kept. What lies between two offsets is planned by the files' statistics: row groups whose range of positions misses it
aren't read, and the others are dealt to partitions of about ``rowsPerPartition`` rows.

Options: path (a folder or file that pyarrow's file systems reach), position (the column, by default ``pos``), start
(positions up to it are left out), rowsPerPartition. Rows without a position can't be told from others and are never
read. A log only grows at its end: a file that comes later with positions below the offset isn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tidemark.runtime import ship

FORMAT = "tidemark_log"
NO_POSITION = -(1 << 63)


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (pyarrow.fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Group:
    """A row group and the range of its positions; lowest above highest if it has none."""

    file: str
    number: int
    rows: int
    lowest: int
    highest: int


def catalog(path: str, position: str) -> tuple[pa.Schema, list[Group]]:
    """The schema, and all row groups by footers alone. Without statistics a group counts as having any position."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/")))
    schema, groups = None, []
    for name in files:
        with fs.open_input_file(name) as f:
            meta = pq.ParquetFile(f)
            schema = schema or meta.schema_arrow
            column = meta.schema_arrow.names.index(position)
            for g in range(meta.num_row_groups):
                part = meta.metadata.row_group(g)
                stats = part.column(column).statistics
                if stats is None or not stats.has_min_max:
                    empty = stats is not None and stats.null_count == part.num_rows
                    low, high = (0, -1) if empty else (NO_POSITION, -NO_POSITION - 1)
                else:
                    low, high = stats.min, stats.max
                groups.append(Group(name, g, part.num_rows, low, high))
    if schema is None:
        raise FileNotFoundError(f"no Parquet file in {path}")
    return schema, groups


@dataclass
class Part(InputPartition):
    """Row groups of one file, and the positions that are wanted of them: after, up to."""

    file: str
    groups: tuple[int, ...]
    after: int
    upto: int


def plan(groups: list[Group], after: int, upto: int, rows: int) -> list[Part]:
    """Partitions of what lies behind ``after`` and not behind ``upto``."""
    out: list[Part] = []
    size = 0
    for g in groups:
        if g.lowest > g.highest or g.highest <= after or g.lowest > upto:
            continue
        if out and out[-1].file == g.file and size + g.rows <= rows:
            out[-1].groups += (g.number,)
            size += g.rows
        else:
            out.append(Part(g.file, (g.number,), after, upto))
            size = g.rows
    return out


def read_part(path: str, position: str, part: Part | None) -> Iterator[pa.RecordBatch]:
    """part: None where nothing is planned."""
    if part is None:
        return
    fs, _ = file_system(path)
    with fs.open_input_file(part.file) as f:
        for batch in pq.ParquetFile(f).iter_batches(row_groups=list(part.groups)):
            at = batch.column(position)
            yield batch.filter(pc.and_(pc.greater(at, part.after), pc.less_equal(at, part.upto)))


class _Options:
    def __init__(self, options: dict):
        self.path, self.position = options["path"], options.get("position", "pos")
        self.start, self.rows = int(options.get("start", NO_POSITION)), int(options.get("rowsPerPartition", 1_000_000))


class LogReader(DataSourceReader):
    """Comparisons of the position narrow what is planned; Spark still applies all filters itself."""

    def __init__(self, options: _Options):
        self.options, self.after, self.upto = options, options.start, -NO_POSITION - 1

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and f.attribute == (self.options.position,):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.after = max(self.after, f.value - (not isinstance(f, GreaterThan)))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.upto = min(self.upto, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self):
        return plan(catalog(self.options.path, self.options.position)[1], self.after, self.upto, self.options.rows)

    def read(self, partition: Part | None):
        return read_part(self.options.path, self.options.position, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"position": self.options.start}

    def latestOffset(self) -> dict:
        tops = [g.highest for g in catalog(self.options.path, self.options.position)[1] if g.lowest <= g.highest]
        return {"position": max([self.options.start, *tops])}

    def partitions(self, start: dict, end: dict):
        return plan(catalog(self.options.path, self.options.position)[1], start["position"], end["position"], self.options.rows)

    def read(self, partition: Part | None):
        return read_part(self.options.path, self.options.position, partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: the log stays, and the offset is in Spark's checkpoint."""


class LogDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return from_arrow_schema(catalog(self.options["path"], self.options.get("position", "pos"))[0])

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(_Options(self.options))

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogDataSource)


def read_log(spark: SparkSession, path: str, position: str = "pos", start: int | None = None, **options) -> DataFrame:
    """The log behind a position, as a batch."""
    register(spark)
    options |= {"position": position} | ({} if start is None else {"start": start})
    return spark.read.format(FORMAT).options(**options).load(path)


def stream_log(spark: SparkSession, path: str, position: str = "pos", start: int | None = None, **options) -> DataFrame:
    """The log from a position on, as a stream."""
    register(spark)
    options |= {"position": position} | ({} if start is None else {"start": start})
    return spark.readStream.format(FORMAT).options(**options).load(path)
