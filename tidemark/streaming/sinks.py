"""A sink of lines with a commit, ``tidemark_lines``: every batch counts once, however often it is written.

Each task writes a file of its own, and the batch counts when one small file with the list of its parts is put in place
under the batch's number. A batch that runs again finds that file and throws its own parts away; a batch that failed has
none, and its parts are never read. Streams number their batches, batch writers name theirs by the option ``batch``.

Readers see what is committed. The parts' files hold one line for each row; with ``line`` made by ``apply.ndjson`` they
are NDJSON files as they stand.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.runtime import ship
from tidemark.sources.log_source import file_system

FORMAT = "tidemark_lines"
SCHEMA = "line string"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its file, empty for none, and the number of lines."""

    file: str
    lines: int


class _Lines:
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        """A task's lines to a new file; a failed task leaves a file that no commit names."""
        fs, root = file_system(self.path)
        name, count, stream = f"part-{uuid.uuid4().hex}.ndjson", 0, None
        try:
            for row in rows:
                if stream is None:
                    fs.create_dir(f"{root}/parts", recursive=True)
                    stream = fs.open_output_stream(f"{root}/parts/{name}", buffer_size=1 << 20)
                if "\n" in row["line"] or "\r" in row["line"]:
                    raise ValueError("a line holds no line end")
                stream.write(row["line"].encode() + b"\n")
                count += 1
        finally:
            if stream is not None:
                stream.close()
        return Written(name if count else "", count)

    def commit(self, messages: list[Written | None], batch: str) -> None:
        fs, root = file_system(self.path)
        parts = [m for m in messages if m is not None and m.file]
        fs.create_dir(f"{root}/commits", recursive=True)
        place = f"{root}/commits/{batch}.json"
        if fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            self.abort(messages)
            return
        draft = f"{root}/commits/.{batch}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"parts": [[m.file, m.lines] for m in parts]}).encode())
        fs.move(draft, place)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/parts/{m.file}")


class LinesWriter(_Lines, DataSourceWriter):
    def __init__(self, path: str, batch: str):
        super().__init__(path)
        self.batch = batch

    def commit(self, messages) -> None:
        super().commit(messages, self.batch)


class LinesStreamWriter(_Lines, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        super().commit(messages, str(batchId))

    def abort(self, messages, batchId: int) -> None:
        super().abort(messages)


@dataclass
class Committed(InputPartition):
    file: str


class LinesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Committed(name) for _, parts in commits(self.path) for name, _ in parts]

    def read(self, partition: Committed | None):
        if partition is not None:
            fs, root = file_system(self.path)
            with fs.open_input_stream(f"{root}/parts/{partition.file}") as f:
                rest = b""
                while chunk := f.read(4 << 20):
                    *lines, rest = (rest + chunk).split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in lines], pa.string())], names=["line"])


def commits(path: str) -> list[tuple[str, list]]:
    """The batches that count, and their parts."""
    fs, root = file_system(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with fs.open_input_stream(info.path) as f:
                out.append((info.base_name.removesuffix(".json"), json.loads(f.read())["parts"]))
    return out


class LinesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if overwrite or not self.options.get("batch"):
            raise ValueError("lines are appended, and a batch has a name")
        return LinesWriter(self.options["path"], self.options["batch"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> LinesStreamWriter:
        return LinesStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LinesDataSource)


def write_lines(rows: DataFrame, path: str, batch: str) -> None:
    """rows (line) as one batch with a name; again under the same name they change nothing."""
    register(rows.sparkSession)
    rows.select("line").write.format(FORMAT).mode("append").option("batch", batch).save(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).load(path)


def stream_lines(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of rows (line) to the sink, up to what there is; its checkpoint and the commits make each batch count once."""
    register(rows.sparkSession)
    writer = rows.select("line").writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_to_all(rows: DataFrame, paths: list[str], checkpoint: str) -> StreamingQuery:
    """A stream of rows (line) to several sinks, in order. A failure in one stops the batch; when it runs again, the
    sinks that had it already keep one copy."""
    if not paths:
        raise ValueError("no sink is configured; configure a no-op one to discard on purpose")

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for path in paths:
                write_lines(df, path, str(number))
        finally:
            df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
