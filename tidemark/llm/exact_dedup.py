"""Exact deduplication over a log-structured merge index of text digests, in DataFrame functions alone.

Texts are equal when identical after lower-casing A-Z. The index takes memtables (slices of the input by hash of
doc_id) one after another and flushes each as a run sorted by digest, with a Bloom filter for each Parquet file. Runs
are levels; a level merges with the one before it while that is no more than twice as large, so there are
logarithmically many, and a digest has one row in a level: its smallest and largest doc_id and how many rows it has.
``lookup`` asks the levels for a few digests, where the filters spare most files. ``rows`` merges what levels are left.

Hits (count over 1) are verified on bytes: the smallest and the largest text of a digest must be the same bytes. A
bitmap filter of the hits, of at most ``FILTER_BITS``, goes to all tasks first, so a text that nobody shares is not
shuffled. Texts that differ under one digest are told apart by adding the text to the key.

Cases: null text counts as empty; a null doc_id sorts below all others; rows that repeat a doc_id and text are one
group: ``classes`` marks all of them as kept if that doc_id stays, ``dedup`` keeps one; an empty table gives an empty
result; other columns are left alone by ``dedup`` and never read by ``classes``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import saved, shared_dir

from .base import UPPER, broadcast_if_small, join_counted, salt_hot, text_or_empty

RUN_SCHEMA = "digest string, least long, most long, n long"
FILTER_BITS = 1 << 29


def normalised(column: str = "text") -> Column:
    """A-Z lowered and nothing else; ``lower`` does just that where all characters are ASCII."""
    text = text_or_empty(column)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


class DigestIndex:
    """Levels of (digest, least, most, n) in a shared folder, each sorted by digest, the newest and smallest last."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.levels: list[tuple[str, int]] = []
        self.folder = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/digest-index-{uuid.uuid4().hex}"

    def flush(self, docs: DataFrame) -> None:
        """A memtable becomes a run, which is merged with older levels of about its size. docs: doc_id, digest."""
        self._write(docs.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")))
        while len(self.levels) > 1 and self.levels[-2][1] <= 2 * self.levels[-1][1]:
            merged = self._merged(self.levels[-2:])
            del self.levels[-2:]
            self._write(merged)

    def rows(self) -> DataFrame:
        """One row for each digest, whatever levels it is in."""
        return self._merged(self.levels)

    def lookup(self, digests: list[str]) -> DataFrame:
        """The rows of a few digests; the values reach the scans, so files without them are told by their filters."""
        return self._read(self.levels).filter(F.col("digest").isin(digests)).groupBy("digest").agg(*self._sums())

    @staticmethod
    def _sums() -> list[Column]:
        return [F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")]

    def _read(self, levels: list[tuple[str, int]]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[path for path, _ in levels])

    def _merged(self, levels: list[tuple[str, int]]) -> DataFrame:
        rows = self._read(levels)
        return rows if len(levels) == 1 else rows.groupBy("digest").agg(*self._sums())

    def _write(self, rows: DataFrame) -> None:
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        writer = rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(path)
        self.levels.append((path, self.spark.read.schema(RUN_SCHEMA).parquet(path).count()))  # from the footers


def _bit(filter_bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(filter_bits))


def bitmap_filter(digests: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(bucket, bits) of a filter with eight bits a digest, of at most ``FILTER_BITS``, and its size."""
    size = min(FILTER_BITS, 1 << max(15, (8 * max(1, count) - 1).bit_length()))
    at = _bit(size)
    return digests.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), size


def maybe_in(rows: DataFrame, found: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose digest may be in the filter, and all whose digest is."""
    bits, size = found
    at = F.bitmap_bit_position(_bit(size))
    octet = F.conv(F.hex(F.substr("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(bits), F.bitmap_bucket_number(_bit(size)) == F.col("bucket"))
    return held.filter(F.floor(octet / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*rows.columns)


def _false_hits(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Digests whose texts aren't all the same bytes (none, short of a SHA-256 collision)."""
    texts = docs.select("doc_id", normalised().alias("norm")).withColumn("digest", F.sha2("norm", 256))
    hits = index.filter("n > 1").select("digest", "n")
    texts = maybe_in(texts, bitmap_filter(hits, hits.count()))
    texts, hits = salt_hot(texts, hits, "digest", "n", ["doc_id"])
    # shuffled at every size: a broadcast that only small inputs get would say nothing of large ones
    texts = texts.join(hits.select("digest", "_salt").hint("shuffle_hash"), ["digest", "_salt"], "left_semi")
    parts = texts.groupBy("digest", "_salt").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    return parts.groupBy("digest").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select("digest")


def classes(docs: DataFrame, keep: str = "most", memtables: int = 4) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: ``most`` or ``least``, the doc_id that stays.
    """
    digests = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(), 256).alias("digest")))
    index = DigestIndex(docs.sparkSession)
    for k in range(memtables):
        index.flush(digests.filter(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)) == k))
    rows = saved(index.rows()) if len(index.levels) > 1 else index.rows()
    collisions = _false_hits(docs, rows)
    if collisions.isEmpty():
        grouped = join_counted(digests, rows, "digest", "n")
    else:  # exact whatever the digest does: the text itself joins the key
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"), F.sha2(normalised(), 256).alias("digest"))
        exact = keyed.groupBy("digest", "norm").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
        grouped = keyed.join(exact, ["digest", "norm"]).drop("norm")
    return grouped.select(
        "doc_id",
        F.col(keep).alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col(keep)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, keep: str = "most") -> DataFrame:
    """docs with one row of each group, that of the doc_id that stays; all columns stay.

    Of rows that repeat that doc_id and the text, the least by all columns stays.
    """
    found = classes(docs, keep)
    marks = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.first("kept").alias("_kept"), F.count("*").alias("_times"))
    marks = saved(marks.filter("NOT _kept OR _times > 1"))
    rows = docs.select(F.struct("*").alias("_row"), F.sha2(normalised("_row.text"), 256).alias("_own"))
    rows = rows.join(broadcast_if_small(marks, 200_000), F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left").filter("_kept IS NULL OR _kept")
    once = rows.filter("_kept IS NULL").select("_row.*")
    repeated = rows.filter("_kept").groupBy("_id", "_sha").agg(F.min("_row").alias("_row")).select("_row.*")
    return once.unionByName(repeated)
