"""Hard negatives by a vector-approximation file.

Each dimension is cut into ``CELLS`` cells, and a row is kept as the numbers of its cells beside its exact components.
For an anchor a table says what a cell can add to a score at least and at most, two dimensions to an entry; summed over
the codes they give bounds of the score, and only rows whose bounds may enter the result are scored exactly. The bounds
serve both searches: the positives (a row whose upper bound is below the fifth largest lower one is out) and the
negatives inside a window of scores (a row is out if its bounds miss the window, or if enough rows are surely inside it
and surely higher).

Anchors and rows meet in blocks: rows are dealt to blocks by their label and a hash, anchors to blocks of at most about
``ANCHORS``; a group is one pair of blocks. Positives visit only the blocks of the anchor's label. A block gives no more
than the first few rows for each anchor or window, and the first of all blocks' are the result.

Cases: rows with a null label or vector, or a component that is null or not finite take no part. Components are whole
numbers, floor(256 x), and scores are exact; one or the other that needs more than 64 bits is an error. A shorter vector
counts as if it went on with zeros. A null vec_id is no anchor and comes last among ties. Rows that repeat a vec_id are
rows of their own: only the anchor's own row isn't its positive. Empty tables and anchors without positives give
nothing; other columns aren't read.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import saved

CELLS = 16
ANCHORS = 2048
ROWS = 32_768
BUCKETS = 64
EDGE_QUANTILES = [NormalDist().inv_cdf(k / CELLS) for k in range(1, CELLS)]
FILE_SCHEMA = "row long, vec_id long, label long, bucket int, is_anchor boolean, codes binary, exact array<long>"


def components(rows: DataFrame, step: int = 7, labels: int = 10, anchor_step: int = 50) -> DataFrame:
    """row, vec_id, label, bucket, is_anchor, exact of the rows that take part. Every ``step``-th id gets the next label."""
    label = F.when(F.col("vec_id") % step == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    scaled = lambda x: x.cast("double") * 256
    exact = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**62, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is no 64-bit number"))))
    out = used.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), exact.alias("exact"))
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    return saved(out.withColumn("bucket", bucket).withColumn("is_anchor", F.coalesce(F.col("vec_id") % anchor_step == 0, F.lit(False))))


def matrix(column, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros behind them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes)][:-1], sizes)] = flat
    return out


def edges(rows: DataFrame) -> np.ndarray:
    """Cell edges of each dimension, from least to most component: inner ones by mean and deviation of all rows.

    One row of sums for each dimension and task is shuffled; what comes to the driver has one row a dimension.
    """
    dims = rows.agg(F.max(F.size("exact"))).first()[0] or 0

    def sums(batches):
        total = None
        for batch in batches:
            v = matrix(batch.column("exact"), dims).astype(float)
            own = np.array([np.full(dims, float(len(v))), v.sum(0), (v * v).sum(0), v.min(0, initial=np.inf), v.max(0, initial=-np.inf)])
            total = own if total is None else np.vstack([total[:3] + own[:3], np.minimum(total[3:4], own[3:4]), np.maximum(total[4:], own[4:])])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), *map(pa.array, total)], names=["dim", "n", "s", "q", "lo", "hi"])

    parts = rows.select("exact").mapInArrow(sums, "dim long, n double, s double, q double, lo double, hi double")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").collect()
    out = np.zeros((dims, CELLS + 1))
    for r in found:
        mean = r.s / r.n
        deviation = max(r.q / r.n - mean * mean, 0.0) ** 0.5
        out[r.dim] = np.clip(np.r_[r.lo, np.floor(mean + deviation * np.array(EDGE_QUANTILES)), r.hi], r.lo, r.hi)
    return out


def approximation_file(rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """rows with ``codes``: a byte for every two dimensions. A component c of cell k has marks[k] <= c <= marks[k + 1]."""
    dims = len(marks)

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("exact"), dims)
            cells = np.zeros((len(v), dims + dims % 2), np.uint8)
            for d in range(dims):
                cells[:, d] = np.searchsorted(marks[d, 1:-1], v[:, d], "left")
            packed = np.ascontiguousarray(cells[:, ::2] * CELLS + cells[:, 1::2])
            codes = pa.array([x.tobytes() for x in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label", "bucket", "is_anchor")), codes, batch.column("exact")], names=["row", "vec_id", "label", "bucket", "is_anchor", "codes", "exact"])

    return rows.select("row", "vec_id", "label", "bucket", "is_anchor", "exact").mapInArrow(run, FILE_SCHEMA)


class Bounds:
    """Bounds of the scores of a block of rows with some anchors, and their exact scores."""

    def __init__(self, codes: np.ndarray, exact: np.ndarray, marks: np.ndarray):
        self.codes, self.exact, self.marks = codes, exact, marks
        self.most = int(np.abs(marks).max(initial=0)) + 1

    def of(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, rows x anchors; rounding of sums of 2^53 and more is allowed for."""
        dims, n = len(self.marks), len(anchors)
        a = anchors.astype(float)[:, :, None]
        ends = np.sort(np.stack([a * self.marks[None, :, :-1], a * self.marks[None, :, 1:]]), axis=0)  # least and most, anchors x dims x cells
        slack = np.abs(ends).max(axis=(0, 3), initial=0).sum(axis=1) * (dims * 2.0**-51)
        if dims % 2:
            ends = np.concatenate([ends, np.zeros((2, n, 1, CELLS))], axis=2)
        pairs = ends[:, :, ::2, :, None] + ends[:, :, 1::2, None, :]
        tables = np.ascontiguousarray(pairs.reshape(2 * n, -1, CELLS * CELLS).transpose(1, 2, 0))  # byte x code x (all least, all most)
        out = np.zeros((len(self.codes), 2 * n))
        for lo in range(0, len(out), 1024):
            part = out[lo : lo + 1024]
            entry = np.empty_like(part)
            for j, table in enumerate(tables):
                np.take(table, self.codes[lo : lo + 1024, j], axis=0, out=entry, mode="clip")
                part += entry
        return out[:, :n] - slack, out[:, n:] + slack

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact ones, as 64-bit numbers where all sums fit, else as Python's."""
        fits = int(np.abs(anchor).max(initial=0)) * self.most * max(1, len(anchor)) < 1 << 63
        part = self.exact[rows]
        return part @ anchor if fits else part.astype(object) @ anchor.astype(object)


def first_by_score(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first: higher scores, then smaller ids, null ones last."""
    if scores.dtype != object and len(scores) > 4 * most:
        worth = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        worth = np.arange(len(scores))
    return np.array(sorted(worth.tolist(), key=lambda i: (-int(scores[i]), bool(null[i]), int(ids[i])))[:most], np.int64)


def _block(table: pa.Table, marks: np.ndarray) -> tuple[Bounds, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of a block of rows, with row, vec_id (0 for null), whether it is null, and label."""
    packed = (len(marks) + 1) // 2
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, packed) if packed else np.zeros((len(table), 0), np.uint8)
    ids = table.column("vec_id")
    plain = [table.column(c).to_numpy() for c in ("row", "label")]
    return Bounds(codes.astype(np.intp), matrix(table.column("exact"), len(marks)), marks), plain[0], ids.fill_null(0).to_numpy(), np.array(ids.is_null()), plain[1]


def _top(values: np.ndarray, most: int) -> float:
    """The most-th largest value, minus infinity where there are fewer."""
    return float(np.partition(values, len(values) - most)[len(values) - most]) if len(values) >= most else -np.inf


def block_positives(anchors: pa.Table, rows: pa.Table, marks: np.ndarray, most: int) -> pa.Table:
    """The first other rows of the anchor's label in a block, for each anchor."""
    bounds, row, ids, null, label = _block(rows, marks)
    vectors, own, wants = matrix(anchors.column("exact"), len(marks)), anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
    out = {"anchor": [], "vec_id": [], "score": []}
    for want in np.intersect1d(wants, label):
        mine = np.flatnonzero(label == want)
        part = Bounds(bounds.codes[mine], bounds.exact[mine], marks)
        for some in _some(np.flatnonzero(wants == want)):
            low, high = part.of(vectors[some])
            for k, a in enumerate(some):
                others = np.flatnonzero(row[mine] != own[a])
                left = others[high[others, k] >= _top(low[others, k], most)]
                scores = part.scores(vectors[a], left)
                best = first_by_score(scores, ids[mine[left]], null[mine[left]], most)
                out["anchor"] += [own[a]] * len(best)
                out["vec_id"] += [None if null[mine[left[i]]] else int(ids[mine[left[i]]]) for i in best]
                out["score"] += [int(scores[i]) for i in best]
    return pa.table([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def block_negatives(anchors: pa.Table, rows: pa.Table, marks: np.ndarray, most: int, least_percent: int, most_percent: int) -> pa.Table:
    """The first rows of another label inside each window in a block; anchors have a list of (place, score) of positives."""
    bounds, row, ids, null, label = _block(rows, marks)
    vectors, own, labels = matrix(anchors.column("exact"), len(marks)), anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
    positives = anchors.column("positives").to_pylist()
    out = {"anchor": [], "place": [], "vec_id": [], "score": []}
    for some in _some(np.arange(len(own))):
        lows, highs = bounds.of(vectors[some])
        for k, a in enumerate(some):
            low, high = np.ascontiguousarray(lows[:, k]), np.ascontiguousarray(highs[:, k])
            other = label != labels[a]
            for p in positives[a]:
                # whole scores s with least_percent * p <= 100 s <= most_percent * p
                least, top = -((-least_percent * p["score"]) // 100), (most_percent * p["score"]) // 100
                if least > top:
                    continue
                may = np.flatnonzero((low <= top) & (high >= least) & other)
                sure = may[(low[may] >= least) & (high[may] <= top)]
                may = may[high[may] >= _top(low[sure], most)]
                scores = bounds.scores(vectors[a], may)
                inside = np.flatnonzero((scores >= least) & (scores <= top))
                best = inside[first_by_score(scores[inside], ids[may[inside]], null[may[inside]], most)]
                out["anchor"] += [own[a]] * len(best)
                out["place"] += [p["place"]] * len(best)
                out["vec_id"] += [None if null[may[i]] else int(ids[may[i]]) for i in best]
                out["score"] += [int(scores[i]) for i in best]
    return pa.table([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def _some(anchors: np.ndarray, at_once: int = 32) -> list[np.ndarray]:
    return [anchors[i : i + at_once] for i in range(0, len(anchors), at_once)]


class Index:
    """The approximation file of a table, dealt to blocks."""

    def __init__(self, rows: DataFrame, block_rows: int = ROWS, block_anchors: int = ANCHORS):
        exact = components(rows)
        self.marks = edges(exact)
        # how many blocks each bucket of labels has: 64 rows at most, numbered one after another
        sizes = exact.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors")).orderBy("bucket").collect()
        pieces = {r.bucket: -(-r.n // block_rows) for r in sizes}
        starts, at = {}, 0
        for b, n in pieces.items():
            starts[b], at = at, at + n
        self.blocks, self.anchor_blocks = at, max(1, -(-sum(r.anchors for r in sizes) // block_anchors))
        self.rows = saved(self._dealt(approximation_file(exact, self.marks), starts, pieces))
        self.starts, self.pieces = starts, pieces

    def _by_bucket(self, values: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("bucket")) if values else F.lit(0)

    def _dealt(self, rows: DataFrame, starts: dict, pieces: dict) -> DataFrame:
        block = self._by_bucket(starts) + F.pmod(F.xxhash64("row"), self._by_bucket(pieces)).cast("int")
        return rows.withColumn("block", block).withColumn("anchor_block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(self.anchor_blocks)).cast("int"))

    def anchors(self) -> DataFrame:
        return self.rows.filter("is_anchor").drop("codes", "block", "is_anchor")

    def meet(self, anchors: DataFrame, schema: str, run) -> DataFrame:
        """run(anchors, rows) of each pair of blocks. anchors: with the range of blocks they visit, ``first`` to ``last``."""
        visits = anchors.withColumn("block", F.explode(F.sequence("first", "last"))).drop("first", "last")
        copies = self.rows.drop("anchor_block", "is_anchor", "bucket").withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(self.anchor_blocks - 1))))
        keys = ["anchor_block", "block"]
        empty = pa.schema([(f, pa.int64()) for f in schema.replace(" long", "").split(", ")]).empty_table()
        visits = visits.toDF(*visits.columns)  # columns of their own: both sides come from one table
        both = visits.groupBy(*keys).cogroup(copies.groupBy(*keys))
        return both.applyInArrow(lambda left, right: run(left, right) if len(left) and len(right) else empty, schema)

    def positives(self, most: int = 5) -> DataFrame:
        """anchor (row), place, vec_id, score: the first other rows of the anchor's label."""
        if not self.blocks:
            return self.rows.select(F.col("row").alias("anchor"), F.lit(1).alias("place"), "vec_id", F.col("row").alias("score"))
        marks = self.marks
        first = self._by_bucket(self.starts)
        anchors = self.anchors().withColumn("first", first).withColumn("last", first + self._by_bucket(self.pieces) - 1).drop("bucket")
        found = self.meet(anchors, "anchor long, vec_id long, score long", lambda a, r: block_positives(a, r, marks, most))
        order = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)

    def negatives(self, positives: DataFrame, most: int = 3, least_percent: int = 50, most_percent: int = 95) -> DataFrame:
        """anchor, place, rank, vec_id, score: for each anchor and positive the first rows of another label in the window."""
        if not self.blocks:
            return positives.select("anchor", "place", F.lit(1).alias("rank"), "vec_id", "score")
        marks = self.marks
        lists = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("place", "score")).alias("positives"))  # a few an anchor
        anchors = self.anchors().join(lists, "row").drop("bucket").withColumn("first", F.lit(0)).withColumn("last", F.lit(self.blocks - 1))
        found = self.meet(anchors, "anchor long, place long, vec_id long, score long", lambda a, r: block_negatives(a, r, marks, most, least_percent, most_percent))
        order = W.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index = Index(rows, block_rows, block_anchors)
    positives = saved(index.positives())
    negatives = index.negatives(positives)
    ids = index.rows.filter("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    named = positives.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
    out = negatives.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
