"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII bytes, ASCII lower-cased. Features are word uni- and bigrams and
bigrams that skip one word, and the first 4 and 6 bytes of longer words as stems, hashed to 2^bits places, each once
a document. Training reads a bounded sample of the labelled rows (``sample`` rows, the first by hash of doc_id);
per-coordinate rates come from the accumulated squared gradients and L1 leaves few weights, which are broadcast, all
of them: at most 2^bits by their form. Scoring reads every whole text.

Cases: null text is empty; an empty text gets the bias's score; a null doc_id stays null and is never trained on, nor
are labels that are null; repeated rows are scored each, and one of a doc_id is learned from, that of the least text; without usable labels all scores are 0.5; an empty table
gives an empty result; only doc_id, text and the label column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .base import lean, text_or_empty

BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STEMS = (4, 6)
PIECE = 128  # places in a row on the way to training, so that a batch of rows is a few MB
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each feature occurrence of a batch of texts."""
    starts, stops, rows = textnp.word_spans(raw, offsets, BREAK)
    lower = LOWER[raw]
    words = textnp.word_hashes(lower, starts, stops)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    shift = np.uint64(64 - bits)
    out_row, out_place = [row], [textnp.mix(words.copy()) >> shift]
    for skip, salt in ((0, 0x51ED27), (1, 0xA3B1C5)):
        grams = textnp.gram_hashes(words ^ np.uint64(salt), 2, skip)
        inside = row[: len(grams)] == row[1 + skip :] if len(grams) else np.zeros(0, bool)
        out_row.append(row[: len(grams)][inside])
        out_place.append(grams[inside] >> shift)
    for size in STEMS:
        longer = np.flatnonzero(stops - starts > size)
        stems = textnp.word_hashes(lower, starts[longer], starts[longer] + size)
        out_row.append(row[longer])
        out_place.append(textnp.mix(stems ^ np.uint64(size)) >> shift)
    return np.concatenate(out_row), np.concatenate(out_place).astype(np.int64)


class FTRL:
    """FTRL-proximal with a rate for each coordinate; features are 0 or 1."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)  # the bias, last, isn't shrunk
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, times: float = 1.0) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * times
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable, sample: int) -> DataFrame:
    """text and label of at most ``sample`` labelled rows; usable: condition on doc_id for those to learn from."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id", "_label").agg(F.min("text").alias("text"))


def learned(ids: np.ndarray, labels: np.ndarray, parts: np.ndarray, pieces: list[np.ndarray], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, positive: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that got a weight, and the weights; 2^bits is the bias. A row's ascending places come in pieces.

    Only places that ``least`` rows have are numbered and trained, so memory goes with the sample, not with 2^bits.
    """
    rows_of = np.zeros(1 << bits, np.int32)
    for p in pieces:
        rows_of[p] += 1
    used = np.flatnonzero(rows_of >= least)
    del rows_of
    by_row = np.lexsort((parts, labels, ids))
    first = np.flatnonzero(parts[by_row] == 0)
    labels = labels[by_row][first]
    places = []
    for row in np.split(by_row, first[1:]) if len(first) else []:
        at = np.concatenate([pieces[i] for i in row])
        number = np.searchsorted(used, at)
        number = number[used[np.minimum(number, len(used) - 1)] == at] if len(used) else number[:0]
        places.append(number.astype(np.int32))
        for i in row:
            pieces[i] = None
    model = FTRL(len(used), alpha, beta, l1, l2)
    order = np.random.default_rng(7).permutation(len(places)) if places else []
    bias = np.array([len(used)])
    for _ in range(epochs):
        for i in order:
            model.learn(np.concatenate([places[i], bias]), labels[i], positive if labels[i] else 1.0)
    w = model.weights(np.arange(len(used) + 1))
    found = np.flatnonzero(w)
    return np.r_[used, 1 << bits][found], w[found]


def fit(rows: DataFrame, bits: int = 22, epochs: int = 10, alpha: float = 1.0, beta: float = 1.0, l1: float = 16.0, l2: float = 0.0, positive: float = 6.0, least: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the rows of ``training_rows``; places ascend.

    positive: how much a row of label 1 counts; least: rows of the sample that a feature must be in.
    """

    def extract(batches):
        for batch in batches:
            raw, at = textnp.utf8(batch.column("text"))
            for lo, hi in textnp.slices(at, 1 << 20):
                row, place = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)
                once = np.unique(row << bits | place)
                cuts = np.searchsorted(once, np.arange(hi - lo + 1) << bits)
                count = np.maximum(1, -(-np.diff(cuts) // PIECE))  # a row without places is one piece
                of = np.repeat(np.arange(hi - lo), count)
                part = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                starts = np.r_[cuts[of] + part * PIECE, len(once)]
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array((once & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(lo + of)).cast(pa.int64()), batch.column("_label").take(pa.array(lo + of)), pa.array(part, pa.int32()), lists], names=["_id", "_label", "part", "places"])

    def train(batches):
        ids, labels, parts, pieces = [], [], [], []
        for batch in batches:
            ids.append(batch.column("_id").to_numpy())
            labels.append(batch.column("_label").to_numpy())
            parts.append(batch.column("part").to_numpy())
            pieces += [x.values.to_numpy() for x in batch.column("places")]
        found, w = learned(*[np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, labels, parts)], pieces, bits, epochs, alpha, beta, l1, l2, positive, least)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(w, pa.float64())], names=["place", "weight"])

    # the sample is bounded by its parameter, so its places may meet in one task
    model = rows.mapInArrow(lean(extract), "_id long, _label int, part int, places array<int>").repartition(1).mapInArrow(lean(train), "place long, weight double")
    found = sorted((r.place, r.weight) for r in model.collect())  # at most 2^bits + 1
    bias = found.pop()[1] if found and found[-1][0] == 1 << bits else 0.0
    return np.array([p for p, _ in found], np.int64), np.array([w for _, w in found], np.float64), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = 22) -> DataFrame:
    """doc_id and score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places, weights, bias = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[places] = weights
        for batch in batches:
            raw, at = textnp.utf8(batch.column("text"))
            for lo, hi in textnp.slices(at, 1 << 20):
                row, place = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)
                hit = np.flatnonzero(dense[place])
                once = np.unique(row[hit] << bits | place[hit])
                sums = np.bincount(once >> bits, dense[once & ((1 << bits) - 1)], minlength=hi - lo) + bias
                scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, sample: int = 12_000, bits: int = 22) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row; learns from rows not held out."""
    model = fit(training_rows(docs, labels, label, ~held_out(), sample), bits)
    rows = score(docs, model, bits)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without rows that ``classify`` predicts as toxic; all columns stay. One pass scores and filters."""
    threshold, bits = options.pop("threshold", 0.7), options.pop("bits", 22)
    model = fit(training_rows(docs, labels, "toxic", ~held_out(), options.pop("sample", 12_000)), bits)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places, weights, bias = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[places] = weights
        limit = np.log(threshold / (1 - threshold))
        for batch in batches:
            raw, at = textnp.utf8(batch.column("text"))
            for lo, hi in textnp.slices(at, 1 << 20):
                row, place = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)
                hit = np.flatnonzero(dense[place])
                once = np.unique(row[hit] << bits | place[hit])
                sums = np.bincount(once >> bits, dense[once & ((1 << bits) - 1)], minlength=hi - lo) + bias
                yield batch.slice(lo, hi - lo).filter(pa.array(sums < limit))

    return docs.mapInArrow(lean(run), docs.schema)
