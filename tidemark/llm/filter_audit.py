"""Audit of filters that are applied one after another: what each takes, in every order, and what it shares with others.

A document's failures are five flags. Documents are counted once by part and flags (32 rows a part at most), and a SQL
CUBE over the flags and the part gives for each subset of filters the documents that none of them rejects: the grouping
sets' rows in which all selected flags are false. A step of an order goes from one subset to another, so its figures
are the difference of a pair of subsets, found by joins; 80 such pairs serve all 120 orders.

Cases: a null text is empty; a null part is an empty string. Identical texts: a row fails if a row of the same text
has a smaller doc_id, so rows that repeat the smallest one pass, and a null doc_id neither is smaller nor has a smaller
one. Labels that repeat a doc_id count as one row that has every 1 of them; a null or missing label is no 1. An empty
table gives an empty result; other columns of both tables aren't read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import saved

from . import textnp
from .base import text_or_empty

LETTERS = "ABCDE"
FAILURES = [f"fails_{x}" for x in LETTERS]
MEASURES = ("docs", "good", "toxic")
SALTS = 1024


def text_failures(rows: DataFrame, min_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, signs: str = "#$%&*|") -> DataFrame:
    """rows without ``text`` but with A to D of it: few words, few distinct words, many capitals, any of some ASCII signs.

    Whole batches are counted on their bytes; a word is told from others by its bytes, not by a hash.
    """
    kept = [c for c in rows.columns if c != "text"]
    is_sign = np.isin(np.arange(256), list(signs.encode("ascii")))

    def within(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flag)][at])

    def run(batches):
        for batch in batches:
            whole, ends = textnp.utf8(batch.column("text"))
            for lo, hi in textnp.slices(ends):
                raw, at = whole[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                starts, stops, word_at = textnp.word_spans(raw, at)
                numbers, n = textnp.word_numbers(*textnp.joined_words(raw, at, starts, stops)) if len(starts) else (starts, 1)
                words = np.diff(word_at)
                distinct = np.bincount(np.unique(np.repeat(np.arange(hi - lo), words) * n + numbers) // n, minlength=hi - lo)
                failures = [
                    words < min_words,
                    100 * distinct < distinct_percent * words,
                    100 * within((raw >= 0x41) & (raw <= 0x5A), at) > capital_percent * within(raw & 0xC0 != 0x80, at),
                    within(is_sign[raw], at) > 0,
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), *map(pa.array, failures)], names=[*kept, *FAILURES[:4]])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes), *(f"{f} boolean" for f in FAILURES[:4])])
    return rows.mapInArrow(run, schema)


def flagged(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, fails_A to fails_E, good and toxic (0 or 1) of each document.

    Texts are read once, to digests and flags of some 50 bytes a row that are kept in the shared folder. Only groups of
    several rows are joined back. Rows without an id are spread by a salt,
    as all of them would meet in one task of the join with labels.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_text"), text.alias("text"))
    rows = saved(text_failures(rows))
    groups = rows.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % SALTS).otherwise(0)
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic")).withColumn("_salt", F.lit(0).cast("long"))
    seen = left_counted(rows, groups).withColumn("_salt", salt).join(marks, ["doc_id", "_salt"], "left")
    again = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return seen.select("part", *FAILURES[:4], again.alias("fails_E"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def left_counted(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with ``_first`` of their text's group, null for a text that stands alone; hot groups are broadcast."""
    total = rows.count()
    hot = F.col("_rows") * SALTS > total  # fewer than SALTS groups at any size
    of_hot, rest = (groups.filter(c).select("_text", "_first") for c in (hot, ~hot))
    of_hot = F.broadcast(of_hot)
    found = rows.join(of_hot, "_text")
    return found.unionByName(rows.join(of_hot, "_text", "left_anti").join(rest, "_text", "left")).drop("_text")


def counted(rows: DataFrame) -> DataFrame:
    """Documents, good and toxic ones by part and flags."""
    return rows.groupBy("part", *FAILURES).agg(F.count("*").alias("docs"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset (bit k for filter k) and the documents that pass all filters of the subset; no row where none does."""
    flags = [F.col(f) for f in FAILURES]
    cube = counts.cube("part", *FAILURES).agg(F.grouping("part").alias("_all"), *[F.grouping(f).alias(f"_out_{f}") for f in FAILURES], *[F.sum(m).alias(m) for m in MEASURES])
    passed = F.lit(True)
    for flag in flags:
        passed = passed & ~F.coalesce(flag, F.lit(False))
    subset = sum(((1 - F.col(f"_out_{f}")) * (1 << k) for k, f in enumerate(FAILURES)), F.lit(0)).cast("int")
    return cube.filter((F.col("_all") == 0) & passed).select("part", subset.alias("subset"), *MEASURES)


def _mask(letters: str) -> int:
    return sum(1 << LETTERS.index(x) for x in letters)


def steps() -> list[tuple[str, int, str, int, int]]:
    """filter_order, step, filter, subset before, subset after: 120 orders of five steps."""
    return [("".join(o), k + 1, o[k], _mask("".join(o[:k])), _mask("".join(o[: k + 1]))) for o in permutations(LETTERS) for k in range(5)]


def audit(counts: DataFrame) -> DataFrame:
    """The figures of each part, order and step from ``counted``. Frames of fixed size (80 pairs, 600 steps) are broadcast."""
    spark, counts = counts.sparkSession, saved(counts)
    plan = steps()
    pairs = sorted({(f, b, a) for _, _, f, b, a in plan})
    weight = {p: sum(1 for _, _, f, b, a in plan if (f, b, a) == p) for p in pairs}
    full = (1 << len(LETTERS)) - 1
    pair = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(weight[f, b, a]).alias("weight")) for f, b, a in pairs])
    own = survivors(counts)
    at = lambda name: own.select("part", F.col("subset").alias(name), *[F.col(m).alias(f"{name}_{m}") for m in MEASURES])
    rows = counts.select("part").distinct().select("part", F.explode(pair).alias("p")).select("part", "p.*")
    rows = rows.join(at("before"), ["part", "before"], "left").join(at("after"), ["part", "after"], "left").na.fill(0)
    lost = {m: F.col(f"before_{m}") - F.col(f"after_{m}") for m in MEASURES}
    rows = rows.select("part", "filter", "before", "after", "weight", F.col("after_docs").alias("kept"), lost["docs"].alias("removed"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"))
    # a filter alone shows its failures, the last one of all its unique ones, and the sum over orders its share
    by_filter = rows.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("after") == full, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("weight")).alias("shapley"),
    )
    orders = spark.createDataFrame(plan, "filter_order string, step int, filter string, before int, after int")
    done = rows.drop("weight").join(by_filter, ["part", "filter"]).join(F.broadcast(orders), ["filter", "before", "after"])
    return done.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
