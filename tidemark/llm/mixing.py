"""Mixing sources to target weights.

Each source's quota of words is exact. Documents are cut into blocks of words; a keyed permutation orders the blocks
of a source for each pass over it, and the quota is met by whole passes and the head of one more. The draws of all
sources are dealt to output shards by a splitting tree: at each node a multivariate hypergeometric variate says how
many draws of each source the left half gets, so the shards get disjoint intervals of every permuted order, with exact
totals. Inside a shard the draws are shuffled by hash. Variates are exact at every size (``hypergeometric``).

Ranks in a permuted order come from counts of hash buckets and a window inside each bucket, so no source, however hot,
meets in one task. Sources themselves may be many: targets come from running sums over partitions, and the tree first
deals groups of ``SOURCES`` sources and then, group by group, their sources. Reruns agree: all choices follow from the
seed and the rows.

Cases: null text has size 0; a null source is a source of its own, ordered last; a null doc_id is an id like others;
rows with equal doc_id, source and size are copies and get equal shares; documents and sources of size 0 take 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordering import numbered, running_sums
from tidemark.runtime import saved

from .base import broadcast_if_small, join_counted, partitions, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUCKET_BLOCKS = 20_000
SOURCES = 1024
NUMPY_MOST = 1_000_000_000
# Half the height and the shift of the box of a ratio of uniforms: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
RATIO_SLOPE, RATIO_SHIFT = Decimal("1.7155277699214135"), Decimal("0.8989161620588988")
LOG_ROOT_TWO_PI = Decimal("0.918938533204672741780329736405617639861397473637783412817")


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """src (rank by code point, null last), source, source_size, target and n, the source's rows.

    sizes: source, size. Targets share ``share`` times all sizes by weight; one that would pass ``cap`` times its
    source's size stops there and the rest is shared again. Sorted by cap / weight the stopped sources are a prefix:
    the first source that doesn't stop, when all before it have, gives the level of those that are free.
    """
    table = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), [F.col("source").asc_nulls_last()], "src")
    table = table.withColumn("src", F.col("src") - 1)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    table = table.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    table = saved(running_sums(table, ["ratio", "src"], {"stopped": F.col("most"), "weighed": F.col("weight")}))
    size, weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(float(size)) * share - F.col("stopped") + F.col("most")) / (F.lit(weight) - F.col("weighed") + F.col("weight"))
    final = table.filter(F.col("ratio") > level).agg(F.min_by(level, F.struct("ratio", "src"))).first()[0]
    free = F.col("ratio") > F.lit(final).cast("double")
    target = F.when(free, F.col("weight") * F.lit(final).cast("double")).otherwise(F.col("most"))
    return table.select(F.col("src").cast("int").alias("src"), "source", "source_size", target.alias("target"), "n")


def _log_factorial(n: int) -> Decimal:
    """ln n! to some forty digits, by Stirling's series from 2,000 on."""
    if n < 2000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = Decimal(1) / 12 - (Decimal(1) / 360 - (Decimal(1) / 1260 - (Decimal(1) / 1680 - Decimal(1) / 1188 / x**2) / x**2) / x**2) / x**2
    return (x + Decimal("0.5")) * x.ln() - x + LOG_ROOT_TWO_PI + series / x


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good: numpy's variate where it has one, else ratio of uniforms.

    The ratio of uniforms takes points of a box around the square root of the density, centred at the mean, and keeps
    those under it; logarithms of factorials have enough digits for counts of any size.
    """
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws)) if good and draws else 0
    with localcontext() as context:
        context.prec = 60
        total = good + bad
        low, high = max(0, draws - bad), min(good, draws)
        if low == high:
            return low

        def log_weight(k: int) -> Decimal:
            return -sum(_log_factorial(n) for n in (k, good - k, draws - k, bad - draws + k))

        mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
        top = log_weight(mode)
        mean = Decimal(draws) * good / total
        spread = (mean * bad / total * (total - draws) / max(1, total - 1) + Decimal("0.5")).sqrt()
        wide = RATIO_SLOPE * spread + RATIO_SHIFT
        while True:
            u, v = (Decimal(int(rng.integers(1, 1 << 62))) / (1 << 62) for _ in range(2))
            k = math.floor(mean + Decimal("0.5") + wide * (v - Decimal("0.5")) / u)
            if low <= k <= high and 2 * u.ln() <= log_weight(k) - top:
                return k


def split_tree(quotas: np.ndarray, sizes: np.ndarray, seed: list[int]) -> np.ndarray:
    """counts[shard, source] with the given sums of columns (quotas) and rows (sizes of the shards)."""
    out = np.zeros((len(sizes), len(quotas)), np.int64)

    def split(node: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = node
            return
        mid, rest = (lo + hi) // 2, int(node.sum())
        left, rng = np.zeros(len(node), np.int64), np.random.default_rng([*seed, lo, hi])
        wanted = int(sizes[lo:mid].sum())
        for s, have in enumerate(map(int, node)):
            rest -= have
            left[s] = hypergeometric(rng, have, rest, wanted)
            wanted -= int(left[s])
        split(left, lo, mid)
        split(node - left, mid, hi)

    if len(sizes):
        split(np.asarray(quotas, np.int64), 0, len(sizes))
    return out


def even(total: int, shards: int) -> np.ndarray:
    """Sizes of shards that differ by at most one."""
    return np.diff(np.array([total * k // shards for k in range(shards + 1)], np.int64))


def _intervals(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """src, draws, shard, lo, hi: the draws [lo, hi) of a source that a shard gets. quotas: src, draws.

    One task deals the groups' sums, a row for each ``SOURCES`` sources; given these, groups are independent.
    """

    def deal_groups(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("part")
        counts = split_tree(table["draws"].to_numpy(), even(int(table["draws"].sum()), shards), [seed])
        return pd.DataFrame({"part": np.tile(table["part"].to_numpy(), shards), "shard": np.repeat(np.arange(shards), len(table)), "given": counts.ravel()})

    def deal(key: tuple, table: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        table, given = table.sort_values("src"), given.sort_values("shard")
        ends = split_tree(table["draws"].to_numpy(), given["given"].to_numpy(), [seed, 1 + int(key[0])]).cumsum(axis=0)
        starts = np.vstack([np.zeros((1, ends.shape[1]), np.int64), ends[:-1]])
        shard, at = np.nonzero(ends > starts)
        return pd.DataFrame({"src": table["src"].to_numpy()[at], "draws": table["draws"].to_numpy()[at], "shard": shard, "lo": starts[shard, at], "hi": ends[shard, at]})

    quotas = quotas.withColumn("part", F.floor(F.col("src") / SOURCES).cast("int"))
    parts = quotas.groupBy("part").agg(F.sum("draws").alias("draws")).withColumn("_all", F.lit(0))
    given = parts.groupBy("_all").applyInPandas(deal_groups, "part int, shard int, given long")
    return quotas.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(deal, "src int, draws long, shard int, lo long, hi long")


def mix(docs: DataFrame, block_words: int | None = 256, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draws and sizes.

    Draws: shard, position (order inside the shard), doc_id, source, size, block, epoch, words (taken from the front
    of the block; all of it but for the last draw of a source) and copies (how many equal rows take so many words
    each). Sizes: doc_id, source, size, copies, src, source_size, target, a row for each distinct one.
    block_words None: a block is a whole document, taken whole or not at all.
    """
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    rows = docs.select("doc_id", "source", word_count().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    rows = saved(rows)
    targets = saved(source_targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, cap))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key")
    sized = join_counted(rows.select("*", named), targets.select(named, "src", "source_size", "target", "n"), "key", "n").drop("key", "n")

    long = F.lit(block_words) if block_words else F.greatest(F.col("size"), F.lit(1))
    blocks = sized.filter("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / long) - 1)))
    blocks = blocks.withColumn("own", F.least(long.cast("long"), F.col("size") - F.col("block") * long)).withColumn("words", F.col("own") * F.col("copies"))
    n_blocks = blocks.count()
    bits = max(6, math.ceil(math.log2(max(1, n_blocks / BUCKET_BLOCKS))))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "block")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    counts = blocks.groupBy("src", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("src", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("n").over(W.partitionBy("src")).alias("n_src"))
    inside = W.partitionBy("src", "bucket").orderBy("h", "doc_id", "source", "size", "block")
    ranked = (
        blocks.join(counts, ["src", "bucket"])
        .withColumn("rank", F.col("n0") + F.row_number().over(inside) - 1)
        .withColumn("at", F.col("w0") + F.coalesce(F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("quota", F.round("target").cast("long"))
        .withColumn("passes", F.floor(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1))))
        .withColumn("left", F.col("quota") - F.col("passes") * F.col("source_size") - F.col("at"))
    )
    if block_words:
        part = F.floor(F.least(F.greatest(F.col("left"), F.lit(0)), F.col("words")) / F.col("copies"))
    else:
        part = F.when(F.col("left") * 2 >= F.col("words"), F.col("own")).otherwise(0)
    ranked = ranked.withColumn("part", part.cast("long"))
    drawn = saved(
        ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
        .withColumn("taken", F.when(F.col("epoch") < F.col("passes"), F.col("own")).otherwise(F.col("part")))
        .filter("taken > 0")
        .select("src", "doc_id", "source", "size", "copies", "block", "epoch", F.col("taken").alias("words"), "h", (F.col("epoch") * F.col("n_src") + F.col("rank")).alias("g"))
    )
    quotas = drawn.groupBy("src").agg((F.max("g") + 1).alias("draws"))
    deal = _intervals(quotas, shards, seed)
    bin_of = lambda at: F.floor(at * F.lit(float(shards)) / F.col("draws"))
    deal = deal.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi") - 1))))
    placed = drawn.join(broadcast_if_small(quotas), "src")
    placed = placed.withColumn("bin", bin_of(F.col("g"))).drop("draws").join(deal.drop("draws"), ["src", "bin"]).filter("g >= lo and g < hi")
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "h", "epoch"), "doc_id", "source", "size", "block", "epoch")
    draws = placed.select("shard", F.row_number().over(order).alias("position"), "doc_id", "source", "size", "block", "epoch", "words", "copies")
    return draws, sized.select("doc_id", "source", "size", "copies", "src", "source_size", "target")


def taken_by_document(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and what the tree dealt: one row for each row of docs.

    n_draws: draws of the document; first_shard and first_position: the place of the first of them in the mix.
    """
    draws, sizes = mix(docs, **options)
    key = ["doc_id", "source", "size"]
    nothing = sizes.select(*key, "copies", "source_size", "target", F.lit(0).cast("long").alias("words"), F.lit(None).cast("struct<shard:int,position:int>").alias("place"))
    some = draws.select(*key, "copies", F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "words", F.struct("shard", "position").alias("place"))
    total = nothing.unionByName(some).groupBy(*key, "copies").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"), F.count("place").alias("n_draws"), F.min("place").alias("place"))
    each = total.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "size", "source_size", "target", "taken", "source", "n_draws", F.col("place.shard").alias("first_shard"), F.col("place.position").alias("first_position"))


def mixed_documents(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """Whole documents of the mix with all columns of docs: each row as often as the mix takes it (0, 1, 2 times).

    A shard of the mix is one partition, and its rows come in the order of their positions, so what is written is
    shuffled. Rows that repeat doc_id, source and size share a position and are next to each other.
    """
    shards = shards or partitions(docs.sparkSession)
    draws, _ = mix(docs, block_words=None, shards=shards, **options)
    place = draws.select("shard", "position", F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    rows = docs.select(F.struct("*").alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_doc_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (word_count("_row.text") == F.col("_size"))
    return rows.join(place, same).repartitionById(shards, "shard").sortWithinPartitions("shard", "position").select("_row.*")
