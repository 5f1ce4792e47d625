"""Exact deduplication and mixing against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from tidemark.llm import base, exact_dedup, mixing

COLUMNS = "doc_id long, text string, source string, size long, digest string"


def corpus(seed, n=200):
    rng = random.Random(seed)
    pool = [None, "", "ABC", "abc", "Ünï", "ünï", "ÀB", "Àb"] + ["".join(rng.choice("aAbB é") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, rng.choice(pool), rng.choice(["s1", "s1", "s1", "é", "S", None]), 7, "d") for i in range(n)]
    return [*rows, rows[5], rows[6], (None, "abc", None, 1, "d"), (None, "zzz Z", "s1", 1, "d")]


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("hot_share", [1000, 20, 1])
def test_exact_classes(spark, monkeypatch, hot_share):
    monkeypatch.setattr(base, "HOT_SHARE", hot_share)
    rows = corpus(1)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    expected = Counter()
    for i, t, *_ in rows:
        keep = max((x for x in groups[normal(t)] if x is not None), default=None)
        expected[(i, keep, len(groups[normal(t)]), i == keep, hashlib.sha256(normal(t).encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.classes(spark.createDataFrame(rows, COLUMNS)).collect())) == expected


def test_exact_dedup_keeps_columns_and_one_of_each(spark):
    rows = [(1, "A", "s", 0, "x"), (2, "a", "s", 0, "y"), (3, "b", "s", 0, "z"), (4, None, None, 0, None)]
    got = exact_dedup.dedup(spark.createDataFrame(rows, COLUMNS), keep="least")
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[3]]
    assert exact_dedup.dedup(spark.createDataFrame([], COLUMNS)).count() == 0


def test_dedup_keeps_one_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "A", "s"), (1, "a", "s"), (1, "a", "s"), (1, "b", "t"), (None, "a", "u"), (None, None, "v"), (None, "", "w")]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, _kept string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "A", "s"), (1, "b", "t"), (None, None, "v")], key=str)


def test_levels_and_lookup(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = [(i, f"{i % 37:064x}") for i in range(400)]
    for k in range(5):
        index.flush(spark.createDataFrame(rows[80 * k : 80 * k + 80], "doc_id long, digest string"))
    assert len(index.levels) <= 3
    groups = defaultdict(list)
    for i, d in rows:
        groups[d].append(i)
    expected = {(d, min(x), max(x), len(x)) for d, x in groups.items()}
    assert set(map(tuple, index.rows().select("digest", "least", "most", "n").collect())) == expected
    some = [f"{k:064x}" for k in (0, 5, 99)]
    assert set(map(tuple, index.lookup(some).select("digest", "least", "most", "n").collect())) == {x for x in expected if x[0] in some}


def test_bitmap_filter_loses_nothing(spark):
    digests = spark.range(3000).selectExpr("sha2(string(id), 256) AS digest")
    others = spark.range(10_000, 20_000).selectExpr("sha2(string(id), 256) AS digest")
    found = exact_dedup.bitmap_filter(digests, 3000)
    assert exact_dedup.maybe_in(digests, found).count() == 3000
    assert exact_dedup.maybe_in(others, found).count() < 2500
    assert exact_dedup.maybe_in(others, exact_dedup.bitmap_filter(digests.limit(0), 0)).count() == 0


def test_long_texts(spark):
    long = "Wörd " * 400_000
    rows = [(1, long, "s", 0, ""), (2, long.replace("W", "w"), "s", 0, ""), (3, long + "x", "s", 0, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.classes(df).collect()} == {(1, 2), (2, 2), (3, 3)}
    got = mixing.taken_by_document(df).collect()
    assert {r.doc_id: r["size"] for r in got} == {1: 400_000, 2: 400_000, 3: 400_001}
    assert sum(r.taken for r in got) == pytest.approx(1.5 * 1_200_001, abs=2)


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("block_words", [3, 256])
def test_mix_meets_targets(spark, block_words):
    rows = corpus(2, 400)
    df = spark.createDataFrame(rows, COLUMNS)
    got = mixing.taken_by_document(df, block_words=block_words).collect()
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    expected, taken = targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(expected[r.source])
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s, want in expected.items():
        assert abs(taken[s] - want) <= 4
    again = mixing.taken_by_document(df.repartition(7), block_words=block_words).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_draws_are_disjoint_and_shards_even(spark):
    draws, _ = mixing.mix(spark.createDataFrame(corpus(3, 300), COLUMNS), block_words=5, shards=6)
    rows = draws.collect()
    keys = [(r.doc_id, r.source, r["size"], r.block, r.epoch) for r in rows]
    assert len(keys) == len(set(keys))
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 6
    assert max(sizes.values()) - min(sizes.values()) <= 3
    for s in sizes:
        assert sorted(r.position for r in rows if r.shard == s) == list(range(1, sizes[s] + 1))


def test_tree_splits_exactly():
    quotas = np.array([1000, 7, 0, 333])
    sizes = mixing.even(1340, 9)
    parts = mixing.split_tree(quotas, sizes, [1])
    assert parts.sum(axis=1).tolist() == sizes.tolist()
    assert parts.sum(axis=0).tolist() == quotas.tolist()
    assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 1
    assert (parts == mixing.split_tree(quotas, sizes, [1])).all()


def test_hypergeometric_beyond_numpy(monkeypatch):
    """The ratio of uniforms against exact probabilities, and exact sums of trees with counts over 10^9."""
    with monkeypatch.context() as patch:
        patch.setattr(mixing, "NUMPY_MOST", 0)
        rng = np.random.default_rng(3)
        for good, bad, draws in ((30, 50, 20), (5, 2000, 900), (700, 40, 300)):
            n = 3000
            got = Counter(mixing.hypergeometric(rng, good, bad, draws) for _ in range(n))
            ways = {k: comb(good, k) * comb(bad, draws - k) for k in range(max(0, draws - bad), min(good, draws) + 1)}
            total = comb(good + bad, draws)
            assert set(got) <= set(ways)
            assert sum(abs(got[k] / n - w / total) for k, w in ways.items()) < 0.15
    quotas = np.array([4 * 10**12, 3 * 10**9 + 1, 17, 10**11])
    sizes = mixing.even(int(quotas.sum()), 7)
    parts = mixing.split_tree(quotas, sizes, [5])
    assert parts.sum(axis=0).tolist() == quotas.tolist()
    assert parts.sum(axis=1).tolist() == sizes.tolist()
    assert parts.min() >= 0


def test_many_sources_are_dealt_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 4)
    quotas = {k: 50 + 13 * k for k in range(11)}
    rows = mixing._intervals(spark.createDataFrame(list(quotas.items()), "src int, draws long"), 5, 1).collect()
    for k, n in quotas.items():
        ends = sorted((r.lo, r.hi) for r in rows if r.src == k)
        assert ends[0][0] == 0 and ends[-1][1] == n and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.hi - r.lo
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_mix_is_shuffled(spark):
    rows = [(i, "w " * 30, "s", 0, "") for i in range(200)] + [(1000 + i, "w " * 30, "t", 0, "") for i in range(20)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, COLUMNS), shards=1).select("doc_id").collect()
    again = mixing.mixed_documents(spark.createDataFrame(rows[::-1], COLUMNS), shards=1).select("doc_id").collect()
    assert got == again
    assert len(got) > 250
    assert sum(a == b for a, b in zip(got, got[1:], strict=False)) < 10
    assert got != sorted(got)


def test_mixed_documents_and_empty_table(spark):
    rows = corpus(4, 100)
    got = mixing.mixed_documents(spark.createDataFrame(rows, COLUMNS))
    assert got.columns == ["doc_id", "text", "source", "size", "digest"]
    times = Counter(map(tuple, got.collect()))
    have = Counter(rows)
    assert all(times[r] <= 2 * have[r] for r in times)
    assert mixing.taken_by_document(spark.createDataFrame([], COLUMNS)).count() == 0


def test_salting_splits_hot_groups_only(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(400)], "i long, k string")
    groups = rows.groupBy("k").agg({"*": "count"}).toDF("k", "n")
    left, right = base.salt_hot(rows, groups, "k", "n", ["i"])
    both = left.join(right, ["k", "_salt"]).collect()
    assert sorted(r.i for r in both) == list(range(400))
    assert len({r._salt for r in both if r.k == "hot"}) > 20
    assert all(r.n == (200 if r.k == "hot" else 1) for r in both)
