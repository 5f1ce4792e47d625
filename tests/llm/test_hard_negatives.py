"""Hard negatives against brute force in Python's whole numbers; bounds hold the scores; many blocks, ties, odd rows."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row long, exact int, codes string"


def table(seed, n=500, dims=5, labels=4, big=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0.3, 0.4) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        c = centres[rng.randrange(labels)]
        v = [float(np.float32((x + rng.gauss(0, 0.2)) * big)) for x in c]
        rows.append((i, v, rng.randrange(labels)))
    rows += [(i, list(rows[5][1]), 1) for i in range(n, n + 80)]  # a common vector
    rows += [(50, list(rows[3][1]), 2), (50, list(rows[50][1]), rows[50][2]), (None, list(rows[9][1]), 1), (None, list(rows[9][1]), 2)]
    rows += [(100, None, 1), (150, [1.0] * dims, None), (200, [1.0, None, *[0.0] * (dims - 2)], 1), (250, [math.nan] * dims, 1), (300, [math.inf] * dims, 1), (350, [], 1), (400, [0.5], 3)]
    rng.shuffle(rows)
    return [(i, v, c, 1, 2, "x") for i, v, c in rows]


def brute(rows):
    used = []
    for i, v, c, *_ in rows:
        if v is None or c is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i is not None and i % 7 == 0 else c))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, (a, v, c) in enumerate(used):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), i, d) for j, (i, w, d) in enumerate(used) if j != k]
        for ps, p, _ in sorted((t for t in scored if t[2] == c), key=order)[:5]:
            hits = sorted((t for t in scored if t[2] != c and 50 * ps <= 100 * t[0] <= 95 * ps), key=order)[:3]
            out += [(a, p, r, n, ps, ns) for r, (ns, n, _) in enumerate(hits, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "dims", "big", "block_rows", "block_anchors"), [(1, 5, 1.0, 40, 3), (2, 8, 1.0, 32_768, 2048), (3, 1, 1.0, 100, 5), (4, 6, 2.0**17, 64, 100)])
def test_against_brute_force(spark, seed, dims, big, block_rows, block_anchors):
    rows = table(seed, dims=dims, big=big)
    got = hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows, block_anchors).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_bounds_hold_the_scores():
    rng = np.random.default_rng(1)
    for dims, size in ((1, 100), (7, 300), (16, 1 << 40)):
        exact = rng.integers(-size, size, (200, dims))
        marks = np.sort(rng.integers(-size, size, (dims, hn.CELLS + 1)), axis=1).astype(float)
        marks[:, 0], marks[:, -1] = exact.min(0), exact.max(0)
        marks = np.sort(np.clip(marks, exact.min(0)[:, None], exact.max(0)[:, None]), axis=1)
        cells = np.array([np.searchsorted(marks[d, 1:-1], exact[:, d]) for d in range(dims)]).T
        cells = np.pad(cells, ((0, 0), (0, dims % 2)))
        bounds = hn.Bounds((cells[:, ::2] * hn.CELLS + cells[:, 1::2]).astype(np.intp), exact, marks)
        low, high = bounds.of(exact[:40])
        for k in range(40):
            scores = bounds.scores(exact[k], np.arange(200))
            assert [int(s) for s in scores] == [sum(int(x) * int(y) for x, y in zip(e, exact[k], strict=True)) for e in exact]
            assert all(low[i, k] <= int(s) <= high[i, k] for i, s in enumerate(scores))


def test_bounds_leave_rows_out(monkeypatch, spark):
    """Few rows are scored exactly: the approximation decides for the others."""
    rng = np.random.default_rng(2)
    exact = rng.integers(-60, 60, (4000, 32))
    marks = np.quantile(exact, np.arange(hn.CELLS + 1) / hn.CELLS, axis=0).T
    cells = np.array([np.searchsorted(marks[d, 1:-1], exact[:, d]) for d in range(32)]).T
    bounds = hn.Bounds((cells[:, ::2] * hn.CELLS + cells[:, 1::2]).astype(np.intp), exact, marks)
    low, high = bounds.of(exact[:20])
    assert np.mean([(high[:, k] >= hn._top(low[:, k], 5)).mean() for k in range(20)]) < 0.1


def test_empty_and_without_anchors(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(None, [1.0], 1, 1, 1, "")] * 3, SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(50, [1.0], 1, 1, 1, "")], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        hn.mine(spark.createDataFrame([(50, [1e30], 1, 1, 1, "")], SCHEMA))
