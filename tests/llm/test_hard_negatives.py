import math
import random

import numpy as np
import pytest

from weftgraph.llm import hard_negatives as module
from weftgraph.llm.hard_negatives import bounds, hard_negatives, hilbert

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=100, positives=5, negatives=10):
    rows = [(v, [math.floor(256 * float(x)) for x in e], (label + 1) % 10 if v is not None and v % 7 == 0 else label) for v, e, label in rows if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda v: (v is None, v or 0)
    out = []
    for i, (v, e, label) in enumerate(rows):
        if v is None or v % every:
            continue
        scored = sorted(((-dot(e, e2), last(v2), v2, label2 == label) for j, (v2, e2, label2) in enumerate(rows) if j != i), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3]][:positives]:
            found = [(n, -t) for t, _, n, alike in scored if not alike and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(v, p, k, n, -s, t) for k, (n, t) in enumerate(found[:negatives], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def vectors(n, dims=6, seed=3, labels=4):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    out = []
    for i in range(n):
        e = [f(r.choice([r.gauss(0, 0.3), r.randint(-2, 2) / 8])) for _ in range(dims)]
        out.append((i * 10, e, r.randrange(labels)))
    return out


@pytest.fixture
def small(monkeypatch, spark):
    """Many blocks, chunks and slices of few rows, in tasks of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "CHUNK", 5)
    monkeypatch.setattr(module, "ZONES", 7)
    monkeypatch.setattr(module, "ranges", lambda amount, each, least=8: 3)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def odd():
    nan, inf = float("nan"), float("inf")
    return [(100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (100, [0.25] * 6, 2), (None, [0.5] * 6, 1), (None, [0.3] * 6, 3), (300, None, 1), (400, [nan] + [0.5] * 5, 1), (500, [inf] * 6, 2), (600, [None] + [0.1] * 5, 1), (700, [0.5] * 3, 1), (800, [], 2), (900, [0.5] * 6, None), (1000, [-0.5] * 6, 7)]


def test_like_brute_force(spark, small):
    rows = vectors(230) + odd()
    expected = brute(rows)
    assert len(expected) > 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(hard_negatives(df)) == expected
    assert got(hard_negatives(df.selectExpr("*", "1 AS key", "2 AS at", "'x' AS x", "3 AS score", "4 AS chunk"))) == expected


def test_at_production_sizes_with_a_hot_vector(spark):
    rows = vectors(700, labels=3) + [(i, [0.25, -0.5, 0.125, 0.0, 0.5, 0.25], 1) for i in range(8000, 8400)]
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_wide_numbers(spark, small):
    rows = [(v, [x * 3e5 for x in e], label) for v, e, label in vectors(120)]
    assert got(hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=50)) == brute(rows, 50)


def test_empty(spark):
    df = hard_negatives(spark.createDataFrame([], SCHEMA))
    assert tuple(df.columns) == COLUMNS and got(df) == []
    assert got(hard_negatives(spark.createDataFrame([(1, [0.1], 2)], SCHEMA))) == []
    assert got(hard_negatives(spark.createDataFrame([(100, [0.1], 2)], SCHEMA))) == []


def test_reads_only_blocks_within_bounds(spark, small):
    """Clusters far apart: an anchor's windows need few of the blocks."""
    r = np.random.default_rng(1)
    rows = [(i * 20, [float(x) for x in np.float32(np.eye(8)[i % 8] + r.normal(0, 0.01, 8))], i % 8) for i in range(640)]
    sent = []
    needed = module.needed

    def counted(*a):
        out = needed(*a)
        sent.append(out.count())
        return out

    module.needed = counted
    try:
        assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        module.needed = needed
    blocks, chunks = 640 / 16, 128 / 5
    assert sent[1] < 0.5 * blocks * chunks


def test_neighbours_on_the_curve_differ_by_one():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.lexsort(hilbert(grid, 3).T[::-1])
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    r = np.random.default_rng(0)
    a, x = r.integers(-9, 9, (20, 5)).astype(float), r.integers(-9, 9, (30, 5)).astype(float)
    lo, hi = bounds(a, x.min(0)[None], x.max(0)[None])
    assert (lo[:, 0] <= (a @ x.T).min(1)).all() and (hi[:, 0] >= (a @ x.T).max(1)).all()
