"""Operator 13 against brute force, with ties, windows of negative scores, and rows that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import hard_negatives as bond


def brute(rows):
    taking = []
    for vec_id, label, vector in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            if vec_id is not None and vec_id % 7 == 0:
                label = (label + 1) % 10
            taking.append((low(vec_id), label, [max(-(1 << 26), min(1 << 26, math.floor(256 * float(np.float32(x))))) for x in vector]))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    for i, label, a in taking:
        if i == low(None) or i % 100:
            continue
        first = sorted((-dot(a, v), j) for j, y, v in taking if y == label and j != i)[:5]
        others = sorted((-dot(a, v), j) for j, y, v in taking if y != label)
        for p, j in first:
            own = [(-n, m) for n, m in others if 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, r, m, -p, n) for r, (n, m) in enumerate(own, 1)]
    return sorted(out)


def low(i):
    return -(2**63) if i is None else i


def vectors(seed, n=700, width=12, labels=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([rng.gauss(0, 0.3), 0.25, -0.5]) for _ in range(width)]
        rows.append((i * 5, rng.randrange(labels), v))
    rows += [(10_000 + i, 1, rows[3][2]) for i in range(60)]  # one common vector
    rows += [(20_000, None, [0.1] * width), (20_001, 1, None), (20_100, 2, [0.1, None] * 6), (20_101, 2, [math.nan] * width), (20_102, 2, [math.inf] * width)]
    rows += [(20_200, 2, []), (20_300, 3, [0.5]), (20_301, 3, [1e30, -1e30]), (None, 1, rows[4][2]), (-300, 9, rows[5][2]), (-301, 9, [-x for x in rows[5][2]])]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS vector", "2 AS anchor")


def got(df):
    return sorted((low(r.anchor_id), low(r.positive_id), r.rank, low(r.negative_id), r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize(("block", "anchors"), [(4096, 4096), (50, 3)])
def test_against_brute_force(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(bond, "BLOCK", block)
    monkeypatch.setattr(bond, "ANCHORS", anchors)
    rows = vectors(1)
    want = brute(rows)
    assert len(want) > 100
    assert got(bond.hard_negatives(table(spark, rows).repartition(3), F.col("id") % 100 == 0)) == want


def test_few_rows(spark):
    every = F.col("id") % 100 == 0
    assert bond.hard_negatives(table(spark, []), every).count() == 0
    assert bond.hard_negatives(table(spark, [(100, 1, [1.0])]), every).count() == 0
    rows = [(100, 1, [1.0]), (1, 1, [0.5]), (2, 2, [0.45]), (3, 2, [0.5]), (4, 2, [0.5])]
    assert got(bond.hard_negatives(table(spark, rows), every)) == [(100, 1, 1, 3, 32768, 32768), (100, 1, 2, 4, 32768, 32768), (100, 1, 3, 2, 32768, 29440)]


def test_bounds_hold():
    """No candidate leaves that a full scan would keep."""
    rng = np.random.default_rng(2)
    matrix = rng.integers(-300, 300, (200, 30)).astype(np.int32)
    block = bond.Block({"ids": np.arange(200).tobytes(), "labels": np.zeros(200, np.int64).tobytes(), "columns": np.ascontiguousarray(matrix.T).tobytes(), "width": 30, "n": 200})
    vector = rng.integers(-300, 300, 30).astype(np.int64)
    scores, seen = matrix.astype(np.int64) @ vector, []

    def prune(rows, low, high):
        assert ((low <= scores[rows]) & (scores[rows] <= high)).all()
        seen.append(len(rows))
        return high >= bond.kth(low, 5)

    rows, found = bond.scan(block, np.arange(200), vector, prune)
    assert (found == scores[rows]).all()
    assert set(np.argsort(-scores)[:5]) <= set(rows)
    assert seen[-1] < 200
