"""Hard negatives against brute force, the tree's bounds against true distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel_kg.llm import negatives

ROWS = "id long, label int, vector array<double>"
ODD = [(None, 1, [1.0, 2.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan")]), (5, 1, [float("inf"), 0.0]), (6, 1, []), (50, 2, [0.5]), (50, 2, [0.5]), (100, 1, [0.25, 0.5]), (100, 2, [0.5, 0.5, 0.5])]


def plain(rows, scale, every, positives=5, negatives_=3):
    kept = sorted({(i, c, tuple(math.floor(scale * x) for x in v)) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, c, v in kept:
        if i % every:
            continue
        near = sorted((-dot(v, w), j) for j, d, w in kept if j != i and d == c)[:positives]
        for p, key in sorted(set(near)):
            away = sorted((-dot(v, w), j) for j, d, w in kept if j != i and d != c and 50 * -p <= 100 * dot(v, w) <= 95 * -p)[:negatives_]
            out += [(i, key, n + 1, j, -p, -s) for n, (s, j) in enumerate(away)]
    return sorted(out)


def mined(spark, rows, scale, every, **more):
    df = spark.createDataFrame(rows, ROWS).withColumn("block", F.lit("mine"))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % every == 0, scale=scale, **more).collect())


@pytest.mark.parametrize("scale", [4, 256, 1 << 24])
def test_same_as_brute_force(spark, scale):
    r = random.Random(scale)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = list(ODD)
    for i in range(7, 500):
        c = r.choice([0, 0, 1, 2, 3, 4])
        rows.append((i, c if r.random() < 0.8 else 9, [x + r.gauss(0, 0.4) for x in centres[c]]))
    rows += [(i, i % 3, [0.5, 0.5, 0.5]) for i in range(1000, 1150)]  # one common vector: a leaf that can't be split
    found = mined(spark, rows, scale, 20, sample=200, least=16)
    assert found == plain(rows, scale, 20) and len(found) > 40


def test_empty_and_lonely_tables(spark):
    assert mined(spark, ODD[:6], 256, 1) == []
    assert mined(spark, [], 256, 1) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [2.0])], 256, 1) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [2.0]), (2, 2, [1.5])], 256, 2) == plain([(0, 1, [1.0]), (1, 1, [2.0]), (2, 2, [1.5])], 256, 2) != []


def test_too_large_scores_are_an_error(spark):
    with pytest.raises(Exception, match="fit into a long"):
        mined(spark, [(0, 1, [1e18]), (1, 1, [1.0])], 256, 1)


def test_bounds_hold_and_skip():
    r = np.random.default_rng(3)
    rows = np.concatenate([r.normal(c, 1, (300, 4)) for c in (-20, 0, 20)])
    most = float((rows * rows).sum(axis=1).max())
    tree = negatives.Tree.fit(rows, most, 32, 4096)
    at, q = tree.assign(rows), r.normal(0, 20, (50, 4))
    leaves = np.unique(at)
    near, far = tree.bounds(q, leaves)
    away = np.sqrt((q * q).sum(axis=1)[:, None] + most - 2 * q @ rows.T)
    for k, leaf in enumerate(leaves):
        mine = away[:, at == leaf]
        assert (near[:, k] <= mine.min(axis=1) + 1e-6).all() and (far[:, k] >= mine.max(axis=1) - 1e-6).all()
    assert len(leaves) > 16 and (near > away.min(axis=1)[:, None]).mean() > 0.3
