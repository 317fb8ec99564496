"""Hard negatives against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.llm import hard_negatives
from pluvio.llm.integer_vectors import products

SMALL = hard_negatives.Settings(words=5, sample=20, most_block=60, pack=2, wave=3, width=4)


def brute(rows, every, positives=5, negatives=10):
    whole = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(x * 256)) for x in v], label))
    out = []
    for a in {i for i, _, _ in whole if i % every == 0}:
        va, la = min((v, label) for i, v, label in whole if i == a)
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, v, label in whole if i != a and len(v) == len(va))
        for p, i, _ in [x for x in scored if x[2] == la][:positives]:
            met = [(-n, j) for n, j, label in scored if label != la and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(a, i, k, j, -p, n) for k, (n, j) in enumerate(met, 1)]
    return sorted(out)


def collected(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("settings", [hard_negatives.Settings(), SMALL])
def test_whole_tables(spark, settings):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) + (i % 4 == k) for k in range(6)], i % 4) for i in range(260)]
    rows += [(i, rows[9][1], i % 3) for i in range(260, 330)]  # copies, as ties
    rows += [(i, [-x for x in rows[9][1]], 77) for i in (340, 341)]
    rows += [(0, [0.5] * 6, 1), (9, [0.7] * 6, 2), (9, [0.7] * 6, 1), (370, [0.0] * 6, 1), (380, [1.0, 2.0, 3.0], 2), (381, [1.0, 2.0, 3.5], 2), (382, [0.5, 1.0, 1.0], 9), (390, [1.0] * 6, 5)]
    rows += [(400, None, 1), (410, [float("nan")] * 6, 1), (420, [None] * 6, 1), (430, [1.0] * 6, None), (None, [1.0] * 6, 1), (440, [float("inf")] * 6, 1), (450, [1e7] * 6, 2**60 + 1), (451, [1e6] * 6, 2**60 + 1), (452, [5e5] * 6, 2**60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    df = df.withColumns({c: F.lit("clash") for c in ("v", "dim", "part", "wave", "codes", "residual", "books", "shape", "n", "hash", "rank", "place", "more", "norm", "query_id")})
    got = collected(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, settings))
    assert got == brute(rows, 10) and {x[0] for x in got} >= {0, 380, 450}


def test_bounds_hold_and_few_rows_are_ranked():
    r = np.random.default_rng(2)
    v = np.floor(256 * r.standard_normal((3000, 16)))
    s = hard_negatives.Settings()
    books = hard_negatives.fit(v[:1000], s)
    codes, residual = hard_negatives.encode(v, books, s.width)
    import pyarrow as pa

    group = hard_negatives.Indexed(pa.table({"vec_id": np.arange(3000), "label": np.arange(3000) % 10, "v": pa.array(list(v)), "residual": residual, "codes": pa.array([c.tobytes() for c in codes], pa.binary())}))
    low, high = group.bounds(v[:50], books, s.width)
    exact = products(v[:50], v)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.25 * exact.std() * 8
    ranked = 0
    for j in range(50):
        own = np.sort(exact[j][(group.labels == j % 10) & (group.ids != j)])[::-1][:5]
        found = hard_negatives.window(group, j % 10, j, v[j], low[j], high[j], own, s)
        for (_, rows, score), p in zip(found, own, strict=True):
            other = group.labels != j % 10
            want = sorted((-x, i) for i, x in enumerate(exact[j].tolist()) if other[i] and 30 * p <= 100 * x <= 90 * p)[:10]
            assert [(-b, a) for a, b in zip(rows.tolist(), score.tolist(), strict=True)] == want
        kth = np.partition(low[j], -10)[-10]
        ranked += (high[j] >= kth).sum()
    assert ranked < 0.2 * exact.size


def test_an_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0).count() == 0
