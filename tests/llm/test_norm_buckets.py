"""Exact top-k against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.llm import norm_buckets
from pluvio.llm.integer_vectors import products


def brute(vectors, every, k=5, scale=256):
    """vectors: (vec_id, list or None) rows."""
    whole = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(x * scale)) for x in v]))
    out = set()
    for q in {i for i, _ in whole if i % every == 0}:
        a = min(v for i, v in whole if i == q)
        near = sorted((-max(min(sum(x * y for x, y in zip(a, v, strict=True)), 2**63 - 1), 1 - 2**63), i) for i, v in whole if i != q and len(v) == len(a))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(near, 1)}
    return out


def collected(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shape", ["clusters", "lengths", "signs", "copies"])
def test_search_of_a_group(monkeypatch, shape):
    r = np.random.default_rng(3)
    n, dim = 3000, 16
    v = r.standard_normal((n, dim))
    if shape == "clusters":  # high thresholds: coordinates are looked up
        v = v[r.integers(0, 40, n)] + 0.05 * r.standard_normal((n, dim))
    if shape == "lengths":
        v *= np.exp(2 * r.standard_normal((n, 1)))
    if shape == "signs":  # all products are negative or zero
        v = np.abs(v)
        v[::7] = 0
    if shape == "copies":
        v[500:2500] = v[0]
    v = np.floor(v * 256)
    ids = r.permutation(n).astype(np.int64)
    q = v[:60] * (-1 if shape == "signs" else 1)
    seen = []
    for name in ("by_coordinate", "by_length"):
        old = getattr(norm_buckets.Search, name)
        monkeypatch.setattr(norm_buckets.Search, name, lambda self, *a, _f=old, _n=name: (seen.append((_n, len(a[1]))), _f(self, *a))[1])
    s = norm_buckets.Settings(bucket=200)
    of, near, score = norm_buckets.search(ids, v, ids[:60], q, np.full(60, norm_buckets._NONE), s)
    exact = products(q, v)
    for j in range(60):
        want = sorted((-int(x), int(i)) for x, i in zip(exact[j], ids, strict=True) if i != ids[j])[: s.k]
        assert sorted(zip((-score[of == j]).tolist(), near[of == j].tolist(), strict=True)) == want
    if shape == "clusters":
        assert any(n == "by_coordinate" for n, _ in seen)
        lengths = sum(m for n, m in seen if n == "by_length")
        assert lengths < 60 * 15 / 2  # most pairs of a query and a bucket are looked up or left out
    if shape == "lengths":
        assert len(seen) < 15  # the short ones are left out


def test_lookups_find_what_a_bucket_holds():
    r = np.random.default_rng(8)
    v = np.floor(256 * (r.standard_normal((500, 8)) + 4 * r.standard_normal((6, 8))[r.integers(0, 6, 500)]))
    norms = np.sqrt((v * v).sum(1))
    order = np.argsort(-norms)
    b = norm_buckets.Bucket(np.arange(500)[order], v[order], norms[order])
    exact = products(v, v)
    np.fill_diagonal(exact, np.iinfo(np.int64).min)
    least = np.sort(exact, 1)[:, -5]
    s = norm_buckets.Search(np.arange(500), v, least, norm_buckets.Settings(narrow=2.0))
    alive, cosine = s.bounds(float(b.norms[0]))
    which = np.flatnonzero(alive & (cosine > 0))
    assert not len(s.by_coordinate(b, which, cosine[which]))
    for j in which:
        assert sorted(s.found[2][s.found[0] == j])[-5:] == sorted(exact[j])[-5:]


@pytest.mark.parametrize("settings", [norm_buckets.Settings(), norm_buckets.Settings(classes=3, most_block=40, bucket=16, pack=3, wave=5)])
def test_whole_tables(spark, settings):
    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    vectors = [(i, [x * (1 + i % 5) + r.gauss(0, 0.2) for x in base[i % 8]]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 350)]  # copies
    vectors += [(0, [0.5] * 6), (0, [0.1] * 6), (5, [9.0] * 6), (1000, [1.0, 2.0]), (1001, [3.0, 1.0]), (1002, [-1.0, 0.0])]
    vectors += [(1010, [0.0] * 6), (1100, None), (1200, [float("nan")] * 6), (1300, [None] * 6), (1400, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (1500, [1e9] * 6), (1600, [1e14] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("clash") for c in ("v", "dim", "norm", "cls", "part", "wave", "pack", "n", "cuts", "parts", "least", "rank", "score", "query_id", "longest", "more")})
    got = collected(norm_buckets.top_products(df, F.col("vec_id") % 10 == 0, settings))
    want = brute(vectors, 10)
    assert got == sorted(want)


def test_an_empty_table(spark):
    assert norm_buckets.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0).count() == 0
