"""Tiles and their borders against whole rasters."""

import numpy as np
import pytest

from pluvio.config import Grid
from pluvio.operators import components, tiled

PIXEL = "session_id long, frame_idx long, r long, c long, inten double"


def labels(df):
    return sorted((r.session_id, r.frame_idx, r.r, r.c, r.label, r.inten) for r in df.collect())


def spiral(n):
    """One line that winds through every tile, and dots that it doesn't touch."""
    at, low, high, r, c = [], 0, n - 1, 0, 0
    for r in range(0, n, 2):
        at += [(r, x) for x in range(n)]
        at.append((r + 1, n - 1 if r % 4 == 0 else 0))
    return [(y, x) for y, x in at if 0 <= y < n]


@pytest.mark.parametrize(("side", "rows"), [(8, 5), (3, 100), (64, 1)])
def test_components_across_borders(spark, side, rows):
    r = np.random.default_rng(side)
    pixels = [(0, 0, y, x, 0.5) for y, x in spiral(41)]
    for f, share in ((1, 0.45), (2, 0.6), (3, 0.75)):
        pixels += [(7, f, int(y), int(x), 0.3) for y, x in np.argwhere(r.random((50, 37)) < share)]
    pixels += [(7, 4, y, 5000, 1.0) for y in range(5000, 5020)] + [(7, 4, 0, 0, 1.0)]
    df = spark.createDataFrame(pixels, PIXEL)
    assert labels(tiled.label(df, side, rows)) == labels(components.label(df))


def test_no_pixels(spark):
    empty = spark.createDataFrame([], PIXEL)
    assert tiled.label(empty, 8).count() == 0 and tiled.focal(empty, 5, Grid(), 16).count() == 0


@pytest.mark.parametrize(("side", "k", "shape"), [(16, 5, (64, 64)), (7, 3, (20, 33)), (64, 5, (30, 30)), (4, 5, (9, 10))])
def test_focal_sums_mirror_edges_and_cross_borders(spark, side, k, shape):
    r = np.random.default_rng(k)
    image = np.where(r.random(shape) < 0.4, r.random(shape), 0.0)
    rows = [(1, 2, int(y), int(x), float(image[y, x])) for y, x in np.argwhere(image > 0)]
    grid = Grid(width=shape[1], height=shape[0])
    df = spark.createDataFrame(rows, PIXEL)
    got = {(p.r, p.c): (p.mean, p.mean_square) for p in tiled.focal(df, k, grid, side).collect()}
    wide, h = np.pad(image, k // 2, "symmetric"), k
    assert len(got) == len(rows)
    for (y, x), (mean, square) in got.items():
        window = wide[y : y + h, x : x + h]
        assert mean == pytest.approx(window.mean(), abs=1e-12) and square == pytest.approx((window * window).mean(), abs=1e-12)


def test_pixels_travel_less_than_twice(spark):
    rows = [(0, 0, y, x, 0.5) for y in range(64) for x in range(64)]
    assert tiled.with_margin(spark.createDataFrame(rows, PIXEL), 16, 2, Grid()).count() < 2 * len(rows)
