"""Tiles put together by bands against whole canvases."""

import numpy as np
import pytest

from pluvio.operators import mosaic

VIEW = "view_id long, x0 long, x1 long, y0 long, y1 long, `left` long, top long, crop_width long, crop_height long, width long, height long"
TILE = "epoch long, x long, y long, width int, height int, data binary"


def image(rows):
    (r,) = rows
    return np.frombuffer(r.image, np.uint8).reshape(r.height, r.width, -1)


@pytest.mark.parametrize(("size", "channels"), [((20, 18), 1), ((61, 40), 1), ((37, 33), 1), ((37, 10), 1), ((9, 7), 4), ((50, 33), 4)])
def test_bands_add_up_to_the_view(spark, size, channels):
    r, side = np.random.default_rng(1), 16
    canvas = r.integers(0, 256, (48, 48, channels), dtype=np.uint8)
    tiles = [(e, 3 + i, 5 + j, side, side, canvas[j * 16 : j * 16 + 16, i * 16 : i * 16 + 16].tobytes()) for e in (0,) for i in range(3) for j in range(3) if (i, j) != (1, 2)]
    canvas[32:48, 16:32] = 0  # the one that is missing
    left, top, w, h = 6, 9, 37, 33
    views = spark.createDataFrame([(1, 3, 5, 5, 7, left, top, w, h, *size)], VIEW)
    crop = canvas[top : top + h, left : left + w]
    want = crop if size == (w, h) else mosaic.resized(mosaic.weighted(crop) if channels == 4 else crop, size[1], size[0])
    want = mosaic.unweighted(want) if channels == 4 and size != (w, h) else want
    got = image(mosaic.mosaic(spark.createDataFrame(tiles, TILE), views, channels, side).collect())
    assert (got == want).all()


def test_tiles_of_other_sizes_and_two_views_of_one_epoch(spark):
    small, wide = np.full((8, 8), 50, np.uint8), np.full((16, 32), 90, np.uint8)
    tiles = spark.createDataFrame([(7, 0, 0, 8, 8, small.tobytes()), (7, 1, 0, 32, 16, wide.tobytes()), (8, 1, 0, 16, 16, np.full((16, 16), 7, np.uint8).tobytes())], TILE)
    views = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 0, 16, 16, 16, 16), (2, 0, 1, 0, 0, 0, 0, 32, 16, 32, 16), (3, 40, 41, 0, 0, 0, 0, 32, 16, 32, 16)], VIEW)
    got = {(r.view_id, r.epoch): np.frombuffer(r.image, np.uint8).reshape(r.height, r.width) for r in mosaic.mosaic(tiles, views, 1, 16).collect()}
    assert set(got) == {(1, 7), (2, 7), (2, 8)}
    assert (got[1, 7] == 50).all() and (got[2, 7][:, :16] == 50).all() and (got[2, 7][:, 16:] == 90).all() and (got[2, 8][:, :16] == 0).all()


def test_a_view_beyond_its_tiles_is_blank_there(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 4, 4, np.full((4, 4, 4), 200, np.uint8).tobytes())], TILE)
    views = spark.createDataFrame([(1, 0, 1, 0, 1, 2, 2, 5, 5, 5, 5)], VIEW)
    got = image(mosaic.mosaic(tiles, views, 4, 4).collect())
    assert (got[:2, :2] == 200).all() and got[2:].sum() == 0 and got[:, 2:].sum() == 0


def test_layers_lie_over_one_another(spark):
    def row(layer, *rgba):
        return (1, 0, layer, 1, 1, np.array(rgba, np.uint8).tobytes())

    rows = [row(2, 255, 0, 0, 51), row(1, 0, 0, 0, 0), row(0, 100, 100, 100, 255)]
    (r,) = mosaic.over(spark.createDataFrame(rows, "view_id long, epoch long, layer int, width int, height int, image binary")).collect()
    assert list(r.image) == [131, 80, 80, 255]


def test_only_precipitation_stays():
    from pluvio.functions.palette import TIERS

    colour = TIERS[3][:3]
    got = mosaic.precipitation_only(np.array([[[*colour, 200], [*colour, 10], [1, 200, 3, 255]]], np.uint8))
    assert got[0, :, 3].tolist() == [200, 0, 0] and got[0, 0, :3].tolist() == list(colour)
