"""Tiles put together, cropped and brought to another size, and layers laid over one another.

A view is a crop of a canvas of tiles (tiles x0..x1, y0..y1, each ``side`` pixels wide) in a size of its
own. Tiles and views meet by the place of the tile. A row of tiles of a view is brought to the view's
width in one task, and gives each of the view's rows its part; the parts of the few rows of tiles are
added up. So a task holds a row of tiles of one view, or one finished view, and a missing tile is
blank. A tile of another size is brought to ``side`` first.

Resampling is bilinear: a triangle about the middle of each new pixel, as wide as a step or, where the
image grows, as a pixel; values are rounded (halves up) after the width and after the height. Colours
with alpha are weighted by it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo
from pluvio.functions.palette import TIERS

#: So that exact halves go up however they were added.
HALF = 0.5 + 1e-7

VIEW = ("view_id", "x0", "x1", "y0", "y1", "left", "top", "crop_width", "crop_height", "width", "height")


def weights(size: int, wanted: int) -> np.ndarray:
    """What each of ``size`` pixels adds to each of ``wanted``."""
    scale = size / wanted
    away = np.abs(np.arange(size)[None] + 0.5 - ((np.arange(wanted) + 0.5) * scale)[:, None]) / max(scale, 1.0)
    w = np.maximum(1 - away, 0.0)
    return w / w.sum(1, keepdims=True)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x + HALF)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image of bytes (rows, columns and, if any, channels) in another size."""
    x = image.astype(float)
    if x.shape[1] != width:
        x = _rounded(np.moveaxis(np.tensordot(weights(x.shape[1], width), x, (1, 1)), 0, 1))
    if x.shape[0] != height:
        x = _rounded(np.tensordot(weights(x.shape[0], height), x, (1, 0)))
    return x.astype(np.uint8)


def weighted(rgba: np.ndarray) -> np.ndarray:
    """Colours times their alpha, in bytes."""
    t = rgba[..., :3].astype(np.int64) * rgba[..., 3:] + 128
    return np.concatenate([((t >> 8) + t) >> 8, rgba[..., 3:]], -1).astype(np.uint8)


def unweighted(rgba: np.ndarray) -> np.ndarray:
    a = rgba[..., 3:].astype(np.int64)
    c = np.where(a > 0, np.minimum(255 * rgba[..., :3].astype(np.int64) // np.maximum(a, 1), 255), rgba[..., :3])
    return np.concatenate([c, a], -1).astype(np.uint8)


def precipitation_only(rgba: np.ndarray, distance: int = 30, least_alpha: int = 10) -> np.ndarray:
    """A radar image whose pixels of other colours than the palette's are transparent."""
    packed = (rgba[..., :3].astype(np.int64) << np.array([16, 8, 0])).sum(-1)
    colours, which = np.unique(packed, return_inverse=True)
    rgb = np.stack([colours >> 16, colours >> 8 & 255, colours & 255], 1)
    d2 = ((rgb[:, None] - np.array([t[:3] for t in TIERS], np.int64)[None]) ** 2).sum(2).min(1)
    shown = (d2 <= distance * distance)[which].reshape(packed.shape) & (rgba[..., 3] > least_alpha)
    return np.where(np.arange(4) < 3, rgba, (rgba[..., 3] * shown)[..., None]).astype(np.uint8)


BAND = "view_id long, epoch long, first int, rows int, part binary, width int, height int"
_BAND = pa.schema([("view_id", pa.int64()), ("epoch", pa.int64()), ("first", pa.int32()), ("rows", pa.int32()), ("part", pa.binary()), ("width", pa.int32()), ("height", pa.int32())])
IMAGE = "view_id long, epoch long, width int, height int, image binary"
_IMAGE = pa.schema([("view_id", pa.int64()), ("epoch", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("image", pa.binary())])


def _band(side: int, channels: int, prepare: Callable[[np.ndarray], np.ndarray] | None) -> Callable[[pa.Table], pa.Table]:
    """A row of tiles of a view: in the view's width, and what it adds to each of the view's rows."""

    def run(table: pa.Table) -> pa.Table:
        tiles = table.to_pylist()
        v = tiles[0]
        resizes = (v["crop_width"], v["crop_height"]) != (v["width"], v["height"])
        canvas = np.zeros((side, (v["x1"] - v["x0"] + 1) * side, channels), np.uint8)
        for t in tiles:
            image = np.frombuffer(t["data"], np.uint8).reshape(t["tile_height"], t["tile_width"], channels)
            image = prepare(image) if prepare else image
            image = weighted(image) if channels == 4 and resizes else image
            at = (t["x"] - v["x0"]) * side
            canvas[:, at : at + side] = image if image.shape[:2] == (side, side) else resized(image, side, side)
        # which rows of the crop lie here
        begin = (v["y"] - v["y0"]) * side - v["top"]
        low, high = max(0, begin), min(v["crop_height"], begin + side)
        if low >= high:
            return _BAND.empty_table()
        held = np.zeros((high - low, v["crop_width"], channels))
        a, b = max(0, v["left"]), min(canvas.shape[1], v["left"] + v["crop_width"])
        if a < b:
            held[:, a - v["left"] : b - v["left"]] = canvas[low - begin : high - begin, a:b]
        if v["crop_width"] != v["width"]:
            held = _rounded(np.moveaxis(np.tensordot(weights(v["crop_width"], v["width"]), held, (1, 1)), 0, 1))
        w = weights(v["crop_height"], v["height"])[:, low:high] if v["crop_height"] != v["height"] else np.eye(v["height"])[:, low:high]
        touched = np.flatnonzero(w.any(1))
        first, rows = int(touched[0]), int(touched[-1] - touched[0] + 1)
        part = np.tensordot(w[first : first + rows], held, (1, 0))
        return pa.Table.from_pylist([{"view_id": v["view_id"], "epoch": v["epoch"], "first": first, "rows": rows, "part": part.tobytes(), "width": v["width"], "height": v["height"]}], schema=_BAND)

    return run


def _whole(channels: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bands = table.to_pylist()
        v = bands[0]
        total = np.zeros((v["height"], v["width"], channels))
        for b in sorted(bands, key=lambda x: x["first"]):
            total[b["first"] : b["first"] + b["rows"]] += np.frombuffer(b["part"]).reshape(b["rows"], v["width"], channels)
        image = _rounded(total).astype(np.uint8)
        return pa.Table.from_pylist([{"view_id": v["view_id"], "epoch": v["epoch"], "width": v["width"], "height": v["height"], "image": image.tobytes()}], schema=_IMAGE)

    return run


def _unweighted(table: pa.Table) -> pa.Table:
    out = [unweighted(np.frombuffer(d, np.uint8).reshape(-1, 4)).tobytes() if r else d for d, r in zip(table.column("image").to_pylist(), table.column("resizes").to_pylist(), strict=True)]
    return table.drop_columns(["image", "resizes"]).append_column("image", pa.array(out, pa.binary())).select(_IMAGE.names).cast(_IMAGE)


def mosaic(tiles: DataFrame, views: DataFrame, channels: int = 4, side: int = 256, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """view_id, epoch and the image of each view of which there is a tile. ``tiles``: epoch, x, y, width, height,
    data (red, green, blue, alpha, or one channel); ``views``: the columns of VIEW. ``prepare`` changes
    each tile."""
    place = views.select(*VIEW, F.explode(F.sequence("x0", "x1")).alias("x")).select("*", F.explode(F.sequence("y0", "y1")).alias("y"))
    t = tiles.select("epoch", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("width").alias("tile_width"), F.col("height").alias("tile_height"), "data")
    met = place.withColumns({c: F.col(c).cast("long") for c in (*VIEW, "x", "y")}).join(t, ["x", "y"])
    bands = met.groupBy("view_id", "epoch", "y").applyInArrow(_band(side, channels, prepare), BAND)
    images = bands.groupBy("view_id", "epoch").applyInArrow(_whole(channels), IMAGE)
    if channels != 4:
        return images
    changed = ((F.col("crop_width") != F.col("width")) | (F.col("crop_height") != F.col("height"))).alias("resizes")

    def each(batches):
        for b in batches:
            yield from _unweighted(pa.Table.from_batches([b])).to_batches()

    return images.join(views.select(F.col("view_id").cast("long").alias("view_id"), changed), "view_id").select(*_IMAGE.names, "resizes").mapInArrow(each, IMAGE)


def over(layers: DataFrame) -> DataFrame:
    """Layers of one size (view_id, epoch, layer, width, height, image) as one image: each over those of
    lesser ``layer``, by its alpha."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("layer").to_pylist()
        base = np.frombuffer(rows[0]["image"], np.uint8).reshape(-1, 4).astype(float)
        for r in rows[1:]:
            top = np.frombuffer(r["image"], np.uint8).reshape(-1, 4).astype(float)
            a, b = top[:, 3:] / 255, base[:, 3:] / 255
            alpha = a + b * (1 - a)
            colour = (top[:, :3] * a + base[:, :3] * b * (1 - a)) / np.maximum(alpha, 1e-12)
            base = _rounded(np.concatenate([np.where(alpha > 0, colour, 0), alpha * 255], 1))
        v = rows[0]
        return pa.Table.from_pylist([{"view_id": v["view_id"], "epoch": v["epoch"], "width": v["width"], "height": v["height"], "image": base.astype(np.uint8).tobytes()}], schema=_IMAGE)

    return layers.groupBy("view_id", "epoch").applyInArrow(run, IMAGE)


def _pixels(channels: int, names: list[str], schema: pa.Schema) -> Callable:
    def run(batches):
        for batch in batches:
            for v in batch.to_pylist():
                x = np.frombuffer(v["image"], np.uint8).reshape(-1, channels)
                at = np.arange(len(x))
                fixed = [pa.array(np.full(len(x), v[n])) for n in ("view_id", "epoch")]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(at // v["width"]), pa.array(at % v["width"]), *(pa.array(x[:, i].astype(np.int32)) for i in range(channels))], schema=schema)

    return run


def pixels(images: DataFrame, channels: int = 4) -> DataFrame:
    """view_id, epoch, row, col and the channels of each pixel."""
    names = ["red", "green", "blue", "alpha"] if channels == 4 else ["level"]
    schema = pa.schema([*((n, pa.int64()) for n in ("view_id", "epoch", "row", "col")), *((n, pa.int32()) for n in names)])
    ddl = "view_id long, epoch long, row long, col long, " + ", ".join(f"{n} int" for n in names)
    return images.mapInArrow(_pixels(channels, names, schema), ddl)


def analysis_views(places: DataFrame, zoom: int, width: int, height: int, side: int = 256) -> DataFrame:
    """Views of analysis boxes (view_id, lat_min, lat_max, lon_min, lon_max): of the 5 x 5 tiles around a box's
    centre those that overlap it; rows count as linear in latitude within them."""
    x, y = geo.tile_xy((F.col("lat_min") + F.col("lat_max")) / 2, (F.col("lon_min") + F.col("lon_max")) / 2, zoom)
    near = places.withColumn("cx", x).withColumn("cy", y)
    for name in ("x", "y"):
        near = near.withColumn(name, F.explode(F.sequence(F.col(f"c{name}") - 2, F.col(f"c{name}") + 2)))
    near = near.withColumns({f"t_{k}": v for k, v in geo.tile_bounds(F.col("x"), F.col("y"), zoom).items()})
    met = near.filter("t_lon_max > lon_min and t_lon_min < lon_max and t_lat_max > lat_min and t_lat_min < lat_max")
    box = ["view_id", "lat_min", "lat_max", "lon_min", "lon_max"]
    held = met.groupBy(*box).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("t_lon_min").alias("west"), F.max("t_lon_max").alias("east"), F.max("t_lat_max").alias("north"), F.min("t_lat_min").alias("south"))
    h, w = (F.col("y1") - F.col("y0") + 1) * side, (F.col("x1") - F.col("x0") + 1) * side

    def inside(at: Column, most: Column) -> Column:
        return F.greatest(F.least((at + 1e-9).cast("int"), most), F.lit(0))  # a border of a tile is on its own side

    def row(lat: str) -> Column:
        return inside((F.col("north") - F.col(lat)) / (F.col("north") - F.col("south")) * h, h)

    def col(lon: str) -> Column:
        return inside((F.col(lon) - F.col("west")) / (F.col("east") - F.col("west")) * w, w)

    cut = held.withColumns({"top": row("lat_max"), "left": col("lon_min"), "crop_height": row("lat_min") - row("lat_max"), "crop_width": col("lon_max") - col("lon_min"), "width": F.lit(width), "height": F.lit(height)})
    return cut.filter("crop_height > 0 and crop_width > 0").select(*VIEW)


def viewport_views(places: DataFrame, zoom: Column | int, size: int, side: int = 256, tile_zoom: int | None = None) -> DataFrame:
    """Views of ``size`` pixels around places (view_id, lat, lon) at ``zoom``; from tiles of ``tile_zoom``, if
    given, otherwise of the same zoom, without a change of size."""
    scale = F.lit(1.0) if tile_zoom is None else F.pow(F.lit(2.0), F.lit(tile_zoom) - zoom)
    x, y = geo.tile_position(F.col("lat"), F.col("lon"), zoom)
    edge = {"_l": (x * side - size / 2) * scale, "_r": (x * side + size / 2) * scale, "_t": (y * side - size / 2) * scale, "_b": (y * side + size / 2) * scale}
    v = places.select("view_id", *[c.alias(n) for n, c in edge.items()])
    tile = {"x0": "_l", "x1": "_r", "y0": "_t", "y1": "_b"}
    v = v.withColumns({n: F.floor(F.col(c) / side) for n, c in tile.items()})
    v = v.withColumns({"left": (F.col("_l") - F.col("x0") * side).cast("int"), "top": (F.col("_t") - F.col("y0") * side).cast("int")})
    wide, high = (F.lit(size), F.lit(size)) if tile_zoom is None else ((F.col("_r") - F.col("_l")).cast("int"), (F.col("_b") - F.col("_t")).cast("int"))
    return v.withColumns({"crop_width": wide, "crop_height": high, "width": F.lit(size), "height": F.lit(size)}).select(*VIEW)
