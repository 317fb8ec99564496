"""Components and focal sums of rasters that are larger than a task.

A raster is cut into square tiles; a task holds one tile, with a margin of neighbours where a kernel
looks beyond it. Between tiles only pixels at their borders travel.

Components: each tile labels its own pixels. Pairs of neighbours across a border are edges between
the components of two tiles. They are merged in rounds: in round k by union-find within squares of
4^k x 4^k tiles, of which each holds only edges on the borders inside it, and components already
merged count as one. So no group grows with the area of the raster, only with the side of a square.
At last the components are numbered by their first pixels, in bands of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.config import Grid
from pluvio.operators.components import _STRIDE, LABELLED, _roots
from pluvio.operators.filters import FRAME
from pluvio.sources.state import stage

TILE = [*FRAME, "tr", "tc"]
#: By how much the side of a square grows from round to round.
GROWTH = 4


def tile_of(at: Column, side: int) -> Column:
    return F.floor(at / side).cast("long")


_LOCAL = "session_id long, frame_idx long, tr long, tc long, r long, c long, inten double, root long"
_LOCAL_SCHEMA = pa.schema([*((n, pa.int64()) for n in (*TILE, "r", "c")), ("inten", pa.float64()), ("root", pa.int64())])


def _label_tile(table: pa.Table) -> pa.Table:
    table = table.sort_by([("r", "ascending"), ("c", "ascending")])
    r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
    first = _roots(r, c)
    return table.append_column("root", pa.array(r[first] * _STRIDE + c[first])).select(_LOCAL_SCHEMA.names).cast(_LOCAL_SCHEMA)


_MERGED = "session_id long, frame_idx long, root long, top long"
_MERGED_SCHEMA = pa.schema([(n, pa.int64()) for n in (*FRAME, "root", "top")])


def _merge(table: pa.Table) -> pa.Table:
    """Union-find over edges: which roots have a lesser one, and the least of theirs."""
    names, ends = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
    a, b = ends[: table.num_rows].tolist(), ends[table.num_rows :].tolist()
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)  # names ascend, so the least is the root
    top = np.array([find(x) for x in range(len(names))])
    moved = np.flatnonzero(top != np.arange(len(names)))
    key = [np.full(len(moved), table.column(n)[0].as_py()) for n in FRAME]
    return pa.table([*map(pa.array, key), pa.array(names[moved]), pa.array(names[top[moved]])], schema=_MERGED_SCHEMA)


def border_edges(local: DataFrame, side: int) -> DataFrame:
    """Pairs of local roots that touch across a border: only pixels of the last row or column of a tile
    meet those of the first row or column of the next. ``r``, ``c``: the place of the second."""
    cols = [*FRAME, "r", "c", "root"]
    ends = []
    for axis in ("r", "c"):
        last = local.filter(F.col(axis) % side == side - 1).select(*cols).withColumn(axis, F.col(axis) + 1).withColumnRenamed("root", "a")
        first = local.filter(F.col(axis) % side == 0).select(*cols).withColumnRenamed("root", "b")
        ends.append(last.join(first, [*FRAME, "r", "c"]).withColumn("axis", F.lit(axis)))
    return ends[0].unionByName(ends[1])


def label(pixels: DataFrame, side: int = 256, rows: int = 1_024) -> DataFrame:
    """As ``components.label``, for rasters of any size: ``side`` of a tile, ``rows`` of a band of numbers."""
    cols = [*(F.col(n).cast("long") for n in (*FRAME, "r", "c")), F.col("inten").cast("double")]
    tiled = pixels.select(*cols).withColumn("tr", tile_of(F.col("r"), side)).withColumn("tc", tile_of(F.col("c"), side))
    local = stage(tiled.groupBy(*TILE).applyInArrow(_label_tile, _LOCAL))
    edges = border_edges(local, side)
    # the round in which both ends lie in one square
    at = F.when(F.col("axis") == "r", F.col("r")).otherwise(F.col("c"))
    widest = max(local.agg(F.greatest(F.max("r"), F.max("c"))).first()[0] or 0, side)
    sides = []
    while not sides or sides[-1] <= widest:
        sides.append((sides[-1] if sides else side) * GROWTH)
    level = F.coalesce(*[F.when(at % s != 0, i) for i, s in enumerate(sides)], F.lit(len(sides) - 1))
    edges = stage(edges.withColumn("level", level).groupBy(*FRAME, "a", "b", "level").agg(F.min("r").alias("r"), F.min("c").alias("c")))
    merged = None
    for i, s in enumerate(sides):
        now = edges.filter(F.col("level") == i)
        if merged is not None:
            for end in ("a", "b"):
                names = merged.select(*FRAME, F.col("root").alias(end), F.col("top").alias("_top"))
                now = now.join(names, [*FRAME, end], "left").withColumn(end, F.coalesce("_top", end)).drop("_top")
        square = [F.floor(F.col(n) / s).alias(f"s{n}") for n in ("r", "c")]
        moved = now.filter("a <> b").select(*FRAME, "a", "b", *square).groupBy(*FRAME, "sr", "sc").applyInArrow(_merge, _MERGED)
        if merged is None:
            merged = stage(moved)
        else:
            moved = stage(moved)
            names = moved.select(*FRAME, F.col("root").alias("top"), F.col("top").alias("_top"))
            before = merged.join(names, [*FRAME, "top"], "left").withColumn("top", F.coalesce("_top", "top")).select(*FRAME, "root", "top")
            merged = stage(before.unionByName(moved))

    # the components of each tile, with the first pixel of the whole that each belongs to
    place = F.col("r") * _STRIDE + F.col("c")
    parts = local.filter(place == F.col("root")).select(*TILE, "root", "r", "c")
    whole = stage(parts.join(merged, [*FRAME, "root"], "left").withColumn("top", F.coalesce("top", "root")))
    heads = whole.filter(F.col("top") == F.col("root")).withColumn("band", F.floor(F.col("r") / rows))
    band = [*FRAME, "band"]
    by = Window.partitionBy(*FRAME).orderBy("band")
    before = heads.groupBy(*band).agg(F.count(F.lit(1)).alias("n")).select(*band, (F.sum("n").over(by) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy(*band).orderBy("top"))
    labels = heads.withColumn("number", number).join(before, band).select(*FRAME, "top", (F.col("before") + F.col("number")).cast("int").alias("label"))
    named = whole.select(*TILE, "root", "top").join(labels, [*FRAME, "top"]).select(*TILE, "root", "label")
    # a tile's pixels meet the few components of that tile
    out = local.join(named, [*TILE, "root"])
    return out.select(*[x.split()[0] for x in LABELLED.split(", ")])


def with_margin(pixels: DataFrame, side: int, reach: int, grid: Grid) -> DataFrame:
    """``pixels`` once for each tile that sees them: their own and those less than ``reach`` beyond a border."""

    def tiles(at: str, size: int) -> Column:
        own, into = tile_of(F.col(at), side), F.col(at) % side
        before = F.when((into < reach) & (own > 0), own - 1)
        after = F.when((into >= side - reach) & ((own + 1) * side < size), own + 1)
        return F.array_compact(F.array(own, before, after))

    return pixels.withColumn("tr", F.explode(tiles("r", grid.height))).withColumn("tc", F.explode(tiles("c", grid.width)))


FOCAL = "session_id long, frame_idx long, r long, c long, mean double, mean_square double"
_FOCAL_SCHEMA = pa.schema([*((n, pa.int64()) for n in (*FRAME, "r", "c")), ("mean", pa.float64()), ("mean_square", pa.float64())])


def _box_sums(v: np.ndarray, k: int) -> np.ndarray:
    """Sums of the k x k windows of an array, by its integral image."""
    whole = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
    whole[1:, 1:] = v.cumsum(0).cumsum(1)
    return whole[k:, k:] - whole[:-k, k:] - whole[k:, :-k] + whole[:-k, :-k]


def _focal(side: int, k: int, grid: Grid) -> Callable[[tuple, pa.Table], pa.Table]:
    h = k // 2

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tr, tc = key[2].as_py(), key[3].as_py()
        top, left = tr * side, tc * side
        low_r, low_c = max(0, top - h), max(0, left - h)
        high_r, high_c = min(grid.height, top + side + h), min(grid.width, left + side + h)
        r, c, x = (table.column(n).to_numpy() for n in ("r", "c", "inten"))
        held = np.zeros((high_r - low_r, high_c - low_c))
        inside = (r >= low_r) & (r < high_r) & (c >= low_c) & (c < high_c)
        held[r[inside] - low_r, c[inside] - low_c] = x[inside]
        # beyond an edge of the raster, what the edge mirrors
        beyond = [(h - (top - low_r), h - (high_r - min(grid.height, top + side))), (h - (left - low_c), h - (high_c - min(grid.width, left + side)))]
        held = np.pad(held, beyond, "symmetric")
        own = inside & (r >= top) & (r < top + side) & (c >= left) & (c < left + side) & (x > 0)
        mean, square = _box_sums(held, k) / (k * k), _box_sums(held * held, k) / (k * k)
        y, z = r[own] - top, c[own] - left
        ids = [pa.array(np.full(len(y), key[i].as_py())) for i in range(2)]
        return pa.table([*ids, pa.array(r[own]), pa.array(c[own]), pa.array(mean[y, z]), pa.array(square[y, z])], schema=_FOCAL_SCHEMA)

    return run


def focal(pixels: DataFrame, k: int, grid: Grid, side: int = 64) -> DataFrame:
    """Mean and mean square of the k x k window around each pixel with echo; edges mirror. Rows that
    travel: each pixel once, and those at borders once more for each neighbour."""
    cols = [*(F.col(n).cast("long") for n in (*FRAME, "r", "c")), F.col("inten").cast("double")]
    seen = with_margin(pixels.select(*cols), side, k // 2, grid)
    return seen.groupBy(*TILE).applyInArrow(_focal(side, k, grid), FOCAL)
