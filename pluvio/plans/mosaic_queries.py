"""Queries over tiles put together: analysis grids, colour overlays, maps and their blend, each with its DuckDB twin.

Tiles are those of ``events`` as a raster 256 pixels wide: 16 x 16 pixels, 16 of them around the world."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.operators import frames, mosaic
from pluvio.plans.oracle import COLOURS, GEO, NEAREST
from pluvio.plans.scalar_queries import _LAT, _X, _Y
from pluvio.sources import files, state, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIDE, ZOOM, AROUND = 16, 4, 1 << 4
TILE = "epoch long, x long, y long, width int, height int, channels int, data binary"
_TILE = pa.schema([*((n, pa.int64()) for n in ("epoch", "x", "y")), *((n, pa.int32()) for n in ("width", "height", "channels")), ("data", pa.binary())])


def query(twin: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


def _painted(order: list[int]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        image = np.zeros((SIDE, SIDE, 4), np.uint8)
        r, c = table.column("row").to_numpy() % SIDE, table.column("col").to_numpy() % SIDE
        image[r, c] = np.stack([table.column(n).to_numpy() for n in ("r", "g", "b", "alpha")], 1)[:, order]
        return pa.Table.from_pylist([{"epoch": key[0].as_py(), "x": key[1].as_py(), "y": key[2].as_py(), "width": SIDE, "height": SIDE, "channels": 4, "data": image.tobytes()}], schema=_TILE)

    return run


def tiles(spark: SparkSession, sf_dir: str, image_order: bool = False) -> DataFrame:
    """Tiles (red, green, blue, alpha; or blue first, as the image source has them). Rows of tiles beyond the
    world's are those of later frames."""
    c = tables.colours(spark, sf_dir)
    band = F.floor(F.col("row") / SIDE)
    placed = c.select((F.col("frame_idx") + 2 * F.floor(band / AROUND)).alias("epoch"), F.floor(F.col("col") / SIDE).alias("x"), (band % AROUND).alias("y"), "row", "col", "r", "g", "b", "alpha")
    return placed.groupBy("epoch", "x", "y").applyInArrow(_painted([2, 1, 0, 3] if image_order else [0, 1, 2, 3]), TILE)


_RASTER = f"raster as (select frame_idx + 2*((row//{SIDE})//{AROUND}) as epoch, (row//{SIDE})%{AROUND}*{SIDE} + row%{SIDE} as y, col as x, r, g, b, alpha from colours)"


def _views(spark: SparkSession, sf_dir: str, left: int, top: int, crop: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Views of 3 x 3 tiles around every second tile; at the edges tiles are missing."""
    at = tiles(spark, sf_dir).filter("x % 2 = 0 and y % 2 = 0").select("x", "y").distinct()
    fixed = {"left": left, "top": top, "crop_width": crop[0], "crop_height": crop[1], "width": size[0], "height": size[1]}
    v = at.select((F.col("y") * 100 + F.col("x")).alias("view_id"), F.col("x").alias("x0"), (F.col("x") + 2).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 2).alias("y1"))
    return v.withColumns({k: F.lit(n) for k, n in fixed.items()})


def _sql_views(left: int, top: int) -> str:
    return f"views as (select distinct y//{SIDE}*100 + x//{SIDE} as view_id, x//{SIDE}*{SIDE} + {left} as vx, y//{SIDE}*{SIDE} + {top} as vy, x//{SIDE} as tx, y//{SIDE} as ty from raster where (x//{SIDE})%2 = 0 and (y//{SIDE})%2 = 0)"


def _sql_weights(name: str, size: int, wanted: int) -> str:
    s = max(size / wanted, 1.0)
    return f"""{name} as (select t, i, w / sum(w) over (partition by t) as w from (select t, i, greatest(1 - abs(i + 0.5::double - (t + 0.5::double)*{size / wanted!r}::double)/{s!r}::double, 0) as w from range({wanted}) a(t), range({size}) b(i)) where w > 0)"""


# A frame of a view counts where one of the view's nine tiles is there.
_SHOWN = f"shown as (select distinct view_id, epoch from views v join raster r on r.x//{SIDE} between v.tx and v.tx+2 and r.y//{SIDE} between v.ty and v.ty+2)"


def _sql_crop(crop: tuple[int, int], columns: str) -> str:
    return f"crop as (select view_id, epoch, r.y - vy as i, r.x - vx as j, {columns} from views join raster r on r.x between vx and vx+{crop[0] - 1} and r.y between vy and vy+{crop[1] - 1})"


_UP = "floor({0} + 0.5000001)"


def _resampled(crop: tuple[int, int], size: tuple[int, int], names: list[str]) -> str:
    wide = ", ".join(f"{_UP.format(f'sum(w*{n})')} as {n}" for n in names)
    return f"""{_sql_weights("wx", crop[0], size[0])}, {_sql_weights("wy", crop[1], size[1])},
wide as (select view_id, epoch, c.i, t as col, {wide} from crop c join wx on wx.i = c.j group by view_id, epoch, c.i, t),
small as (select view_id, epoch, t as row, col, {wide} from wide c join wy on wy.i = c.i group by view_id, epoch, t, col)"""


_CROP, _SIZE = (37, 33), (20, 16)
_MUL = "(({0}*a+128)//256 + {0}*a+128)//256"


@query(f"""with {NEAREST}, seen as (select frame_idx, row, col, r, g, b, case when d2 <= 900 and alpha > 10 then alpha else 0 end as alpha from colours join nearest using (r, g, b)),
{_RASTER.replace("from colours", "from seen")}, {_sql_views(5, 7)},
{_sql_crop(_CROP, ", ".join(f"({_MUL.format(n).replace('a+', 'alpha+')})::double as {n}" for n in "rgb") + ", alpha::double as alpha")}, {_resampled(_CROP, _SIZE, ["r", "g", "b", "alpha"])}
select view_id::bigint as view_id, epoch::bigint as epoch, row::bigint as row, col::bigint as col, least(255*r::bigint//alpha::bigint, 255)::int as red, least(255*g::bigint//alpha::bigint, 255)::int as green, least(255*b::bigint//alpha::bigint, 255)::int as blue, alpha::int as alpha from small where alpha > 0""")
def overlay_stitch(spark, sf_dir):
    """Radar tiles as an overlay: only precipitation, cropped to a view and brought to its size."""
    views = _views(spark, sf_dir, 5, 7, _CROP, _SIZE)
    images = mosaic.mosaic(tiles(spark, sf_dir), views, 4, SIDE, mosaic.precipitation_only)
    return mosaic.pixels(images).filter("alpha > 0")


_MAP = (24, 24)


@query(f"""with {COLOURS}, {_RASTER}, {_sql_views(14, 3)}, {_SHOWN}, {_sql_crop(_MAP, "r, g, b, alpha")}
select s.view_id::bigint as view_id, s.epoch::bigint as epoch, i::bigint as row, j::bigint as col, coalesce(r,0)::int as red, coalesce(g,0)::int as green, coalesce(b,0)::int as blue, coalesce(alpha,0)::int as alpha
from shown s cross join range({_MAP[1]}) a(i) cross join range({_MAP[0]}) b(j) left join crop c using (view_id, epoch, i, j)""")
def map_crop(spark, sf_dir):
    """A map cut out of its tiles; what has no tile is blank."""
    return mosaic.pixels(mosaic.mosaic(tiles(spark, sf_dir), _views(spark, sf_dir, 14, 3, _MAP, _MAP), 4, SIDE))


@query(f"""with {COLOURS}, {_RASTER}, {_sql_views(14, 3)}, {_SHOWN}, {_sql_crop(_MAP, "r, g, b, alpha/255.0::double as a")},
every as (select v.view_id, v.epoch, i, j, coalesce(r,0) as r, coalesce(g,0) as g, coalesce(b,0) as b, coalesce(a,0)::double as a from shown v cross join range({_MAP[1]}) a(i) cross join range({_MAP[0]}) b(j) left join crop c using (view_id, epoch, i, j)),
both_ as (select x.view_id, x.i, x.j, x.r as r0, x.g as g0, x.b as b0, x.a as a0, y.r as r1, y.g as g1, y.b as b1, y.a as a1, y.a + x.a*(1-y.a) as a from every x join every y using (view_id, i, j) where x.epoch = 0 and y.epoch = 1)
select view_id::bigint as view_id, i::bigint as row, j::bigint as col, {", ".join(f"(case when a > 0 then {_UP.format(f'({n}1*a1 + {n}0*a0*(1-a1))/a')} else 0 end)::int as {m}" for n, m in zip("rgb", ("red", "green", "blue"), strict=True))}, {_UP.format("a*255")}::int as alpha from both_""")
def layers_blend(spark, sf_dir):
    """The second frame over the first, as overlays lie over a map."""
    images = mosaic.mosaic(tiles(spark, sf_dir).filter("epoch < 2"), _views(spark, sf_dir, 14, 3, _MAP, _MAP), 4, SIDE)
    blended = mosaic.over(images.withColumn("layer", F.col("epoch")).withColumn("epoch", F.lit(0).cast("long")))
    return mosaic.pixels(blended).drop("epoch")


# Analysis grids: a box of 30 x 44 degrees around each place in 24 x 20 pixels.
_GRID = (24, 20)
_HALF = (15.0, 22.0)


def _zoomed(sql: str) -> str:
    return sql.replace("*128", f"*{AROUND}").replace("/128.0", f"/{AROUND}.0")


_TIERS = "case when alpha >= 10 and d2 <= 3600 then floor(intensity*255)::int else 0 end"


@query(f"""with {GEO}, {NEAREST}, seen as (select frame_idx, row, col, r, g, b, {_TIERS} as level, alpha from colours join nearest using (r, g, b)),
{_RASTER.replace("from colours", "from seen").replace("r, g, b, alpha", "level")},
box as (select location_id as view_id, lat-{_HALF[0]} as lat_min, lat+{_HALF[0]} as lat_max, lon-{_HALF[1]} as lon_min, lon+{_HALF[1]} as lon_max from geod),
centre as (select *, trunc({_zoomed(_X)})::int as cx, trunc({_zoomed(_Y)})::int as cy from (select *, (lat_min+lat_max)/2 as lat, (lon_min+lon_max)/2 as lon from box)),
near as (select c.*, cx+dx as x, cy+dy as y from centre c, range(-2,3) a(dx), range(-2,3) b(dy)),
tile as (select *, x/{AROUND}.0*360.0-180.0 as w, (x+1)/{AROUND}.0*360.0-180.0 as e, {_zoomed(_LAT).format("y")} as n, {_zoomed(_LAT).format("y+1")} as s from near),
held as (select view_id, lat_min, lat_max, lon_min, lon_max, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(w) as w, max(e) as e, max(n) as n, min(s) as s from tile where e > lon_min and w < lon_max and n > lat_min and s < lat_max group by all),
cut as (select *, least(greatest(trunc((n-lat_max)/(n-s)*(y1-y0+1)*{SIDE} + 1e-9)::int, 0), (y1-y0+1)*{SIDE}) as top, least(greatest(trunc((n-lat_min)/(n-s)*(y1-y0+1)*{SIDE} + 1e-9)::int, 0), (y1-y0+1)*{SIDE}) as bottom,
  least(greatest(trunc((lon_min-w)/(e-w)*(x1-x0+1)*{SIDE} + 1e-9)::int, 0), (x1-x0+1)*{SIDE}) as "left", least(greatest(trunc((lon_max-w)/(e-w)*(x1-x0+1)*{SIDE} + 1e-9)::int, 0), (x1-x0+1)*{SIDE}) as "right" from held),
crop as (select view_id, epoch, r.y-(y0*{SIDE}+top) as i, r.x-(x0*{SIDE}+"left") as j, "right"-"left" as cw, bottom-top as ch, level from cut join raster r on r.x between x0*{SIDE}+"left" and x0*{SIDE}+"right"-1 and r.y between y0*{SIDE}+top and y0*{SIDE}+bottom-1),
wx as (select cw, t, i, v/sum(v) over (partition by cw, t) as v from (select cw, t, i, greatest(1-abs(i+0.5-(t+0.5)*(cw::double/{_GRID[0]}))/greatest(cw::double/{_GRID[0]},1), 0) as v from (select distinct cw from crop), range({_GRID[0]}) a(t), range(400) b(i) where i < cw) where v > 0),
wy as (select ch, t, i, v/sum(v) over (partition by ch, t) as v from (select ch, t, i, greatest(1-abs(i+0.5-(t+0.5)*(ch::double/{_GRID[1]}))/greatest(ch::double/{_GRID[1]},1), 0) as v from (select distinct ch from crop), range({_GRID[1]}) a(t), range(400) b(i) where i < ch) where v > 0),
wide as (select view_id, epoch, c.i, c.ch, t as col, case when c.cw = {_GRID[0]} then sum(v*level) else {_UP.format("sum(v*level)")} end as level from crop c join wx on wx.cw = c.cw and wx.i = c.j group by view_id, epoch, c.i, c.ch, c.cw, t)
select view_id::bigint as view_id, epoch::bigint as epoch, t::bigint as r, col::bigint as c, round({_UP.format("sum(v*level)")}/255.0::double, 6) as inten from wide w join wy on wy.ch = w.ch and wy.i = w.i group by view_id, epoch, t, col having {_UP.format("sum(v*level)")} > 0""")
def stitched_grid(spark, sf_dir):
    """Intensity grids of boxes around places, from decoded tiles; a tile that is missing is empty."""
    n = tables.places(spark, sf_dir)
    box = n.select(F.col("location_id").alias("view_id"), *[(F.col(c) + s * h).alias(f"{c}_{k}") for c, h in zip(("lat", "lon"), _HALF, strict=True) for k, s in (("min", -1), ("max", 1))])
    decoded = files.tile_levels(tiles(spark, sf_dir, image_order=True)).withColumnRenamed("levels", "data")
    images = mosaic.mosaic(decoded, mosaic.analysis_views(box, ZOOM, *_GRID, SIDE), 1, SIDE)
    level = mosaic.pixels(images, 1).filter("level > 0")
    return level.select("view_id", "epoch", F.col("row").alias("r"), F.col("col").alias("c"), F.round(F.col("level") / 255.0, 6).alias("inten"))


# Tiles as files, some of them damaged


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder of tiles as PNG files, of which by a rule some are cut off, empty or absent; and the tiles wanted."""

    def encoded(batches):
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                data = files.png(np.frombuffer(t["data"], np.uint8).reshape(t["height"], t["width"], 4))
                kind = (t["epoch"] + t["x"] + t["y"]) % 5
                rows.append({"epoch": t["epoch"], "zoom": ZOOM, "x": t["x"], "y": t["y"], "scheme": 2, "content": data[: len(data) // 2] if kind == 1 else b"" if kind == 2 else data})
            yield from pa.Table.from_pylist(rows, schema=pa.schema([*((n, pa.int64()) for n in files.TILE_KEY), ("content", pa.binary())])).to_batches()

    made = tiles(spark, sf_dir)
    folder = f"{state.shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    files.write_tiles(made.filter("(epoch + x + y) % 5 <> 3").mapInArrow(encoded, files.TILE_FILE), folder)
    return folder, made.select("epoch", F.lit(ZOOM).cast("long").alias("zoom"), "x", "y", F.lit(2).cast("long").alias("scheme"))


_TILE_LIST = f"tile_list as (select distinct epoch, x//{SIDE} as tx, y//{SIDE} as ty from raster)"
_STATUS = "case (epoch+tx+ty)%5 when 1 then 'unreadable' when 2 then 'empty' when 3 then 'absent' else 'ok' end"


@query(f"with {COLOURS}, {_RASTER}, {_TILE_LIST} select epoch::bigint as epoch, tx::bigint as x, ty::bigint as y, {_STATUS} as status from tile_list")
def fetch_status(spark, sf_dir):
    """What came of each tile that was wanted."""
    folder, wanted = _files(spark, sf_dir)
    return files.fetched(spark, folder, wanted).select("epoch", "x", "y", "status")


@query(f"with {COLOURS}, {_RASTER}, {_TILE_LIST} select epoch::bigint as epoch, count(*) as n_tiles, count(*) filter (where {_STATUS} = 'ok') as n_ok, count(*) filter (where {_STATUS} = 'ok') > 0 as fetch_ok from tile_list group by 1")
def fetch_frames(spark, sf_dir):
    """Whether a frame counts, by the tiles that came."""
    folder, wanted = _files(spark, sf_dir)
    return files.frame_fetches(files.fetched(spark, folder, wanted))


@query(f"""with {COLOURS}, {_RASTER}, {_TILE_LIST}, tile_pixels as (select l.epoch, tx, ty, i, j, coalesce((r+g+b)/3.0, 0) as luma from tile_list l cross join range(3, 14) a(i) cross join range(3, 14) b(j) left join raster p on p.epoch = l.epoch and p.y = ty*{SIDE}+i and p.x = tx*{SIDE}+j)
select epoch::bigint as epoch, tx::bigint as x, ty::bigint as y, round(case when {_STATUS} = 'ok' then avg((luma >= 120)::int) end, 6) as fraction from tile_pixels group by epoch, tx, ty""")
def ir_fraction(spark, sf_dir):
    """The share of bright pixels around the middle of each infrared tile; null where the tile didn't come."""
    folder, wanted = _files(spark, sf_dir)
    met = files.fetched(spark, folder, wanted)
    bright = files.tile_pixels(met.filter("status = 'ok'")).withColumn("location_id", F.struct("epoch", "x", "y")).withColumns({"loc_row": F.lit(8), "loc_col": F.lit(8)})
    share = frames.cloud_fraction(bright, 5, 120.0, SIDE).select("location_id.*", "fraction")
    return met.select("epoch", "x", "y").join(share, ["epoch", "x", "y"], "left").select("epoch", "x", "y", F.round("fraction", 6).alias("fraction"))
