"""Queries over geometry, colours, gates, schedules and verification, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.config import Grid
from pluvio.functions import gates, geo, palette
from pluvio.operators import filters, frames, render, scans, verify
from pluvio.plans.oracle import COLOURS, GEO, NEAREST, OBS, PLACES, PRED, sql
from pluvio.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
G = Grid()
B = G.bounds
ZOOM = 7


def query(twin: str | None = None) -> Callable:
    """Registers a query under its function's name, with its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Colours


@query(f"with {NEAREST} select r, g, b, d2, tier::int as tier, intensity from nearest")
def palette_nearest(spark, sf_dir):
    c = tables.colours(spark, sf_dir).select("r", "g", "b").distinct()
    n = c.withColumn("n", palette.nearest(F.col("r"), F.col("g"), F.col("b")))
    return n.select("r", "g", "b", F.col("n.d2").alias("d2"), F.col("n.tier").alias("tier"), F.col("n.intensity").alias("intensity"))


@query(f"with {NEAREST} select r, g, b, intensity from nearest where d2 <= 3600")
def argmin_nearest(spark, sf_dir):
    """The nearest tier by a join with the palette and an argmin."""
    c = tables.colours(spark, sf_dir).select("r", "g", "b").distinct()
    met = c.crossJoin(F.broadcast(palette.tiers(spark)))  # ten rows
    d2 = F.pow(F.col("r") - F.col("pr"), 2) + F.pow(F.col("g") - F.col("pg"), 2) + F.pow(F.col("b") - F.col("pb"), 2)
    best = met.groupBy("r", "g", "b").agg(F.min(F.struct(d2.alias("d2"), "tier", "intensity")).alias("m"))
    return best.filter("m.d2 <= 3600").select("r", "g", "b", F.col("m.intensity").alias("intensity"))


@query(f"with {NEAREST} select frame_idx, row, col, case when alpha >= 10 and d2 <= 3600 then intensity else 0.0 end::double as intensity, floor((case when alpha >= 10 and d2 <= 3600 then intensity else 0.0 end)*255)::double/255.0 as quantised from colours join nearest using (r, g, b)")
def palette_dictionary_decode(spark, sf_dir):
    d = palette.decode_by_colour(tables.colours(spark, sf_dir))
    return d.select("frame_idx", "row", "col", "intensity", palette.quantised(F.col("intensity")).alias("quantised"))


@query(f"with {NEAREST} select frame_idx, row, col, (case when alpha <= 10 or d2 > 900 then 0 else alpha end)::int as alpha from colours join nearest using (r, g, b)")
def renderer_filter(spark, sf_dir):
    return tables.colours(spark, sf_dir).select("frame_idx", "row", "col", render.overlay_alpha(F.col("r"), F.col("g"), F.col("b"), F.col("alpha")).alias("alpha"))


@query(f"with {COLOURS} select frame_idx, row, col, (case when (0.299*r+0.587*g+0.114*b)/255.0 >= 0.1 then alpha else floor(alpha*0.25) end)::int as alpha from colours")
def render_dimming(spark, sf_dir):
    return tables.colours(spark, sf_dir).select("frame_idx", "row", "col", render.dimmed_alpha(F.col("r"), F.col("g"), F.col("b"), F.col("alpha")).alias("alpha"))


@query(f"with {NEAREST}, kept as (select frame_idx, row, col, r, g, b, (case when alpha <= 10 or d2 > 900 then 0 else alpha end)::double as a from colours join nearest using (r, g, b)) select frame_idx, count(*) as n, count(*) filter (where a > 0) as n_shown, sum(round((r*a + 200*(255-a))/255.0)::int)::bigint as red, (case when frame_idx = 1 then 2000 else 500 end)::int as frame_ms from kept group by all")
def overlay_pixels(spark, sf_dir):
    """Radar over a grey map, summed per frame; the last frame is held four times as long."""
    c = tables.colours(spark, sf_dir)
    a = c.withColumn("a", render.overlay_alpha(F.col("r"), F.col("g"), F.col("b"), F.col("alpha")))
    red = render.over(F.col("r"), F.col("a"), F.lit(200))
    out = a.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > 0).alias("n_shown"), F.sum(red).alias("red"))
    return out.withColumn("frame_ms", F.when(F.col("frame_idx") == 1, 2000).otherwise(500))


_BAND = "case when alpha <= 10 then 'transparent' when d2 <= 900 then 'both_keep' when d2 <= 3600 then 'renderer_drops' else 'both_drop' end"


@query(f"with {NEAREST} select {_BAND} as band, count(*) as n from colours join nearest using (r, g, b) group by all")
def colour_bands(spark, sf_dir):
    c = tables.colours(spark, sf_dir)
    return c.groupBy(palette.band(palette.nearest(F.col("r"), F.col("g"), F.col("b"))["d2"], F.col("alpha")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_EDGES = (0, 10, 20, 30, 40, 50, 60, 70, 80)
_HIST = " ".join(f"when sqrt(d2) > {lo} and sqrt(d2) <= {hi} then '({lo},{hi}]'" for lo, hi in zip(_EDGES, _EDGES[1:], strict=False))


@query(f"with {NEAREST}, h as (select case {_HIST} when sqrt(d2) > 80 then '(80,inf]' end as band from colours join nearest using (r, g, b) where alpha > 10) select band, count(*) as n from h where band is not null group by all")
def colour_band_histogram(spark, sf_dir):
    """Distances to the palette in half-open bands; an exact match falls in none."""
    c = tables.colours(spark, sf_dir).filter("alpha > 10")
    tens = F.least(F.ceil(F.sqrt(palette.nearest(F.col("r"), F.col("g"), F.col("b"))["d2"]) / 10), F.lit(9))
    n = c.groupBy(tens.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("k > 0")
    band = F.when(F.col("k") == 9, "(80,inf]").otherwise(F.format_string("(%d,%d]", F.col("k") * 10 - 10, F.col("k") * 10))
    return n.select(band.alias("band"), "n")


@query(f"with {NEAREST}, b as (select frame_idx, row, col, {_BAND} as band from colours join nearest using (r, g, b)) select x.band as band0, y.band as band1, count(*) as n from b x join b y on x.row = y.row and x.col = y.col and x.frame_idx = 0 and y.frame_idx = 1 group by all")
def band_transition(spark, sf_dir):
    return frames.transition(tables.colours(spark, sf_dir), palette.band(palette.nearest(F.col("r"), F.col("g"), F.col("b"))["d2"], F.col("alpha")))


@query(f"with {NEAREST}, u as (select r, g, b, d2, count(*) as n from colours join nearest using (r, g, b) where alpha > 10 and d2 > 900 group by all) select r, g, b, d2, n, round(n / (select sum(n) from u), 6) as share from u order by n desc, r, g, b limit 15")
def unmatched_colours_topn(spark, sf_dir):
    """The most frequent colours that the renderer drops: a report of fifteen rows."""
    c = tables.colours(spark, sf_dir).filter("alpha > 10").groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    u = c.withColumn("d2", palette.nearest(F.col("r"), F.col("g"), F.col("b"))["d2"]).filter("d2 > 900")
    total = u.agg(F.sum("n").alias("all"))  # one row
    return u.crossJoin(F.broadcast(total)).select("r", "g", "b", "d2", "n", F.round(F.col("n") / F.col("all"), 6).alias("share")).orderBy(F.desc("n"), "r", "g", "b").limit(15)


@query(f"with {NEAREST} select frame_idx, row, col, (case when d2 <= 3600 then least(alpha+40, 255) else 0 end)::int as alpha from colours join nearest using (r, g, b)")
def mockup_filter(spark, sf_dir):
    near = palette.nearest(F.col("r"), F.col("g"), F.col("b"))["d2"] <= 3600
    return tables.colours(spark, sf_dir).select("frame_idx", "row", "col", F.when(near, F.least(F.col("alpha") + 40, F.lit(255))).otherwise(0).cast("int").alias("alpha"))


@query(f"with {COLOURS} select (row % 5)::int as location_id, bool_or(alpha > 10) as covered from colours group by all")
def coverage_probe(spark, sf_dir):
    t = tables.colours(spark, sf_dir).withColumn("location_id", F.col("row") % 5)
    return frames.coverage(t)


@query(f"with {COLOURS} select p.location_id, round(avg(((r+g+b)/3.0 >= 120)::int),6) as fraction from colours c join (select n_nationkey::bigint as location_id, (n_nationkey*13)%64 as loc_row, (n_nationkey*29)%64 as loc_col from nation) p on abs(c.row-loc_row) <= 8 and abs(c.col-loc_col) <= 8 where frame_idx = 0 group by all")
def cloud_fraction(spark, sf_dir):
    return bright_share(spark, sf_dir)


def bright_share(spark, sf_dir, *least):
    """The share of bright pixels around each place, with the operator's own limit or a given one."""
    ir = tables.colours(spark, sf_dir).filter("frame_idx = 0")
    places = tables.locations(spark, sf_dir).select("location_id", F.col("row").alias("loc_row"), F.col("col").alias("loc_col"))
    near = places.withColumn("row", F.explode(F.sequence((F.col("loc_row") - 8).cast("int"), (F.col("loc_row") + 8).cast("int"))))
    return frames.cloud_fraction(ir.join(near, "row"), 8, *least).select("location_id", *_r("fraction"))


# Geometry

_X, _Y = "(lon+180.0)/360.0*128", "(1.0-ln(tan(radians(lat))+1.0/cos(radians(lat)))/pi())/2.0*128"


def _places(spark, sf_dir):
    return tables.places(spark, sf_dir)


@query(f"with {GEO} select location_id, trunc({_X})::int as tx, trunc({_Y})::int as ty from geod")
def geo_tile_xy(spark, sf_dir):
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), ZOOM)
    return _places(spark, sf_dir).select("location_id", x.alias("tx"), y.alias("ty"))


_LAT = "degrees(atan(sinh(pi()*(1.0-2.0*({0})/128.0))))"


@query(f"with {GEO}, t as (select location_id, trunc({_X})::int as tx, trunc({_Y})::int as ty from geod) select location_id, round({_LAT.format('ty+1')},6) as lat_min, round({_LAT.format('ty')},6) as lat_max, round(tx/128.0*360.0-180.0,6) as lon_min, round((tx+1)/128.0*360.0-180.0,6) as lon_max from t")
def geo_tile_bounds(spark, sf_dir):
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), ZOOM)
    b = geo.tile_bounds(x, y, ZOOM)
    return _places(spark, sf_dir).select("location_id", *[F.round(v, 6).alias(k) for k, v in b.items()])


_TILES = f"""t0 as (select location_id, {_X} as fx, {_Y} as fy from geod), t1 as (select location_id, case when fx-trunc(fx) < 0.5 then trunc(fx)-1 else trunc(fx) end::int as x0, case when fy-trunc(fy) < 0.5 then trunc(fy)-1 else trunc(fy) end::int as y0 from t0),
tiles as (select location_id, (dy*2+dx)::int as pos, x0+dx::int as tx, y0+dy::int as ty from t1, range(2) a(dy), range(2) b(dx))"""


@query(f"with {GEO}, {_TILES} select * from tiles")
def analysis_tiles(spark, sf_dir):
    p = _places(spark, sf_dir).select("location_id", F.posexplode(geo.analysis_tiles(F.col("lat"), F.col("lon"), ZOOM)).alias("pos", "t"))
    return p.select("location_id", "pos", F.col("t.tx").alias("tx"), F.col("t.ty").alias("ty"))


_BOUNDS = f"{_TILES}, bounds as (select location_id, min({_LAT.format('ty+1')}) as lat_min, max({_LAT.format('ty')}) as lat_max, min(tx/128.0*360.0-180.0) as lon_min, max((tx+1)/128.0*360.0-180.0) as lon_max from tiles group by all)"


def _analysis_bounds(spark, sf_dir):
    t = QUERIES["analysis_tiles"](spark, sf_dir)
    b = t.select("location_id", *[v.alias(k) for k, v in geo.tile_bounds(F.col("tx"), F.col("ty"), ZOOM).items()])
    return b.groupBy("location_id").agg(F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max"))


@query(f"with {GEO}, {_BOUNDS} select location_id, round(lat_min,6) lat_min, round(lat_max,6) lat_max, round(lon_min,6) lon_min, round(lon_max,6) lon_max from bounds")
def analysis_bounds(spark, sf_dir):
    return _analysis_bounds(spark, sf_dir).select("location_id", *_r("lat_min", "lat_max", "lon_min", "lon_max"))


@query(f"with {GEO}, {_BOUNDS} select location_id, round((lat_max-lat_min)*111.0/512,6) as km_row, round((lon_max-lon_min)*111.0*cos(radians((lat_min+lat_max)/2))/512,6) as km_col from bounds")
def pixel_size(spark, sf_dir):
    b = _analysis_bounds(spark, sf_dir)
    row, col = geo.pixel_size_km(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"), 512, 512)
    return b.select("location_id", F.round(row, 6).alias("km_row"), F.round(col, 6).alias("km_col"))


@query(f"with {GEO} select location_id, round(lat-2*360.0/128,6) as lat_min, round(lat+2*360.0/128,6) as lat_max, round(lon-2*360.0/128,6) as lon_min, round(lon+2*360.0/128,6) as lon_max, 1280 as width, 3600 as lookahead_s from geod")
def legacy_bounds(spark, sf_dir):
    """The square of two tile degrees around a place that the offline report uses."""
    half = 2 * 360.0 / 2**ZOOM
    p = _places(spark, sf_dir)
    return p.select("location_id", *[F.round(F.col(c[:3]) + s * half, 6).alias(c) for c, s in (("lat_min", -1), ("lat_max", 1), ("lon_min", -1), ("lon_max", 1))], F.lit(1280).alias("width"), F.lit(3600).alias("lookahead_s"))


_ROW, _COL = f"trunc(({B.lat_max}-lat)/({B.lat_max}-({B.lat_min}))*64)::int", f"trunc((lon-{B.lon_min})/({B.lon_max}-{B.lon_min})*64)::int"
_NEARBY = f"near as (select location_id, {B.lat_min}::double - 0.5 + location_id*0.16 as lat, {B.lon_min}::double - 0.5 + location_id*0.16 as lon from geod)"


def _nearby(spark, sf_dir):
    p = _places(spark, sf_dir)
    return p.select("location_id", (F.lit(B.lat_min) - 0.5 + F.col("location_id") * 0.16).alias("lat"), (F.lit(B.lon_min) - 0.5 + F.col("location_id") * 0.16).alias("lon"))


@query(f"with {GEO}, {_NEARBY} select location_id, {_ROW} as row, {_COL} as col from near")
def location_pixel(spark, sf_dir):
    row, col = geo.location_pixel(F.col("lat"), F.col("lon"), G)
    return _nearby(spark, sf_dir).select("location_id", row.alias("row"), col.alias("col"))


@query(f"with {GEO} select location_id, round({B.lat_max}-location_id/64.0*({B.lat_max}-({B.lat_min})),6) as lat, round({B.lon_min}+location_id*1.5/64.0*({B.lon_max}-{B.lon_min}),6) as lon from geod")
def pixel_location(spark, sf_dir):
    lat, lon = geo.pixel_location(F.col("location_id").cast("double"), F.col("location_id") * 1.5, G)
    return _places(spark, sf_dir).select("location_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"with {GEO}, {_BOUNDS} select location_id, trunc((lat_max-lat)/(lat_max-lat_min)*1280)::int as row, trunc((lon-lon_min)/(lon_max-lon_min)*1280)::int as col from bounds join geod using (location_id)")
def mockup_pixel(spark, sf_dir):
    m = _analysis_bounds(spark, sf_dir).join(_places(spark, sf_dir), "location_id")
    row = ((F.col("lat_max") - F.col("lat")) / (F.col("lat_max") - F.col("lat_min")) * 1280).cast("int")
    col = ((F.col("lon") - F.col("lon_min")) / (F.col("lon_max") - F.col("lon_min")) * 1280).cast("int")
    return m.select("location_id", row.alias("row"), col.alias("col"))


_KPP = "(40075.0/(256*pow(2,z))*cos(radians(lat)))"


@query(f"with {GEO}, tried as (select location_id, radius, z::int as z, abs(2*radius/{_KPP}-640) as off from geod, (values (64),(128),(256)) r(radius), range(1,19) s(z)) select location_id, radius::int as radius, arg_min(z, off*1e6+z) as zoom from tried group by all")
def map_zoom(spark, sf_dir):
    p = _places(spark, sf_dir).select("location_id", "lat", F.explode(F.array(F.lit(64), F.lit(128), F.lit(256))).alias("radius"))
    return p.select("location_id", "radius", geo.map_zoom(F.col("lat"), F.col("radius")).alias("zoom"))


@query(f"with {GEO}, v as (select location_id, {_X}*256 as px, {_Y}*256 as py from geod) select location_id, floor((px-320)/256)::int as tx0, floor((px+320)/256)::int as tx1, floor((py-320)/256)::int as ty0, floor((py+320)/256)::int as ty1, round(px,6) as px, round(py,6) as py from v")
def viewport(spark, sf_dir):
    px, py = geo.global_pixel(F.col("lat"), F.col("lon"), ZOOM)
    p = _places(spark, sf_dir).select("location_id", px.alias("px"), py.alias("py"))
    def tile(c: str, s: int):
        return F.floor((F.col(c) + s * 320) / 256).cast("int")

    return p.select("location_id", tile("px", -1).alias("tx0"), tile("px", 1).alias("tx1"), tile("py", -1).alias("ty0"), tile("py", 1).alias("ty1"), *_r("px", "py"))


_TB = f"tb as (select x as tx, y as ty, x/128.0*360.0-180.0 as lon_min, (x+1)/128.0*360.0-180.0 as lon_max, {_LAT.format('y+1')} as lat_min, {_LAT.format('y')} as lat_max from range(128) a(x), range(128) b(y))"


@query(f"with {GEO}, {_TB} select location_id, tx::int as tx, ty::int as ty, lat between lat_min and lat_max and lon between lon_min and lon_max as holds from geod join tb on lon_max > lon-1.5 and lon_min < lon+1.5 and lat_max > lat-1.5 and lat_min < lat+1.5")
def bbox_tiles_join(spark, sf_dir):
    """Tiles that overlap a box around a place: tile numbers of the box make the join an equi-join."""
    p = _places(spark, sf_dir)
    x0, y0 = geo.tile_xy(F.col("lat") + 1.5, F.col("lon") - 1.5, ZOOM)
    x1, y1 = geo.tile_xy(F.col("lat") - 1.5, F.col("lon") + 1.5, ZOOM)
    t = p.select("location_id", "lat", "lon", F.explode(F.sequence(x0, x1)).alias("tx"), y0.alias("y0"), y1.alias("y1"))
    t = t.select("location_id", "lat", "lon", "tx", F.explode(F.sequence("y0", "y1")).alias("ty"))
    b = geo.tile_bounds(F.col("tx"), F.col("ty"), ZOOM)
    meets = (b["lon_max"] > F.col("lon") - 1.5) & (b["lon_min"] < F.col("lon") + 1.5) & (b["lat_max"] > F.col("lat") - 1.5) & (b["lat_min"] < F.col("lat") + 1.5)
    holds = F.col("lat").between(b["lat_min"], b["lat_max"]) & F.col("lon").between(b["lon_min"], b["lon_max"])
    return t.filter(meets).select("location_id", "tx", "ty", holds.alias("holds"))


@query(sql("pl", "select s.session_id, s.frame_idx, p.location_id, coalesce(x.inten, 0.0) as inten from (select distinct session_id, frame_idx from pixels) s cross join places p left join pixels x on x.session_id = s.session_id and x.frame_idx = s.frame_idx and x.r = loc_row and x.c = loc_col"))
def point_sample(spark, sf_dir):
    places = tables.locations(spark, sf_dir).select("location_id", F.col("row").alias("loc_row"), F.col("col").alias("loc_col"))
    return frames.sample_points(tables.pixels(spark, sf_dir), places, tables.SIZE, tables.SIZE)


# Gates, labels, schedules

_HOURS = "hours as (select epoch(date_trunc('hour', ts))::bigint as hour, (floor(max(value))::bigint % 101)::double as pop from events group by 1)"
_POP = "case when {0} is null then 1.0 when {0} < 5 then 3.0 when {0} < 30 then 2.0 else 1.0 end"


@query(f"with {_HOURS}, nows as (select distinct epoch(date_trunc('minute', ts))::bigint as now from events), near as (select now, unnest([now - now%3600, now - now%3600 + 3600]) as hour from nows), m as (select now, max(pop) as pop from near left join hours using (hour) where hour between now and now+3600 group by 1) select now, pop, ({_POP.format('pop')})::double as multiplier from m")
def pop_multiplier(spark, sf_dir):
    return _multipliers(spark, sf_dir, tables.table(spark, sf_dir, "events"))


def _multipliers(spark, sf_dir, e):
    """The greatest probability within the hour after each minute of ``e``: a closed interval meets one or two hours."""
    now = e.select(F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("now")).distinct()
    hours = now.withColumn("hour", F.explode(F.array((F.floor(F.col("now") / 3600) * 3600).cast("long"), (F.floor(F.col("now") / 3600) * 3600 + 3600).cast("long"))))
    inside = hours.filter(F.col("hour").between(F.col("now"), F.col("now") + 3600))
    best = inside.join(tables.forecast(spark, sf_dir), "hour").groupBy("now").agg(F.max("pop").alias("pop"))
    m = now.join(best, "now", "left")
    return m.select("now", "pop", gates.pop_multiplier(F.col("pop")).alias("multiplier"))


_FRACTION = "(case when n_nationkey = 7 then null else (n_nationkey*7%20)/100.0 end)::double"


@query(f"select n_nationkey::bigint as location_id, {_FRACTION} as fraction, (case when {_FRACTION} is null then 1.0 when {_FRACTION} < 0.1 then 3.0 else 1.0 end)::double as multiplier from nation")
def cloud_multiplier(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("location_id"))
    n = n.withColumn("fraction", F.when(F.col("location_id") != 7, (F.col("location_id") * 7 % 20) / 100.0))
    return n.select("location_id", "fraction", gates.cloud_multiplier(F.col("fraction")).alias("multiplier"))


@query(f"with {_HOURS} select h.hour, n.n_nationkey::bigint as location_id, ceil(2*greatest({_POP.format('pop')}, case when {_FRACTION} is null then 1.0 when {_FRACTION} < 0.1 then 3.0 else 1.0 end))::int as frames from hours h cross join nation n")
def multiplier_gate(spark, sf_dir):
    cloud = QUERIES["cloud_multiplier"](spark, sf_dir).select("location_id", "fraction")
    both = tables.forecast(spark, sf_dir).crossJoin(F.broadcast(cloud))
    return both.select("hour", "location_id", gates.required_frames(F.col("pop"), F.col("fraction")).alias("frames"))


_LABEL = "case when {0}<=0 then 'none' when {0}<=0.2 then 'light' when {0}<=0.45 then 'moderate' when {0}<=0.75 then 'heavy' else 'extreme' end"


@query(f"select event_id, {_LABEL.format('value/400')} as label from events")
def intensity_label(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", gates.intensity_label(F.col("value") / 400).alias("label"))


@query("select event_id, (floor((floor(epoch(ts))::bigint-60)/600)*600+660)::bigint as next_poll, greatest((floor((floor(epoch(ts))::bigint-60)/600)*600+660)::bigint-floor(epoch(ts))::bigint, 10)::bigint as delay from events")
def aligned_poll(spark, sf_dir):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return tables.table(spark, sf_dir, "events").select("event_id", gates.next_poll(s).alias("next_poll"), gates.poll_delay(s).alias("delay"))


_LIMIT, _USED = "(event_id%7*100)", "(event_id%13*60)"


@query(f"select event_id, round(case when {_LIMIT}=0 then 0.0 when {_USED}/{_LIMIT}<0.8 then 0.0 when {_LIMIT}-{_USED}<=0 then 60.0 else 60.0/({_LIMIT}-{_USED}) end,6)::double as delay from events")
def rate_limit_delay(spark, sf_dir):
    i = F.col("event_id")
    return tables.table(spark, sf_dir, "events").select("event_id", F.round(gates.pacing_delay(i % 7 * 100, i % 13 * 60, F.lit(60)), 6).alias("delay"))


@query("select distinct (event_id%8)::int as attempt, least(5.0*pow(2,event_id%8),60.0)::double as delay from events")
def backoff_schedule(spark, sf_dir):
    a = tables.table(spark, sf_dir, "events").select((F.col("event_id") % 8).cast("int").alias("attempt")).distinct()
    return a.select("attempt", gates.backoff(F.col("attempt")).alias("delay"))


_STATUS = "(case event_id%6 when 0 then 200 when 1 then 404 when 2 then 429 when 3 then 500 when 4 then 503 else 499 end)"


@query(f"select {_STATUS}::int as status, {_STATUS}=429 or {_STATUS}>=500 as retry, count(*) as n from events group by all")
def retryable_status(spark, sf_dir):
    codes = F.array(*[F.lit(x) for x in (200, 404, 429, 500, 503, 499)])
    e = tables.table(spark, sf_dir, "events").select(F.get(codes, (F.col("event_id") % 6).cast("int")).alias("status"))
    return e.groupBy("status", gates.retryable(F.col("status")).alias("retry")).agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey, concat_ws('  ', case when length(trim(s_name))>16 then substr(trim(s_name),1,15)||'…' else trim(s_name) end, strftime(timestamp '2026-04-10 20:40:00' + to_seconds(s_suppkey*60), '%d/%m/%y  %H:%M')||' UTC', '128km') as label from supplier")
def frame_label(spark, sf_dir):
    ts = F.timestamp_seconds(F.lit(1_775_853_600) + F.col("s_suppkey") * 60)
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", gates.frame_label(F.col("s_name"), ts, F.lit(128)).alias("label"))


@query(f"with {GEO} select location_id, case when location_id%2=0 then 'Place '||location_id else printf('(%.2f, %.2f)', lat, lon) end as name from geod")
def device_names(spark, sf_dir):
    name = F.when(F.col("location_id") % 2 == 0, F.concat(F.lit("Place "), F.col("location_id").cast("string")))
    return _places(spark, sf_dir).select("location_id", gates.device_name(name, F.col("lat"), F.col("lon")).alias("name"))


@query("select c_custkey, coalesce(case when c_custkey%3=0 then 45 end, 30)::int as lookahead_minutes, coalesce(case when c_custkey%4=0 then 'osm_dark' end, 'voyager') as map_style, c_custkey%3=0 or c_custkey%4=0 as changed from customer")
def config_merge(spark, sf_dir):
    """Options laid over the stored configuration; what isn't given stays."""
    c = tables.table(spark, sf_dir, "customer").select("c_custkey")
    stored = c.select("c_custkey", F.lit(30).alias("lookahead_minutes"), F.lit("voyager").alias("map_style"))
    options = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, 45).alias("l"), F.when(F.col("c_custkey") % 4 == 0, "osm_dark").alias("s"))
    met = stored.join(options, F.col("c_custkey") == F.col("k"), "left")
    return met.select("c_custkey", F.coalesce("l", "lookahead_minutes").alias("lookahead_minutes"), F.coalesce("s", "map_style").alias("map_style"), (F.col("l").isNotNull() | F.col("s").isNotNull()).alias("changed"))


@query(f"with {GEO} select location_id, case when location_id%2=0 then 30 else 45 end * 60 as lookahead_s, 120.0::double as max_speed_kmh, 0.1::double as intensity, 64 as width, 64 as height from geod")
def location_config(spark, sf_dir):
    from pluvio.config import Detector

    d = Detector()
    look = F.when(F.col("location_id") % 2 == 0, 30).otherwise(45) * 60
    return _places(spark, sf_dir).select("location_id", look.alias("lookahead_s"), F.lit(d.max_speed_kmh).alias("max_speed_kmh"), F.lit(d.intensity).alias("intensity"), F.lit(d.grid.width).alias("width"), F.lit(d.grid.height).alias("height"))


@query(f"with {GEO} select location_id, round(lat,1) as lat, round(lon,1) as lon from geod")
def diagnostics_json(spark, sf_dir):
    """Coordinates are coarse in diagnostics; the JSON is read back."""
    j = F.to_json(F.struct(F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon")))
    p = _places(spark, sf_dir).select("location_id", F.from_json(j, "lat double, lon double").alias("d"))
    return p.select("location_id", "d.lat", "d.lon")


@query("select event_id, try_cast(case when event_id%5=0 then 'unknown' when event_id%7=0 then 'unavailable' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp) is not null as restored from events")
def restore_timestamp(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, "unknown").when(F.col("event_id") % 7 == 0, "unavailable").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return tables.table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(text).isNotNull().alias("restored"))


@query("select c_custkey, list_sort(list_filter(['clutter','speed','temporal','texture'], lambda w: not (w = 'clutter' and c_custkey%2=0) and w not in ('temporal','texture')))::varchar[] as missing from customer")
def weight_key_diff(spark, sf_dir):
    """Weights without a factor to weigh."""
    weights = F.create_map(*[F.lit(x) for p in (("texture", 0.45), ("temporal", 0.35), ("clutter", 0.2), ("speed", 0.15)) for x in p])
    have = F.array_compact(F.array(F.lit("texture"), F.lit("temporal"), F.when(F.col("c_custkey") % 2 == 0, "clutter")))
    return tables.table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(F.array_except(F.map_keys(weights), have)).alias("missing"))


_CACHE = """manifest as (select (c_custkey%4)::int as location_id, 'f'||c_custkey as path from customer where c_custkey%2=0),
cache as (select (c_custkey%4)::int as location_id, 'f'||c_custkey as path from customer where c_custkey%3=0), fetched as (select (c_custkey%4)::int as location_id, 'f'||c_custkey as path from customer where c_custkey%5<>0),
merged as (select m.location_id, m.path, case when c.path is not null then 'cached' when f.path is not null then 'fetched' else 'missing' end as origin from manifest m left join cache c using (location_id, path) left join fetched f using (location_id, path))"""


def _cache(spark, sf_dir):
    k = F.col("c_custkey")
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", (k % 4).cast("int").alias("location_id"), F.concat(F.lit("f"), k.cast("string")).alias("path"))
    manifest, cache, fetched = (c.filter(x).select("location_id", "path") for x in (k % 2 == 0, k % 3 == 0, k % 5 != 0))
    return frames.merge_cache(manifest, cache, fetched)


@query(f"with {_CACHE} select * from merged")
def frame_cache_merge(spark, sf_dir):
    return _cache(spark, sf_dir)


@query(f"with {_CACHE} select location_id, count(*) as n_frames, count(*) filter (where origin<>'missing') as n_fetched, not bool_or(origin<>'missing') as failed from merged group by all")
def fetch_guard(spark, sf_dir):
    return frames.fetch_guard(_cache(spark, sf_dir))


@query(sql("p", "select session_id, frame_idx from (select session_id, frame_idx, row_number() over (partition by session_id order by frame_idx desc) as k from (select distinct session_id, frame_idx from pixels)) where k <= 5"))
def manifest_latest_frames(spark, sf_dir):
    """The five newest frames of each session."""
    return filters.last_frames(tables.pixels(spark, sf_dir).select("session_id", "frame_idx").distinct(), 5)



# Verification

_AFTER = 7200


def _observed(after: int, least: float = 0.2) -> str:
    return f"judged as (select p.*, (select min(obs) from obs o where o.station = p.station and o.rain_mm >= {least} and o.obs > p.t and o.obs <= p.t + {after}) as first_obs from pred p), seen as (select *, first_obs is not null as observed from judged)"


_COUNTS = "count(*) filter (where predicted and observed) as hits, count(*) filter (where not predicted and observed) as misses, count(*) filter (where predicted and not observed) as false_alarms, count(*) filter (where not predicted and not observed) as correct_negatives"
_SCORES = "round(hits/nullif(hits+misses,0),6) as pod, round(false_alarms/nullif(hits+false_alarms,0),6) as far, round(hits/nullif(hits+misses+false_alarms,0),6) as csi, round((hits+false_alarms)/nullif(hits+misses,0),6) as bias"


def _judged(spark, sf_dir, after: int = _AFTER, least: float = 0.2, before: int = 0):
    return verify.observed(tables.predictions(spark, sf_dir), tables.observations(spark, sf_dir), after, least, before)


@query(f"with {OBS}, {PRED}, {_observed(_AFTER)} select event_id, station, t, predicted, observed, first_obs from seen")
def obs_forward_join(spark, sf_dir):
    return _judged(spark, sf_dir).select("event_id", "station", "t", "predicted", "observed", "first_obs")


@query(f"with {OBS}, {PRED} select event_id, exists(select 1 from obs o where o.station = p.station and o.rain_mm >= 0.2 and o.obs > p.t-3600 and o.obs <= p.t+3600) as observed from pred p")
def obs_symmetric_join(spark, sf_dir):
    return _judged(spark, sf_dir, 3600, before=3600).select("event_id", "observed")


@query(f"with {OBS}, {PRED}, {_observed(_AFTER)}, c as (select station, {_COUNTS} from seen group by rollup(station)) select station, hits, misses, false_alarms, correct_negatives, {_SCORES} from c")
def contingency_scorecard(spark, sf_dir):
    return verify.scorecard(_judged(spark, sf_dir)).select("station", "hits", "misses", "false_alarms", "correct_negatives", *_r("pod", "far", "csi", "bias"))


def _card(name: str, after: int) -> str:
    return f"{name} as (select station, hits/nullif(hits+misses,0) pod, false_alarms/nullif(hits+false_alarms,0) far, hits/nullif(hits+misses+false_alarms,0) csi, (hits+false_alarms)/nullif(hits+misses,0) bias from (select station, {_COUNTS} from (select p.*, exists(select 1 from obs o where o.station = p.station and o.rain_mm >= 0.2 and o.obs > p.t and o.obs <= p.t+{after}) as observed from pred p) group by rollup(station)))"


@query(f"with {OBS}, {PRED}, {_card('a', 3600)}, {_card('b', _AFTER)} select b.station, round(b.pod-a.pod,6) as d_pod, round(b.far-a.far,6) as d_far, round(b.csi-a.csi,6) as d_csi, round(b.bias-a.bias,6) as d_bias from b join a on a.station is not distinct from b.station")
def variant_delta(spark, sf_dir):
    base, variant = verify.scorecard(_judged(spark, sf_dir, 3600)), verify.scorecard(_judged(spark, sf_dir))
    return verify.delta(variant, base).select("station", *_r("d_pod", "d_far", "d_csi", "d_bias"))


_SWEEP = [0, 900, 1800, 2700, 3600, 5400, 7200]


@query(f"with {OBS}, {PRED}, {_observed(1800 + 7200)}, e as (select extra_s, predicted, coalesce(first_obs - t <= 1800+extra_s, false) as observed from seen, (values {', '.join(f'({x})' for x in _SWEEP)}) v(extra_s)), c as (select extra_s, {_COUNTS} from e group by all) select extra_s, hits, misses, false_alarms, correct_negatives, {_SCORES}, round((hits - lag(hits) over w)/nullif(hits+misses-lag(hits+misses) over w,0),6) as conversion from c window w as (order by extra_s)")
def obs_window_sweep(spark, sf_dir):
    s = verify.window_sweep(tables.predictions(spark, sf_dir), tables.observations(spark, sf_dir), 1800, _SWEEP)
    return s.select("extra_s", "hits", "misses", "false_alarms", "correct_negatives", *_r("pod", "far", "csi", "bias", "conversion"))


_HAV = "2*6371.0*asin(sqrt(pow(sin(radians(s_lat-lat)/2),2)+cos(radians(lat))*cos(radians(s_lat))*pow(sin(radians(s_lon-lon)/2),2)))"


@query(f"with {GEO}, st as (select k as station, -60.0+k*4.9 as s_lat, -150.0+k*11.3 as s_lon from range(25) r(k)), d as (select location_id, station, {_HAV} as km from geod, (select station, s_lat::double s_lat, s_lon::double s_lon from st)) select location_id, arg_min(station, km) as station, round(min(km),6) as km from d group by all")
def nearest_station(spark, sf_dir):
    st = spark.range(25).select(F.col("id").alias("station"), (F.lit(-60.0) + F.col("id") * 4.9).alias("s_lat"), (F.lit(-150.0) + F.col("id") * 11.3).alias("s_lon"))
    return verify.nearest_station(_places(spark, sf_dir), st).select("location_id", "station", *_r("km"))


@query(sql("p", ", fr as (select distinct session_id, frame_idx from pixels where (session_id+frame_idx)%9<>0), ends as (select session_id, e::int as end_frame from (select distinct session_id from fr), range(3,8) r(e)) select session_id, end_frame, (select count(*) from fr where fr.session_id = ends.session_id and frame_idx between end_frame-3 and end_frame) as n_frames, (select count(*) from fr where fr.session_id = ends.session_id and frame_idx between end_frame-3 and end_frame) = 4 as complete from ends"))
def window_gap_enumeration(spark, sf_dir):
    f = tables.pixels(spark, sf_dir).select("session_id", "frame_idx").distinct().filter((F.col("session_id") + F.col("frame_idx")) % 9 != 0)
    return verify.windows(f, 4, 0, 7)


@query(f"with {OBS}, {PRED}, {_observed(_AFTER)}, i as (select *, not predicted and observed as miss, sum((not (not predicted and observed))::int) over (partition by station order by t, event_id rows unbounded preceding) as island from seen) select station, count(*) as length, min(t) as first_t, max(t) as last_t from i where miss group by station, island")
def miss_runs(spark, sf_dir):
    return verify.miss_runs(_judged(spark, sf_dir))


@query(f"with {OBS}, {PRED}, {_observed(_AFTER)}, o as (select *, case when predicted and observed then 'hit' when observed then 'miss' when predicted then 'false_alarm' else 'correct_negative' end as outcome from seen), r as (select *, (row_number() over (partition by station, outcome order by t, event_id))::int as rank from o) select station, outcome, rank, event_id from r where rank <= 3")
def curated_subset(spark, sf_dir):
    return verify.curated(_judged(spark, sf_dir), 3)


@query(f"with {PRED}, {OBS}, s as (select station, obs, sum(rain_mm) as mm from obs group by all) select event_id, station, t, (select arg_max(mm, obs) from s where s.station = p.station and s.obs <= p.t) as last_mm from pred p")
def latest_observation(spark, sf_dir):
    """The latest observation of its station at or before each prediction (as-of join)."""
    s = tables.observations(spark, sf_dir).groupBy("station", "obs").agg(F.sum("rain_mm").alias("last_mm"))
    out = scans.as_of(tables.predictions(spark, sf_dir), s, "station", "t", "obs", "last_mm")
    return out.select("event_id", "station", "t", "last_mm")
