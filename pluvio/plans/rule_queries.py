"""Queries over rules of polling, maps and sensors, and the functions under their SQL names, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.functions import gates, geo, palette, registration
from pluvio.operators import frames, render
from pluvio.plans import scalar_queries
from pluvio.plans.oracle import COLOURS, GEO, NEAREST, sql
from pluvio.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(twin: str | None = None) -> Callable:
    """Registers a query under its function's name, with its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events")


# Polling

_STATUS = "(case event_id%6 when 0 then 200 when 1 then 404 when 2 then 429 when 3 then 500 when 4 then 503 else 499 end)"


@query(f"""select event_id, {_STATUS}::int as status, (event_id%5)::int as attempt, case when ({_STATUS}=429 or {_STATUS}>=500) and event_id%5 < 3 then
  case when {_STATUS}=429 and event_id%4 = 0 then (event_id%90)::double else pow(2.0, event_id%5)::double end end as delay from events""")
def retry_delays(spark, sf_dir):
    """Waits between tries of a request; a server's own wait counts where it is a number."""
    i = F.col("event_id")
    codes = F.array(*[F.lit(x) for x in (200, 404, 429, 500, 503, 499)])
    header = F.when(i % 4 == 0, (i % 90).cast("string")).when(i % 4 == 1, "soon")
    e = _events(spark, sf_dir).select("event_id", F.get(codes, (i % 6).cast("int")).alias("status"), (i % 5).cast("int").alias("attempt"), header.alias("retry_after"))
    return e.select("event_id", "status", "attempt", gates.retry_delay(F.col("status"), F.col("attempt"), F.col("retry_after")).alias("delay"))


@query("select event_id, (event_id%7+1)::int as failures, case when event_id%7 < 4 then (5.0*pow(2, event_id%7))::double end as delay, event_id%7 >= 4 as gives_up from events")
def poll_backoffs(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 7 + 1).cast("int").alias("failures"))
    delay = gates.poll_backoff(F.col("failures"))
    return e.select("event_id", "failures", delay.alias("delay"), delay.isNull().alias("gives_up"))


_POP = "case when {0} is null then 1.0 when {0} < 5 then 3.0 when {0} < 30 then 2.0 else 1.0 end"


@query(f"select event_id, (case when event_id%3 = 0 then {_POP.format('p')} else 1.0 end)::double as multiplier from (select event_id, case when event_id%7 <> 0 then (floor(value)::bigint%101)::double end as p from events)")
def pop_stage(spark, sf_dir):
    """The gate of the forecast where it is switched on; an unknown forecast lets all pass."""
    i = F.col("event_id")
    pop = F.when(i % 7 != 0, (F.floor("value") % 101).cast("double"))
    enabled = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    return _events(spark, sf_dir).select("event_id", gates.gate_if(enabled, gates.pop_multiplier(pop)).alias("multiplier"))


@query(scalar_queries.SQL["cloud_fraction"].replace("with ", "with f as (with ", 1).replace(">= 120", ">= case when p.location_id%2 = 0 then 200 else 120 end") + ") select n_nationkey::bigint as location_id, fraction, (case when n_nationkey%4 <> 0 and fraction < 0.1 then 3.0 else 1.0 end)::double as multiplier from nation left join f on f.location_id = n_nationkey")
def satellite_stage(spark, sf_dir):
    """The gate of the satellite image by the measured share of clouds; a place without image passes."""
    clouds = scalar_queries.bright_share(spark, sf_dir, F.when(F.col("location_id") % 2 == 0, 200.0).otherwise(120.0))
    every = tables.locations(spark, sf_dir).select("location_id").join(clouds, "location_id", "left")
    enabled = F.col("location_id") % 4 != 0
    return every.select("location_id", "fraction", gates.gate_if(enabled, gates.cloud_multiplier(F.col("fraction"))).alias("multiplier"))


# Configuration and sensors


@query("""select event_id, coalesce(value - 150 between -90 and 90, true) as lat_ok, (value*3 - 250 between -180 and 180) as lon_ok, (event_id%70 between 20 and 60) as lookahead_ok, event_id%20 <= 16 as name_ok, event_id%5 <> 0 as style_ok,
  ((case when not value - 150 between -90 and 90 then 1 else 0 end) + (case when not value*3 - 250 between -180 and 180 then 1 else 0 end) + (case when not event_id%70 between 20 and 60 then 1 else 0 end) + (case when event_id%20 > 16 then 1 else 0 end) + (case when event_id%5 = 0 then 1 else 0 end))::int as n_errors from events""")
def config_checks(spark, sf_dir):
    """All five fields, each right in some rows and wrong in others."""
    i, v = F.col("event_id"), F.col("value")
    style = F.when(i % 5 == 0, "unknown").otherwise("voyager")
    errors = gates.config_errors(v - 150, v * 3 - 250, i % 70, F.repeat(F.lit("x"), (i % 20).cast("int")), style)
    e = _events(spark, sf_dir).select("event_id", errors.alias("e"))
    names = (("latitude", "lat_ok"), ("longitude", "lon_ok"), ("lookahead_minutes", "lookahead_ok"), ("location_name", "name_ok"), ("map_style", "style_ok"))
    return e.select("event_id", *[(~F.map_contains_key("e", F.lit(k))).alias(n) for k, n in names], F.size("e").alias("n_errors"))


@query("""select c_custkey, (case when c_custkey%2=0 then c_custkey%90 else 10 end)::double as latitude, (case when c_custkey%3=0 then c_custkey%180 else 20 end)::double as longitude, case when c_custkey%5=0 then 'n'||c_custkey else 'Home' end as location_name,
  (case when c_custkey%7=0 then 45 else 30 end)::int as lookahead_minutes, case when c_custkey%11=0 then 'osm_dark' else 'voyager' end as map_style, c_custkey%13=0 as forecast_enabled, c_custkey%17<>0 as satellite_enabled from customer""")
def config_overlay(spark, sf_dir):
    """All editable options laid over what is stored; an option that isn't given stays."""
    k = F.col("c_custkey")
    stored = F.struct(F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"), F.lit("Home").alias("location_name"), F.lit(30).alias("lookahead_minutes"), F.lit("voyager").alias("map_style"), F.lit(False).alias("forecast_enabled"), F.lit(True).alias("satellite_enabled"))
    values = ((k % 90).cast("double"), (k % 180).cast("double"), F.concat(F.lit("n"), k.cast("string")), F.lit(45), F.lit("osm_dark"), F.lit(True), F.lit(False))
    given = F.struct(*[F.when(k % n == 0, v).alias(name) for n, v, name in zip((2, 3, 5, 7, 11, 13, 17), values, gates.OPTION_KEYS, strict=True)])
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", stored.alias("s"), given.alias("g"))
    return c.select("c_custkey", *[v.alias(n) for n, v in gates.merged_options(F.col("s"), F.col("g")).items()])


@query(f"""with {GEO} select location_id, round(lat,1) as lat, round(lon,1) as lon, case when location_id%3<>0 then strftime(timestamp '2024-01-01 00:00:00' + to_seconds(location_id*3600), '%Y-%m-%d %H:%M:%S') end as arrival_time,
  case when location_id%5<>0 then 'normal' end as confidence, location_id%5=0 as without_detection from geod""")
def diagnostics_document(spark, sf_dir):
    """Coarse coordinates, times as text, and no detection where there was none; the JSON is read back."""
    i = F.col("location_id")
    arrival = F.when(i % 3 != 0, F.date_format(F.timestamp_seconds(F.lit(tables.EPOCH0) + i * 3600), "yyyy-MM-dd HH:mm:ss"))
    detection = F.when(i % 5 != 0, F.struct(F.lit("normal").alias("confidence"), F.lit(8).alias("frame_count")))
    j = F.to_json(F.struct(F.struct(F.round("lat", 1).alias("latitude"), F.round("lon", 1).alias("longitude")).alias("config"), arrival.alias("arrival_time"), detection.alias("detection")))
    back = "config struct<latitude: double, longitude: double>, arrival_time string, detection struct<confidence: string, frame_count: int>"
    d = tables.places(spark, sf_dir).select("location_id", F.from_json(j, back).alias("d"))
    return d.select("location_id", F.col("d.config.latitude").alias("lat"), F.col("d.config.longitude").alias("lon"), "d.arrival_time", "d.detection.confidence", F.col("d.detection").isNull().alias("without_detection"))


_LABEL = "case when {0}<=0 then 'none' when {0}<=0.2 then 'light' when {0}<=0.45 then 'moderate' when {0}<=0.75 then 'heavy' else 'extreme' end"
_ICON = " ".join(f"when '{k}' then '{v}'" for k, v in gates.ICONS.items())


@query(f"""select event_id, case {_LABEL.format('value/400')} {_ICON} end as intensity_icon, case when event_id%3=0 then 'mdi:weather-pouring' else 'mdi:weather-sunny' end as imminent_icon,
  case when event_id%3=0 then 'mdi:clock-alert-outline' else 'mdi:clock-outline' end as arrival_icon from events""")
def sensor_icons(spark, sf_dir):
    on = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    return _events(spark, sf_dir).select(
        "event_id", gates.icon(gates.intensity_label(F.col("value") / 400)).alias("intensity_icon"), gates.sensor_icon("imminent", on).alias("imminent_icon"), gates.sensor_icon("arrival", on).alias("arrival_icon")
    )


# Maps and frames

_MAP_KPP = "(40075.0/(256*pow(2,z))*cos(radians(lat)))"


@query(f"""with {GEO}, tried as (select location_id, lat, lon, z::int as z, abs(2*128/{_MAP_KPP}-640) as off from geod, range(1,19) s(z)), zoomed as (select location_id, any_value(lat) as lat, any_value(lon) as lon, arg_min(z, off*1e6+z) as zoom from tried group by all),
v as (select location_id, zoom, (lon+180.0)/360.0*pow(2,zoom)*256 as px, (1.0-ln(tan(radians(lat))+1.0/cos(radians(lat)))/pi())/2.0*pow(2,zoom)*256 as py, pow(2.0,7-zoom) as k from zoomed)
select location_id, zoom, floor((px-320)*k/256)::int as tx0, floor((px+320)*k/256)::int as tx1, floor((py-320)*k/256)::int as ty0, floor((py+320)*k/256)::int as ty1, round((px-320)*k,6) as left_px, round((py-320)*k,6) as top_px from v""")
def radar_viewport(spark, sf_dir):
    """The map's view in pixels and tiles of the radar's own zoom."""
    p = tables.places(spark, sf_dir).withColumn("zoom", geo.map_zoom(F.col("lat"), F.lit(128)))
    px, py = geo.global_pixel(F.col("lat"), F.col("lon"), F.col("zoom"))
    k = F.pow(F.lit(2.0), F.lit(scalar_queries.ZOOM) - F.col("zoom"))
    v = p.select("location_id", "zoom", *[((c + s * 320) * k).alias(n) for n, c, s in (("x0", px, -1), ("x1", px, 1), ("y0", py, -1), ("y1", py, 1))])
    return v.select("location_id", "zoom", *[F.floor(F.col(c) / 256).cast("int").alias(n) for c, n in (("x0", "tx0"), ("x1", "tx1"), ("y0", "ty0"), ("y1", "ty1"))], F.round("x0", 6).alias("left_px"), F.round("y0", 6).alias("top_px"))


_STYLE = "(array['voyager','osm_standard','osm_dark','dark_matter','esri_imagery'])[(n_nationkey%5)::int+1]"
_URL = "replace(replace(replace({0}, '%1$d', '7'), '%2$d', n_nationkey::varchar), '%3$d', (n_nationkey*2)::varchar)"
_LAYERS = " union all ".join(f"select '{s}' as style, {i}::int as layer, '{u}' as template" for s, urls in gates.TILE_URLS.items() for i, u in enumerate(urls))


@query(f"with layers as ({_LAYERS}) select n_nationkey::bigint as location_id, l.layer, {_URL.format('template')} as url from nation join layers l on l.style = {_STYLE}")
def base_map_urls(spark, sf_dir):
    """Addresses of the layers of a map tile."""
    n = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("location_id"))
    style = gates.known_style(F.get(F.array(*[F.lit(s) for s in gates.STYLES]), (F.col("location_id") % 5).cast("int")))
    urls = gates.tile_urls(style, F.lit(7), F.col("location_id"), F.col("location_id") * 2)
    return n.select("location_id", F.posexplode(urls).alias("layer", "url"))


@query(f"with {NEAREST} select frame_idx, row, col, (case when d2 <= 3600 then r else 0 end)::int as r, (case when d2 <= 3600 then g else 0 end)::int as g, (case when d2 <= 3600 then b else 0 end)::int as b, (case when d2 <= 3600 then least(alpha+40,255) else 0 end)::int as alpha from colours join nearest using (r, g, b)")
def mockup_pixels(spark, sf_dir):
    """Precipitation stands out by its alpha, all else is zero in every channel."""
    near = palette.nearest(F.col("r"), F.col("g"), F.col("b"))["d2"] <= palette.DETECTOR_DISTANCE**2
    kept = {"r": F.col("r"), "g": F.col("g"), "b": F.col("b"), "alpha": F.least(F.col("alpha") + 40, F.lit(255))}
    return tables.colours(spark, sf_dir).select("frame_idx", "row", "col", *[F.when(near, v).otherwise(0).cast("int").alias(n) for n, v in kept.items()])


@query(f"with {COLOURS} select frame_idx, count(*) as n, min(row)::int as first_row, max(row)::int as last_row from colours where r = 252 and g = 255 and b = 85 and alpha > 10 group by all")
def exact_colour_hits(spark, sf_dir):
    c = tables.colours(spark, sf_dir).filter("r = 252 and g = 255 and b = 85 and alpha > 10")
    return c.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


_DARK = """d1 as (select distinct r, g, b, (r*19595+g*38470+b*7471+32768)//65536 as grey from colours),
d2 as (select r, g, b, floor(grey+(r-grey)*0.75)::bigint as x, floor(grey+(g-grey)*0.75)::bigint as y, floor(grey+(b-grey)*0.75)::bigint as z from d1),
d3 as (select *, greatest(x,y,z) as hi, least(x,y,z) as lo, (x*19595+y*38470+z*7471+32768)//65536 as luma from d2),
d4 as (select *, (hi-lo)::double as span, case when hi = lo then 0.0 when x = hi then (y-z)/(hi-lo)::double when y = hi then 2.0+(z-x)/(hi-lo)::double else 4.0+(x-y)/(hi-lo)::double end as turn, greatest(255-hi, 255-luma)::double as v from d3),
d5 as (select r, g, b, v, case when span = 0 then 0.0 else floor(fmod(turn/6.0+1.0, 1.0)*255.0) end*6.0/255.0 as sector, case when span = 0 then 0.0 else floor(span/hi*255.0) end/255.0 as s from d4),
d6 as (select r, g, b, v::int as v, floor(sector)::int%6 as k, floor(v*(1-s)+0.5)::int as p, floor(v*(1-s*(sector-floor(sector)))+0.5)::int as q, floor(v*(1-s*(1-(sector-floor(sector))))+0.5)::int as t from d5)"""


@query(f"with {COLOURS}, {_DARK} select r, g, b, ([v,q,p,p,t,v])[k+1]::int as dark_r, ([t,v,v,q,p,p])[k+1]::int as dark_g, ([p,p,t,v,v,q])[k+1]::int as dark_b from d6")
def dark_map_colours(spark, sf_dir):
    return render.dark_map(tables.colours(spark, sf_dir).select("r", "g", "b").distinct())


_FRAMES = ", f as (select distinct session_id, frame_idx from pixels)"


@query(sql("p", f"{_FRAMES} select session_id, frame_idx, (row_number() over (partition by session_id order by frame_idx))::varchar||'/'||(count(*) over (partition by session_id))::varchar as label, frame_idx = max(frame_idx) over (partition by session_id) as held from f"))
def frame_numbers(spark, sf_dir):
    """Frames of an animation, numbered; the last one is held."""
    f = frames.numbered(tables.pixels(spark, sf_dir).select("session_id", "frame_idx").distinct())
    label = F.concat_ws("/", F.col("number").cast("string"), F.col("n_frames").cast("string"))
    return f.select("session_id", "frame_idx", label.alias("label"), (F.col("number") == F.col("n_frames")).alias("held"))


@query(sql("p", f"{_FRAMES} select f.session_id, f.frame_idx, count(p.r) as n_echo, coalesce(sum(p.inten),0)::double as total from f left join pixels p on p.session_id = f.session_id and p.frame_idx = f.frame_idx and f.session_id%3 <> 0 and f.frame_idx%4 <> 1 group by all").replace("coalesce(sum(p.inten),0)", "round(coalesce(sum(p.inten),0),6)"))
def grid_accessor(spark, sf_dir):
    """Held grids answer only for their own box and shape, else with zeros."""
    pixels = tables.pixels(spark, sf_dir)
    f = pixels.select("session_id", "frame_idx").distinct()
    box = F.struct(F.lit(-35.0).alias("south"), F.lit(150.0).alias("west"))
    other = F.struct(F.lit(-36.0).alias("south"), F.lit(150.0).alias("west"))
    held = f.select("*", box.alias("box"), F.lit(64).alias("height"), F.lit(64).alias("width"))
    asked = f.select("*", F.when(F.col("session_id") % 3 == 0, other).otherwise(box).alias("box"), F.when(F.col("frame_idx") % 4 == 1, 128).otherwise(64).alias("height"), F.lit(64).alias("width"))
    got = frames.same_grid(pixels, held, asked).groupBy("session_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("inten").alias("t"))
    return f.join(got, ["session_id", "frame_idx"], "left").select("session_id", "frame_idx", F.coalesce("n", F.lit(0)).alias("n_echo"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("total"))


# Functions under their SQL names


@query(f"""with {GEO}, {NEAREST}, places as (select location_id, trunc((lon+180.0)/360.0*128)::int as tx, trunc((1.0-ln(tan(radians(lat))+1.0/cos(radians(lat)))/pi())/2.0*128)::int as ty from geod)
select location_id, tx, ty, round(degrees(atan(sinh(pi()*(1.0-2.0*ty/128.0)))),6) as north, ({_POP.format('location_id')})::double as pop_multiplier, (case when location_id/25.0 < 0.1 then 3.0 else 1.0 end)::double as cloud_multiplier, {_LABEL.format('location_id/25.0')} as label,
  round(1-sqrt(pow((sin(0)+sin(location_id/10.0))/2,2)+pow((cos(0)+cos(location_id/10.0))/2,2)),6) as variance, (select round(sum(case when alpha >= 10 and d2 <= 3600 then intensity else 0.0 end),6) from colours join nearest using (r, g, b) where row = location_id) as row_total from places""")
def sql_functions(spark, sf_dir):
    """Plain SQL with the engine's functions."""
    registration.register(spark)
    places, colours = tables.places(spark, sf_dir), tables.colours(spark, sf_dir)
    return spark.sql(
        """with p as (select location_id, pluvio_tile_x(lon, 7) as tx, pluvio_tile_y(lat, 7) as ty from {places}),
        t as (select row, round(sum(pluvio_rain_intensity(r, g, b, alpha)), 6) as row_total from {colours} group by row)
        select location_id, tx, ty, round(pluvio_tile_box(tx, ty, 7).lat_max, 6) as north, pluvio_pop_multiplier(location_id) as pop_multiplier,
          pluvio_cloud_multiplier(location_id / 25.0) as cloud_multiplier, pluvio_intensity_label(location_id / 25.0) as label,
          round(pluvio_circular_variance(array(0D, location_id / 10D)), 6) as variance, row_total from p left join t on row = location_id""",
        places=places,
        colours=colours,
    )
