"""Queries over pixels, cells, tracks and detections, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvio.config import Detector, Quality
from pluvio.functions.gates import printed
from pluvio.functions.geo import pixel_location
from pluvio.operators import arrival, components, filters, qc, tiled, tracking
from pluvio.operators.tracking import TRACK
from pluvio.plans import detect
from pluvio.plans.oracle import KM, PX, sql
from pluvio.sources import tables
from pluvio.sources.state import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D, Q = Detector(), Quality()
LAST = tables.FRAMES - 1
KEYS = "session_id, root_frame, root_label"


def query(twin: str | None = None) -> Callable:
    """Registers a query under its function's name, with its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


def _r(*names: str) -> list:
    """To six decimal places as the twins round: halves of the millionfold go up, not those of the shortest decimal."""
    return [(F.round(F.col(n) * 1e6) / 1e6).alias(n) for n in names]


def _analysis(spark: SparkSession, sf_dir: str) -> detect.Analysis:
    return detect.analyse(tables.pixels(spark, sf_dir), D)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.locations(spark, sf_dir).withColumnsRenamed({"row": "loc_row", "col": "loc_col"})


def _sessions(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("session_id").agg(F.countDistinct("frame_idx").alias("n_frames"))


@query(sql("p", "select * from pixels"))
def pixel_fixture(spark, sf_dir):
    return tables.pixels(spark, sf_dir)


@query(sql("p", "select session_id, frame_idx, r, c from pixels where inten >= 0.38"))
def threshold_mask(spark, sf_dir):
    return filters.threshold(tables.pixels(spark, sf_dir), 0.38).select("session_id", "frame_idx", "r", "c")


@query(sql("pc", "select session_id, frame_idx, r, c, label from labelled"))
def component_labels(spark, sf_dir):
    return components.label(filters.threshold(tables.pixels(spark, sf_dir))).select("session_id", "frame_idx", "r", "c", "label")


@query(SQL["component_labels"])
def component_labels_tiled(spark, sf_dir):
    """The same, as of a raster that no task can hold: labelled by tiles and merged over their borders."""
    return tiled.label(filters.threshold(tables.pixels(spark, sf_dir)), 16, 24).select("session_id", "frame_idx", "r", "c", "label")


@query(sql("pc", "select session_id, frame_idx, r, c from labelled join cells using (session_id, frame_idx, label) where area >= 4"))
def area_filter(spark, sf_dir):
    labelled = components.label(filters.threshold(tables.pixels(spark, sf_dir)))
    return filters.by_area(labelled, 4).select("session_id", "frame_idx", "r", "c")


@query(sql("p", f"select session_id, r, c, count(distinct frame_idx) as n from pixels group by all having count(distinct frame_idx) >= 2 and max(frame_idx) = {LAST}"))
def temporal_persistence_filter(spark, sf_dir):
    return filters.persistent(tables.pixels(spark, sf_dir), LAST, 2)


@query(sql("pc", "select session_id, frame_idx, r, c from labelled join cells using (session_id, frame_idx, label) where area >= 9 union select session_id, frame_idx, r, c from pixels where inten >= 0.88"))
def mask_union(spark, sf_dir):
    pixels = tables.pixels(spark, sf_dir)
    large = filters.by_area(components.label(filters.threshold(pixels)), 9).select("session_id", "frame_idx", "r", "c")
    return large.union(filters.threshold(pixels, 0.88).select("session_id", "frame_idx", "r", "c")).distinct()


@query(sql("pc", "select session_id, frame_idx, label, round(row_c,6) row_c, round(col_c,6) col_c, area, peak from cells"))
def cell_centroids(spark, sf_dir):
    c = components.cells(components.label(filters.threshold(tables.pixels(spark, sf_dir))))
    return c.select("session_id", "frame_idx", "label", *_r("row_c", "col_c"), "area", "peak")


_TEMPORAL = f"seen as (select *, least(count(*) over (partition by session_id, r, c order by frame_idx rows unbounded preceding) / {float(Q.temporal_frames)}, 1.0) as temporal from pixels where inten > {Q.echo})"


@query(sql("pc", f", {_TEMPORAL} select session_id, frame_idx, label, round(avg(temporal),6) as mean_conf, max(l.inten) as peak, count(*) as area from labelled l join seen using (session_id, frame_idx, r, c) group by all"))
def cell_zonal_stats(spark, sf_dir):
    pixels = tables.pixels(spark, sf_dir)
    conf = qc.temporal(pixels).withColumnRenamed("temporal", "conf")
    m = components.mean_confidence(components.label(filters.threshold(pixels)), conf)
    return m.select("session_id", "frame_idx", "label", *_r("mean_conf"), "peak", "area")


@query(sql("pcm", "select session_id, frame_idx, l0, l1, round(d2,6) as d2 from matches"))
def match_cells(spark, sf_dir):
    c = components.cells(components.label(filters.threshold(tables.pixels(spark, sf_dir))))
    return tracking.match(c, D.max_match_px).select("session_id", "frame_idx", "l0", "l1", *_r("d2"))


@query(sql("pcmt", "select session_id, frame_idx, label, root_frame, root_label from entries"))
def tracks(spark, sf_dir):
    return _analysis(spark, sf_dir).entries.select("session_id", "frame_idx", "label", "root_frame", "root_label")


@query(sql("pcmt", f"select {KEYS}, length, last_frame, track_peak, first_peak, last_peak from summary"))
def track_peak(spark, sf_dir):
    return tracking.summary(_analysis(spark, sf_dir).entries).select(*TRACK, "length", "last_frame", "track_peak", "first_peak", "last_peak")


@query(sql("pcmt", f"select {KEYS}, round(vy,6) vy, round(vx,6) vx, n_steps, round(speed_kmh,6) speed_kmh, round(bearing,6) bearing from velocity"))
def track_velocity(spark, sf_dir):
    return tracking.velocity(_analysis(spark, sf_dir).steps, D).select(*TRACK, *_r("vy", "vx"), "n_steps", *_r("speed_kmh", "bearing"))


@query(sql("pcmt", f"select {KEYS}, round(speed_kmh,6) speed_kmh, speed_kmh > {D.max_speed_kmh} as too_fast from velocity"))
def speed_cap(spark, sf_dir):
    v = tracking.velocity(_analysis(spark, sf_dir).steps, D)
    return v.select(*TRACK, *_r("speed_kmh"), (F.col("speed_kmh") > D.max_speed_kmh).alias("too_fast"))


@query(sql("pcmt", f""", turns as (select *, (lead(vy) over w - vy) / lead(dt) over w as ay, (lead(vx) over w - vx) / lead(dt) over w as ax from steps window w as (partition by {KEYS} order by frame_idx))
select {KEYS}, round(coalesce(avg(ay),0)*1e6,6) as ay_micro, round(coalesce(avg(ax),0)*1e6,6) as ax_micro from turns group by all"""))
def track_acceleration(spark, sf_dir):
    a = tracking.acceleration(_analysis(spark, sf_dir).steps)
    return a.select(*TRACK, F.round(F.col("ay") * 1e6, 6).alias("ay_micro"), F.round(F.col("ax") * 1e6, 6).alias("ax_micro"))


@query(sql("pcmt", f"select {KEYS}, n_moving, round(variance,6) variance, coherent from coherence"))
def direction_coherence(spark, sf_dir):
    return tracking.coherence(_analysis(spark, sf_dir).steps).select(*TRACK, "n_moving", *_r("variance"), "coherent")


@query(sql("pcmt", f"select {KEYS}, length, track_peak from summary where last_frame = 7 and (length >= 4 or (length >= {D.bypass_frames} and track_peak >= {D.bypass_intensity}))"))
def track_gate(spark, sf_dir):
    return tracking.gate(tracking.summary(_analysis(spark, sf_dir).entries), D, LAST, 2.0).select(*TRACK, "length", "track_peak")


@query(sql("pcmtla", f"select {KEYS}, location_id, w06_s from projected where n_steps is not null and w06_s is not null"))
def forward_projection(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    gated = tracking.gate(tracking.summary(a.entries), D, LAST).join(tracking.velocity(a.steps, D), TRACK)
    placed = gated.crossJoin(_places(spark, sf_dir))
    return arrival.projection(placed, D).filter("w06_s is not null").select(*TRACK, "location_id", "w06_s")


@query(sql("pcmtla", "select session_id, location_id, rain_frame, rain_intensity from rain"))
def rain_at_location(spark, sf_dir):
    return arrival.rain_at_location(tables.pixels(spark, sf_dir), _places(spark, sf_dir), D, LAST)


_EVALUATED = "round(speed_kmh,6) speed_kmh, round(bearing,6) bearing, round(arrival_s,6) arrival_s"


@query(sql("pcmtla", f"select {KEYS}, location_id, kind, {_EVALUATED} from evaluated"))
def evaluated_cells(spark, sf_dir):
    out = detect.evaluate(_analysis(spark, sf_dir), _places(spark, sf_dir), D, LAST)
    return out.select(*TRACK, "location_id", "kind", *_r("speed_kmh", "bearing", "arrival_s"))


@query(sql("pcmtla", "select session_id, location_id, rain_expected, round(arrival_s,6) arrival_s, round(max_intensity,6) max_intensity, rain_at_location, n_cells, confidence from detections"))
def detections(spark, sf_dir):
    pixels = tables.pixels(spark, sf_dir)
    out = detect.detect(pixels, _places(spark, sf_dir), _sessions(pixels), D)
    return out.select("session_id", "location_id", "rain_expected", *_r("arrival_s", "max_intensity"), "rain_at_location", "n_cells", "confidence")


QUERIES["detect"] = QUERIES.pop("detections")
SQL["detect"] = SQL.pop("detections")


@query(sql("pcmtla", "select session_id, min(arrival_s) as earliest_s, arg_min(location_id, arrival_s*1000+location_id) as location_id from detections where arrival_s is not null group by all"))
def earliest_arrival(spark, sf_dir):
    d = QUERIES["detect"](spark, sf_dir).filter("arrival_s is not null")
    first = d.groupBy("session_id").agg(F.min(F.struct("arrival_s", "location_id")).alias("m"))
    return first.select("session_id", F.col("m.arrival_s").alias("earliest_s"), F.col("m.location_id").alias("location_id"))


@query(sql("pcmtla", """select session_id, location_id,
  case when confidence='unavailable' then null else rain_expected end as imminent, case when confidence='unavailable' then null else rain_at_location end as raining_now,
  floor(1704067200 + session_id*86400 + 7*600 + round(arrival_s,6))::bigint as arrival_epoch,
  case when max_intensity<=0 then 'none' when max_intensity<=0.2 then 'light' when max_intensity<=0.45 then 'moderate' when max_intensity<=0.75 then 'heavy' else 'extreme' end as intensity,
  confidence <> 'unavailable' as available from detections"""))
def sensor_states(spark, sf_dir):
    from pluvio.functions.gates import intensity_label

    d = QUERIES["detect"](spark, sf_dir)
    on = F.col("confidence") != "unavailable"
    when = F.floor(tables.frame_epoch(F.col("session_id"), F.lit(LAST)) + F.col("arrival_s"))
    return d.select("session_id", "location_id", F.when(on, F.col("rain_expected")).alias("imminent"), F.when(on, F.col("rain_at_location")).alias("raining_now"), when.alias("arrival_epoch"), intensity_label(F.col("max_intensity")).alias("intensity"), on.alias("available"))


@query(sql("pcmtla", "select location_id, max(case when arrival_s = 0 then 1704067200 + session_id*86400 + 7*600 end)::bigint as last_rain_epoch from detections group by all"))
def last_rain_state(spark, sf_dir):
    d = QUERIES["detect"](spark, sf_dir)
    return d.groupBy("location_id").agg(F.max(F.when(F.col("arrival_s") == 0, tables.frame_epoch(F.col("session_id"), F.lit(LAST)))).alias("last_rain_epoch"))


@query(sql("pcmt", f"""select {KEYS}, case when length < {D.min_frames} then 'dropped' when last_frame <> 7 then 'dropped' else 'accepted' end as status,
  case when length < {D.min_frames} then 'too_short' when last_frame <> 7 then 'ended_early' end as reason, last_frame = 7 and length < {D.min_frames} and length >= {D.bypass_frames} and track_peak >= {D.bypass_intensity} as accepted_by_bypass,
  round(speed_kmh,6) speed_kmh, first_peak, last_peak from summary left join velocity using ({KEYS})"""))
def track_diagnostics(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    s = tracking.summary(a.entries).join(tracking.velocity(a.steps, D).select(*TRACK, "speed_kmh"), TRACK, "left")
    return tracking.diagnosed(s, D, LAST).select(*TRACK, "status", "reason", "accepted_by_bypass", *_r("speed_kmh"), "first_peak", "last_peak")


# Quality control

_MIRROR = "case when {0} < 0 then -({0})-1 when {0} >= 64 then 127-({0}) else {0} end"
_TEXTURE = f"""focal as (select e.session_id, e.frame_idx, e.r, e.c, sum(coalesce(p.inten,0))/25.0 as m, sum(coalesce(p.inten*p.inten,0))/25.0 as s
  from pixels e cross join range(-2,3) a(i) cross join range(-2,3) b(j) left join pixels p on p.session_id = e.session_id and p.frame_idx = e.frame_idx
    and p.r = {_MIRROR.format("e.r+i")} and p.c = {_MIRROR.format("e.c+j")} group by all),
texture as (select session_id, frame_idx, r, c, 1 - least(greatest((sqrt(greatest(s-m*m,0))-{Q.texture_low})/({Q.texture_high}-{Q.texture_low}),0),1) as texture from focal)"""
_UPDATES = (1 - Q.decay**8) / (1 - Q.decay)
_CLUTTER = f"clutter as (select session_id, r, c, sum(pow({Q.decay}, 7-frame_idx)) as echo_count, {_UPDATES!r}::double as update_count, least(greatest(sum(pow({Q.decay}, 7-frame_idx))/{_UPDATES!r},0),1) as freq from pixels where inten > {Q.echo} group by all)"
_M = min(1.0, _UPDATES / Q.mature_updates)
_MOVED = Q.clutter_weight * (1 - _M)
_WT = Q.texture_weight + _MOVED * Q.texture_weight / (Q.texture_weight + Q.temporal_weight)
_WP = Q.temporal_weight + _MOVED * Q.temporal_weight / (Q.texture_weight + Q.temporal_weight)
_WC = Q.clutter_weight * _M
_PENALTY = 1.0 - 0.08 * (1.0 - _M * 2)
_CONF = f"""{_TEXTURE}, {_TEMPORAL}, {_CLUTTER},
conf as (select p.session_id, p.frame_idx, p.r, p.c, p.inten, ({_WT!r}*coalesce(texture,0) + {_WP!r}*coalesce(temporal,0) + {_WC!r}*(case when p.inten > 0 then 1-coalesce(freq,0) else 0 end)) / ({_WT!r}+{_WP!r}+{_WC!r}) * {_PENALTY!r} as conf
  from pixels p left join texture using (session_id, frame_idx, r, c) left join seen using (session_id, frame_idx, r, c) left join clutter using (session_id, r, c))"""


def sql_qc(parts: str, body: str) -> str:
    """Twins over cells of effective pixels."""
    return sql("p", f", {_CONF}, " + sql("C" + parts, body).removeprefix("with recursive"))


@query(sql("p", f", {_TEXTURE} select session_id, frame_idx, r, c, round(texture,6) as texture from texture"))
def qc_texture(spark, sf_dir):
    return qc.texture(tables.pixels(spark, sf_dir)).select("session_id", "frame_idx", "r", "c", *_r("texture"))


@query(sql("p", f", {_TEXTURE} select session_id, frame_idx, r, c, round(texture,6) as texture from texture"))
def qc_texture_tiled(spark, sf_dir):
    """The same in tiles of 16 x 16 pixels with the margins of their neighbours."""
    return qc.texture(tables.pixels(spark, sf_dir), side=16).select("session_id", "frame_idx", "r", "c", *_r("texture"))


@query(sql("p", f", {_TEMPORAL} select session_id, frame_idx, r, c, round(temporal,6) as temporal from seen"))
def qc_temporal(spark, sf_dir):
    return qc.temporal(tables.pixels(spark, sf_dir)).select("session_id", "frame_idx", "r", "c", *_r("temporal"))


@query(sql("p", f", {_CLUTTER} select session_id, r, c, round(echo_count,6) echo_count, round(update_count,6) update_count, round(freq,6) freq from clutter"))
def clutter_state(spark, sf_dir):
    return qc.clutter_state(tables.pixels(spark, sf_dir), tables.FRAMES).select("session_id", "r", "c", *_r("echo_count", "update_count", "freq"))


@query(sql("p", f", {_CONF} select session_id, frame_idx, r, c, round(conf,6) as conf from conf"))
def qc_confidence(spark, sf_dir):
    return qc.confidence(tables.pixels(spark, sf_dir), tables.FRAMES).select("session_id", "frame_idx", "r", "c", *_r("conf"))


_MATURITIES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _mature(m: float) -> str:
    """The twin's confidence under a clutter statistic of some maturity."""
    moved, w = Q.clutter_weight * (1 - m), Q.texture_weight + Q.temporal_weight
    wt, wp, wc = Q.texture_weight + moved * Q.texture_weight / w, Q.temporal_weight + moved * Q.temporal_weight / w, Q.clutter_weight * m
    penalty = 1.0 if m >= 0.5 else 1.0 - 0.08 * (1.0 - m * 2)
    return f"""select {m}::double as maturity, p.session_id, p.frame_idx, ({wt!r}*coalesce(texture,0) + {wp!r}*coalesce(temporal,0) + {wc!r}*(case when p.inten > 0 then 1-coalesce(freq,0) else 0 end)) / ({wt!r}+{wp!r}+{wc!r}) * {penalty!r} as conf
  from pixels p left join texture using (session_id, frame_idx, r, c) left join seen using (session_id, frame_idx, r, c) left join clutter using (session_id, r, c)"""


@query(sql("p", f", {_TEXTURE}, {_TEMPORAL}, {_CLUTTER}, every as ({' union all '.join(map(_mature, _MATURITIES))}) select maturity, session_id, frame_idx, count(*) as n, round(avg(conf),6) as mean_conf, round(min(conf),6) as min_conf, round(max(conf),6) as max_conf from every group by all"))
def qc_maturity(spark, sf_dir):
    """Confidence of each frame while the clutter statistic grows up: its weight comes, the penalty of youth goes."""
    known = qc.factors(tables.pixels(spark, sf_dir), tables.FRAMES, Q)
    each = [F.struct(F.lit(m).alias("maturity"), qc.combined(Q, m).alias("conf")) for m in _MATURITIES]
    out = known.select("session_id", "frame_idx", F.explode(F.array(*each)).alias("x")).select("session_id", "frame_idx", "x.*")
    return out.groupBy("maturity", "session_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(F.min("conf"), 6).alias("min_conf"), F.round(F.max("conf"), 6).alias("max_conf"))


@query(sql("p", f", {_CONF} select frame_idx, count(*) as n, round(avg(conf),6) as mean_conf, round(min(conf),6) as min_conf, round(max(conf),6) as max_conf from conf group by all"))
def qc_per_frame(spark, sf_dir):
    c = qc.confidence(tables.pixels(spark, sf_dir), tables.FRAMES)
    return c.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(F.min("conf"), 6).alias("min_conf"), F.round(F.max("conf"), 6).alias("max_conf"))


@query(sql("p", f", {_CONF} select session_id, frame_idx, r, c, round(inten*conf,6) as inten from conf"))
def effective_grid(spark, sf_dir):
    pixels = tables.pixels(spark, sf_dir)
    return qc.effective(pixels, qc.confidence(pixels, tables.FRAMES)).select("session_id", "frame_idx", "r", "c", *_r("inten"))


_REFINED = """, tracked as (select g.session_id, last_label as label, speed_kmh, mean_conf as cell_conf from gated g left join velocity using (session_id, root_frame, root_label) join cells c on c.session_id = g.session_id and c.frame_idx = g.last_frame and c.label = g.last_label),
refined as (select f.session_id, f.frame_idx, f.r, f.c, least(greatest((1.0*f.conf + 0.15*(case when speed_kmh is null then 0.5 when speed_kmh < 3 then 0.2 when speed_kmh > 130 then 0.1 else 1.0 end)
  + 0.1*(case when cell_conf is null then 0.5 when cell_conf >= 0.4 then 1.0 else 0.3 end))/1.25,0),1) as refined
  from conf f left join labelled l using (session_id, frame_idx, r, c) left join tracked using (session_id, label) where f.frame_idx = 7)"""


def _refined(spark, sf_dir):
    pixels = tables.pixels(spark, sf_dir)
    conf = stage(qc.confidence(pixels, tables.FRAMES))
    a = detect.analyse(qc.effective(pixels, conf), D, pixels)
    gated = tracking.gate(tracking.summary(a.entries), D, LAST)
    v = tracking.velocity(a.steps, D).select(*TRACK, "speed_kmh")
    last = a.labelled.filter(F.col("frame_idx") == LAST)
    mean = components.mean_confidence(last, conf).select("session_id", "label", F.col("mean_conf").alias("cell_conf"))
    cells = gated.join(v, TRACK, "left").select("session_id", F.col("last_label").alias("label"), "speed_kmh").join(mean, ["session_id", "label"])
    return qc.refine(last, conf.filter(F.col("frame_idx") == LAST), cells)


@query(sql_qc("mt", f"{_REFINED} select session_id, frame_idx, r, c, round(refined,6) as refined from refined"))
def qc_refine(spark, sf_dir):
    return _refined(spark, sf_dir).select("session_id", "frame_idx", "r", "c", *_r("refined"))


@query(sql_qc("mt", f"{_REFINED} select session_id, count(*) as n, round(avg(refined),6) as mean_refined from refined group by all"))
def qc_last_frame_refine(spark, sf_dir):
    return _refined(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("refined"), 6).alias("mean_refined"))


@query(sql("p", f", {_CONF} select session_id, count(*) as n_echo, max(inten) as max_inten, round(avg(inten),6) as mean_inten, round(avg(conf),6) as mean_conf, round(min(conf),6) as min_conf, round(max(conf),6) as max_conf, round(avg(pow(conf,3)),6) as cubed_conf from conf where frame_idx = 7 group by all"))
def report_stats(spark, sf_dir):
    c = qc.confidence(tables.pixels(spark, sf_dir), tables.FRAMES).filter(F.col("frame_idx") == LAST)
    return c.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_echo"), F.max("inten").alias("max_inten"), F.round(F.avg("inten"), 6).alias("mean_inten"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(F.min("conf"), 6).alias("min_conf"), F.round(F.max("conf"), 6).alias("max_conf"), F.round(F.avg(F.pow("conf", F.lit(3))), 6).alias("cubed_conf"))


@query(sql_qc("mt", f"{_REFINED}, echo as (select session_id, count(*) as n, sum(refined) as s from refined group by all) select session_id, 4096 - n as n_background, round((s + (4096 - n) * 0.1) / 4096, 6) as mean_refined from echo"))
def qc_refine_whole_frame(spark, sf_dir):
    """The last frame with its background, whose pixels have no row but all one refined value."""
    size = D.grid.width * D.grid.height
    echo = _refined(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("refined").alias("s"))
    rest = F.lit(size) - F.col("n")
    return echo.select("session_id", rest.alias("n_background"), F.round((F.col("s") + rest * qc.refined_background(Q)) / size, 6).alias("mean_refined"))


# Detection under confidence, gates and acceleration

_DETECTED = "select session_id, location_id, rain_expected, round(arrival_s,6) arrival_s, round(max_intensity,6) max_intensity, rain_at_location, n_cells, confidence from detections"


def _detected(spark, sf_dir, d=D, **more):
    pixels = tables.pixels(spark, sf_dir)
    out = detect.detect(pixels, _places(spark, sf_dir), _sessions(pixels), d, **more)
    return out.select("session_id", "location_id", "rain_expected", *_r("arrival_s", "max_intensity"), "rain_at_location", "n_cells", "confidence")


def _confidence(spark, sf_dir):
    return stage(qc.confidence(tables.pixels(spark, sf_dir), tables.FRAMES))


@query(sql_qc("mtlA", _DETECTED))
def detect_qc(spark, sf_dir):
    """Confidence decides what is a cell, drops doubtful cells' arrivals and the doubtful newest frame."""
    return _detected(spark, sf_dir, confidence=_confidence(spark, sf_dir))


@query(sql("pcmTla", _DETECTED))
def detect_gated(spark, sf_dir):
    """A forecast that asks for twice as many frames."""
    return _detected(spark, sf_dir, multiplier=2.0)


@query(sql("pcmtlF", _DETECTED))
def detect_accelerated(spark, sf_dir):
    return _detected(spark, sf_dir, replace(D, accelerate=True))


_B = D.grid.bounds
_LINE = "  #%d: (%.2f, %.2f) speed=%.0fkm/h bearing=%.0f conf=%.2f"


@query(sql_qc("mtlA", f"""select session_id, location_id, number::int as number, printf('{_LINE.replace("%d", "%s")}', number::varchar, lat, lon, speed_kmh, bearing, mean_conf) as line from (
  select v.session_id, location_id, row_number() over (partition by v.session_id, location_id order by v.root_frame, v.root_label) as number, {_B.lat_max}::double - s.row_c/64.0*({_B.lat_max}::double-({_B.lat_min}::double)) as lat, {_B.lon_min}::double + s.col_c/64.0*({_B.lon_max}::double-{_B.lon_min}::double) as lon,
    round(speed_kmh,6) as speed_kmh, round(bearing,6) as bearing, round(mean_conf,6) as mean_conf from evaluated v join summary s using (session_id, root_frame, root_label))"""))
def report_cells(spark, sf_dir):
    """The lines of a report that name the cells tracked for each place, in the order of their tracks."""
    pixels, conf = tables.pixels(spark, sf_dir), _confidence(spark, sf_dir)
    a = detect.analyse(qc.effective(pixels, conf), D, pixels)
    found = detect.evaluate(a, _places(spark, sf_dir), D, LAST, confidence=conf)
    number = F.row_number().over(Window.partitionBy("session_id", "location_id").orderBy("root_frame", "root_label"))
    lat, lon = pixel_location(F.col("row_c"), F.col("col_c"), D.grid)
    speed, bearing, sure = (F.round(c, 6) for c in ("speed_kmh", "bearing", "mean_conf"))
    values = [printed(x, n) for x, n in ((lat, 2), (lon, 2), (speed, 0), (bearing, 0), (sure, 2))]
    line = F.format_string(_LINE.replace("%.2f", "%s").replace("%.0f", "%s"), number, *values)
    return found.select("session_id", "location_id", number.alias("number"), line.alias("line"))


_OWN_PLACE = "location_id = session_id % 25"


@query(sql_qc("mtlA", f", tracked as (select session_id, row_number() over (partition by session_id order by root_frame, root_label)::int as label, speed_kmh, mean_conf as cell_conf from evaluated where {_OWN_PLACE}),\nrefined as" + _REFINED.partition("refined as")[2] + " select session_id, frame_idx, r, c, round(refined,6) as refined from refined"))
def qc_refine_compat(spark, sf_dir):
    """Refinement with cells mapped to labels by their place in the list; each session has one place of its own."""
    pixels, conf = tables.pixels(spark, sf_dir), _confidence(spark, sf_dir)
    a = detect.analyse(qc.effective(pixels, conf), D, pixels)
    own = pixels.select("session_id").distinct().withColumn("location_id", F.col("session_id") % 25).join(_places(spark, sf_dir), "location_id")
    cells = qc.by_position(detect.evaluate(a, own, D, LAST, confidence=conf)).drop("location_id")
    last = a.labelled.filter(F.col("frame_idx") == LAST)
    return qc.refine(last, conf.filter(F.col("frame_idx") == LAST), cells).select("session_id", "frame_idx", "r", "c", *_r("refined"))


@query(sql_qc("mtlA", "select session_id, location_id, round(max(mean_conf),6) as max_confidence, count(*) as n_cells from evaluated group by all"))
def tracked_confidence(spark, sf_dir):
    """The greatest mean confidence of the cells tracked for a place."""
    pixels, conf = tables.pixels(spark, sf_dir), _confidence(spark, sf_dir)
    a = detect.analyse(qc.effective(pixels, conf), D, pixels)
    out = detect.evaluate(a, _places(spark, sf_dir), D, LAST, confidence=conf)
    return out.groupBy("session_id", "location_id").agg(F.round(F.max("mean_conf"), 6).alias("max_confidence"), F.count(F.lit(1)).alias("n_cells"))


@query(sql("pcmtla", """select session_id, location_id, rain_expected, case when rain_expected then round(arrival_s/60.0,6) end as arrival_minutes, rain_at_location, n_cells = 0 as without_tracks from detections"""))
def decision_diagnostics(spark, sf_dir):
    """What was decided for each place, in minutes after the last frame (before it if negative)."""
    d = QUERIES["detect"](spark, sf_dir)
    minutes = F.when(F.col("rain_expected"), F.round(F.col("arrival_s") / 60.0, 6))
    return d.select("session_id", "location_id", "rain_expected", minutes.alias("arrival_minutes"), "rain_at_location", (F.col("n_cells") == 0).alias("without_tracks"))


@query(sql("pcmt", f"select {KEYS}, string_agg(frame_idx::varchar, ' ' order by frame_idx) as frame_indices, round(any_value(bearing),6) as bearing from entries left join velocity using ({KEYS}) group by all"))
def track_frames(spark, sf_dir):
    """The frames that a track was seen in, and where it heads."""
    a = _analysis(spark, sf_dir)
    seen = a.entries.groupBy(*TRACK).agg(F.concat_ws(" ", F.array_sort(F.collect_list("frame_idx")).cast("array<string>")).alias("frame_indices"))
    return seen.join(tracking.velocity(a.steps, D).select(*TRACK, "bearing"), TRACK, "left").select(*TRACK, "frame_indices", *_r("bearing"))


@query(sql("pcmtla", """select d.session_id, location_id, d.confidence, n_frames as frame_count, session_id%5 <> 0 and d.confidence <> 'unavailable' as available,
  case when session_id%5 <> 0 then 1704067200 + session_id*86400 + 4200 end::bigint as last_success from detections d join sessions using (session_id)"""))
def sensor_attributes(spark, sf_dir):
    """What goes with a sensor's state; it is there while the latest poll succeeded and has a result."""
    n = _sessions(tables.pixels(spark, sf_dir))
    d = QUERIES["detect"](spark, sf_dir).join(n, "session_id")
    polled = F.col("session_id") % 5 != 0
    last = F.when(polled, tables.frame_epoch(F.col("session_id"), F.lit(LAST)))
    return d.select("session_id", "location_id", "confidence", F.col("n_frames").alias("frame_count"), (polled & (F.col("confidence") != "unavailable")).alias("available"), last.alias("last_success"))
