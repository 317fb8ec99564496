"""Queries over all windows of a replay, their truth, settings and gates, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.operators import arrival, filters, tracking, verify
from pluvio.plans import detect, replay, scalar_queries
from pluvio.plans.oracle import ARRIVALS, D, KM, PIXELS, PX, TRACKS, sql
from pluvio.plans.pixel_queries import KEYS, LAST, _places, _r
from pluvio.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Windows of four frames, as a session of the tables has eight; three frames are the lookahead.
LENGTH, FIRST = 4, 3
AHEAD = D.lookahead_s // D.frame_s
RADII = (15.0, 10.0, 7.5, 5.0, 2.5)


def query(twin: str | None = None) -> Callable:
    """Registers a query under its function's name, with its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


def arrivals_within(km: float) -> str:
    """The twin's arrivals with another radius."""
    px = km / KM
    text = ARRIVALS.replace(repr(PX), repr(px)).replace(f"last_km - {D.proximity_km}", f"last_km - {km}")
    return text.replace(f"abs(r-loc_row) <= {int(PX)} and abs(c-loc_col) <= {int(PX)}", f"abs(r-loc_row) <= {int(px)} and abs(c-loc_col) <= {int(px)}")


# In the twin a window is a session of its own, whose last frame is 7.
_ENDS = f"range({FIRST}, {LAST + 1}) w(e)"
_WINDOWED = PIXELS.replace("pixels as (select", "every_pixel as (select") + f""",
pixels as (select session_id*16+e as session_id, frame_idx-e+7 as frame_idx, r, c, inten from every_pixel, {_ENDS} where frame_idx between e-{LENGTH - 1} and e)"""
_SESSIONS = "sessions as (select session_id, count(distinct frame_idx) as n_frames from pixels group by all)"
_EVERY_END = f"sessions as (select s.session_id*16+e as session_id, (select count(distinct frame_idx) from pixels p where p.session_id = s.session_id*16+e) as n_frames from (select distinct session_id from every_pixel) s, {_ENDS})"
_REPLAYED = sql("cmtla", f""", later as (select session_id*16+e as session_id, location_id, (min(frame_idx)-e)*{float(D.frame_s)} as actual_s from every_pixel join places on abs(r-loc_row) <= {int(PX)} and abs(c-loc_col) <= {int(PX)}, {_ENDS}
  where frame_idx between e+1 and e+{AHEAD} and inten >= {D.intensity} group by session_id, location_id, e),
replayed as (select session_id//16 as session_id, session_id%16 as end_frame, location_id, n_frames, rain_expected, round(arrival_s,6) arrival_s, round(max_intensity,6) max_intensity, rain_at_location, n_cells, confidence, actual_s
  from detections join sessions using (session_id) left join later using (session_id, location_id))
""").replace("with recursive", "with recursive" + _WINDOWED + ",", 1).replace(_SESSIONS, _EVERY_END)
_SCORED = f"scored as (select *, rain_expected as predicted, actual_s is not null as observed from replayed where n_frames = {LENGTH} and end_frame + {AHEAD} <= {LAST})"
_COUNTS = "count(*) filter (where predicted and observed) as hits, count(*) filter (where not predicted and observed) as misses, count(*) filter (where predicted and not observed) as false_alarms, count(*) filter (where not predicted and not observed) as correct_negatives"


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = tables.pixels(spark, sf_dir)
    return replay.replay(pixels, _places(spark, sf_dir), replay.windows(pixels, LENGTH, FIRST, LAST), D, LENGTH)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.scorable(replayed(spark, sf_dir), LENGTH, LAST, AHEAD)


@query(_REPLAYED + "select * exclude (end_frame), end_frame::bigint as end_frame from replayed")
def replay_windows(spark, sf_dir):
    """What would have been reported at the end of every window, and when it rained after."""
    out = replayed(spark, sf_dir)
    return out.select("session_id", "end_frame", "location_id", "n_frames", "rain_expected", *_r("arrival_s", "max_intensity"), "rain_at_location", "n_cells", "confidence", "actual_s")


@query(_REPLAYED + f""", {_SCORED}, c as (select location_id, {_COUNTS} from scored group by rollup(location_id))
select *, round(hits/nullif(hits+misses,0),6) as pod, round(false_alarms/nullif(hits+false_alarms,0),6) as far, round(hits/nullif(hits+misses+false_alarms,0),6) as csi, round((hits+false_alarms)/nullif(hits+misses,0),6) as bias from c""")
def replay_scores(spark, sf_dir):
    """Scores of complete windows whose lookahead is there, by place and of all places."""
    card = verify.scorecard(_scored(spark, sf_dir), "location_id")
    return card.select("location_id", "hits", "misses", "false_alarms", "correct_negatives", *_r("pod", "far", "csi", "bias"))


@query(_REPLAYED + f", {_SCORED} select location_id, count(*) as n, round(avg((arrival_s-actual_s)/60.0),6) as mean_error_min from scored where predicted and observed group by all")
def replay_lead_time(spark, sf_dir):
    """Predicted less actual arrival of the hits: negative where rain was expected too early."""
    return verify.arrival_error(_scored(spark, sf_dir), "location_id").select("location_id", "n", *_r("mean_error_min"))


@query(_REPLAYED + f", {_SCORED} select case when arrival_s/60.0 <= 0 then 'overhead' when arrival_s/60.0 < 10 then 'imminent' when arrival_s/60.0 <= 25 then 'near' when arrival_s/60.0 < 30 then 'between' else 'far' end as kind, count(*) as n from scored where predicted and not observed group by all")
def false_alarm_taxonomy(spark, sf_dir):
    """False alarms of the replay by the arrival that they predicted."""
    wrong = _scored(spark, sf_dir).filter("predicted and not observed")
    return wrong.groupBy(verify.alarm_kind(F.col("arrival_s") / 60.0).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(_REPLAYED + f", {_SCORED} select case when arrival_s <= 0 then 'overhead' when arrival_s <= 1500 then 'soon' else 'later' end as bucket, count(*) as n from scored where predicted and not observed group by all")
def false_alarms_by_arrival(spark, sf_dir):
    wrong = _scored(spark, sf_dir).filter("predicted and not observed")
    bucket = F.when(F.col("arrival_s") <= 0, "overhead").when(F.col("arrival_s") <= 1500, "soon").otherwise("later")
    return wrong.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["lead_time_error"], SQL["lead_time_error"] = QUERIES["replay_lead_time"], SQL["replay_lead_time"]


def _truth(km: float) -> str:
    reach = int(km / KM)
    return f"""select s.session_id, w.e::bigint as end_frame, p.location_id, (select min(frame_idx) from pixels x where x.session_id = s.session_id and frame_idx between e+1 and e+{AHEAD} and inten >= {D.intensity} and abs(r-loc_row) <= {reach} and abs(c-loc_col) <= {reach}) - w.e as wait
  from (select distinct session_id from pixels) s, range(0, {LAST}) w(e), places p"""


def _waits(spark: SparkSession, sf_dir: str, variants: DataFrame | None = None) -> DataFrame:
    """Per window end, place and variant: frames until the first rain within the lookahead (null: none)."""
    pixels = tables.pixels(spark, sf_dir)
    where = replay.spots(_places(spark, sf_dir), D, variants)
    rain = arrival.rain_by_frame(filters.threshold(pixels, D.intensity), where, D)
    keys = ["session_id", "end_frame", "variant", "location_id"]
    seen = rain.select("session_id", "variant", "location_id", "frame_idx", F.explode(F.sequence(F.col("frame_idx") - AHEAD, F.col("frame_idx") - 1)).alias("end_frame"))
    first = seen.groupBy(*keys).agg(F.min(F.col("frame_idx") - F.col("end_frame")).alias("wait"))
    ends = pixels.select("session_id").distinct().withColumn("end_frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LAST - 1).cast("long"))))
    return ends.crossJoin(where.select("variant", "proximity_km", "location_id")).join(first, keys, "left")  # the configured places of a run


@query(sql("pl", f"select session_id, end_frame, location_id, wait is not null as rain, (wait*{D.frame_s})::double as actual_s from ({_truth(D.proximity_km)})"))
def radar_truth_verifier(spark, sf_dir):
    """Whether and when a pixel with rain comes within proximity of a place in the lookahead of every frame."""
    w = _waits(spark, sf_dir)
    return w.select("session_id", "end_frame", "location_id", F.col("wait").isNotNull().alias("rain"), (F.col("wait") * D.frame_s).cast("double").alias("actual_s"))


@query(sql("pl", " union all ".join(f"select {k}::double as radius_km, count(wait) as n_rain, round(avg(wait),6) as mean_wait, count(*) as n from ({_truth(k)})" for k in RADII)))
def proximity_sweep(spark, sf_dir):
    """The truth at five radii, from one pass over the pixels."""
    w = _waits(spark, sf_dir, _variants(spark))
    return w.groupBy(F.col("proximity_km").alias("radius_km")).agg(F.count("wait").alias("n_rain"), F.round(F.avg("wait"), 6).alias("mean_wait"), F.count(F.lit(1)).alias("n"))


def _variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, D.lookahead_s) for i, k in enumerate(RADII)], "variant int, proximity_km double, lookahead_s int")


_SWEEP = "select {0}::double as radius_km, session_id, location_id, rain_expected, round(arrival_s,6) arrival_s, round(max_intensity,6) max_intensity, rain_at_location, n_cells from (with recursive {1} select * from detections)"


@query(sql("pcmtl", " union all ".join(_SWEEP.format(k, arrivals_within(k)) for k in RADII)))
def detection_sweep(spark, sf_dir):
    """Detection at five radii from one analysis: the radius moves proximity, reach and what rain at a place is."""
    pixels = tables.pixels(spark, sf_dir)
    out = replay.replay(pixels, _places(spark, sf_dir), replay.windows(pixels, tables.FRAMES, LAST, LAST), D, tables.FRAMES, variants=_variants(spark))
    radius = out.join(F.broadcast(_variants(spark).select("variant", F.col("proximity_km").alias("radius_km"))), "variant")  # five rows
    return radius.select("radius_km", "session_id", "location_id", "rain_expected", *_r("arrival_s", "max_intensity"), "rain_at_location", "n_cells")


# Estimates of the arrival of all gated tracks at all places, of the window that is a whole session


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = tables.pixels(spark, sf_dir)
    where = replay.spots(_places(spark, sf_dir), D)
    return replay.estimates(detect.analyse(pixels, D), where, D, tables.FRAMES, ends=replay.windows(pixels, tables.FRAMES, LAST, LAST), every_edge=True)


def _root(e: DataFrame, *names: str) -> DataFrame:
    return e.select("session_id", F.col("first.frame_idx").alias("root_frame"), F.col("first.label").alias("root_label"), "location_id", *names)


@query(sql("pcmtla", f"select {KEYS}, location_id, round(w04_s,6) w04_s from closing where w04_s is not null"))
def closing_distance(spark, sf_dir):
    return _root(_estimates(spark, sf_dir).filter("w04_s is not null"), *_r("w04_s"))


@query(sql("pcmtla", f"select {KEYS}, location_id, round(w05_s,6) w05_s from edge where w05_s is not null"))
def leading_edge(spark, sf_dir):
    return _root(_estimates(spark, sf_dir).filter("w05_s is not null"), *_r("w05_s"))


# Gates by place and poll

_GATES = f"""{scalar_queries._HOURS},
polls as (select session_id, 1704067200 + session_id*86400 + {LAST}*600 as now from (select distinct session_id from pixels)),
chance as (select session_id, max(pop) as pop from (select *, unnest([now - now%3600, now - now%3600 + 3600]) as hour from polls) left join hours using (hour) where hour between now and now+3600 group by 1),
gates as (select p.session_id, n_nationkey::bigint as location_id, greatest({scalar_queries._POP.format("pop")}, case when {scalar_queries._FRACTION} is null then 1.0 when {scalar_queries._FRACTION} < 0.1 then 3.0 else 1.0 end)::double as multiplier
  from polls p left join chance using (session_id) cross join nation)"""
_ALL_ENDED = TRACKS.replace(f"length >= {D.min_frames} or (", "length >= 1 or (")
_BY_GATE = ARRIVALS.replace("cross join places p),", f"cross join places p join gates m on m.session_id = g.session_id and m.location_id = p.location_id where g.length >= ceil({D.min_frames}*m.multiplier) or (g.length >= {D.bypass_frames} and g.track_peak >= {D.bypass_intensity})),", 1)


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, end_frame, location_id, multiplier: the stricter of what the forecast for the hour after
    a session's last frame and the clouds over a place ask for."""
    sessions = tables.pixels(spark, sf_dir).select("session_id").distinct()
    now = tables.frame_epoch(F.col("session_id"), F.lit(LAST))
    polls = sessions.select("session_id", now.alias("now"), F.timestamp_seconds(now).alias("ts"))
    chance = scalar_queries._multipliers(spark, sf_dir, polls).select("now", F.col("multiplier").alias("_pop"))
    clouds = scalar_queries.QUERIES["cloud_multiplier"](spark, sf_dir).select("location_id", F.col("multiplier").alias("_cloud"))
    met = polls.join(chance, "now", "left").crossJoin(F.broadcast(clouds))  # a row for each place
    return met.select("session_id", F.lit(LAST).cast("long").alias("end_frame"), "location_id", F.greatest(F.coalesce("_pop", F.lit(1.0)), "_cloud").alias("multiplier"))


_DETECTED = "session_id, location_id, rain_expected, round(arrival_s,6) arrival_s, round(max_intensity,6) max_intensity, rain_at_location, n_cells, confidence"


@query(sql("pcm", f",{_ALL_ENDED},{sql('l', '').removeprefix('with recursive')}, {_GATES},{_BY_GATE} select {_DETECTED} from detections"))
def detect_by_forecast(spark, sf_dir):
    """Detection where each place and poll asks for its own number of frames."""
    pixels = tables.pixels(spark, sf_dir)
    ends = replay.windows(pixels, tables.FRAMES, LAST, LAST)
    out = replay.replay(pixels, _places(spark, sf_dir), ends, D, tables.FRAMES, gates(spark, sf_dir))
    return out.select("session_id", "location_id", "rain_expected", *_r("arrival_s", "max_intensity"), "rain_at_location", "n_cells", "confidence")


@query(sql("pcmt", f""", {_GATES}, k as (select s.*, m.location_id, ceil({D.min_frames}*m.multiplier) as need from summary s join gates m using (session_id))
select session_id, location_id, count(*) filter (where length < need) as n_too_short, count(*) filter (where length >= need and last_frame <> {LAST}) as n_ended_early, count(*) filter (where length >= need and last_frame = {LAST}) as n_accepted,
  count(*) filter (where length < need and last_frame = {LAST} and length >= {D.bypass_frames} and track_peak >= {D.bypass_intensity}) as n_bypassed from k group by all"""))
def gate_reasons(spark, sf_dir):
    """Why tracks count for a place or not, by the number of frames that its gate asks for."""
    s = tracking.summary(detect.analyse(tables.pixels(spark, sf_dir), D).entries)
    strong = (F.col("track_peak") >= D.bypass_intensity).alias("strong")
    kinds = s.groupBy("session_id", "length", "last_frame", strong).agg(F.count(F.lit(1)).alias("k"))  # few of a session
    met = kinds.join(gates(spark, sf_dir), "session_id").withColumn("track_peak", F.when(F.col("strong"), D.bypass_intensity).otherwise(0.0))
    told = tracking.diagnosed(met, D, LAST, F.col("multiplier"))

    def n(kept):
        return F.coalesce(F.sum(F.when(kept, F.col("k"))), F.lit(0)).cast("long")

    return told.groupBy("session_id", "location_id").agg(
        n(F.col("reason") == "too_short").alias("n_too_short"), n(F.col("reason") == "ended_early").alias("n_ended_early"),
        n(F.col("status") == "accepted").alias("n_accepted"), n(F.col("accepted_by_bypass")).alias("n_bypassed"))
