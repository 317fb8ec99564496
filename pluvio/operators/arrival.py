"""Arrival of tracked cells at places: projection, closing distance and leading edge.

Everything is per (track, place). Places with a ``session_id`` meet the tracks of their session in
an equi-join; without one, those of a configuration, every track meets every place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.config import Detector
from pluvio.operators.tracking import TRACK

PLACED = [*TRACK, "location_id"]


def at_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` of sessions with location_id, loc_row and loc_col of their places."""
    own = ["session_id"] if "session_id" in places.columns else []
    spots = places.select(*own, "location_id", "loc_row", "loc_col")
    return rows.join(spots, own) if own else rows.crossJoin(spots)


def _distance(row: str, col: str) -> Column:
    dr, dc = F.col(row) - F.col("loc_row"), F.col(col) - F.col("loc_col")
    return F.sqrt(dr * dr + dc * dc)


def first_near(d: Detector, proximity_px: Column, lookahead_s: Column) -> Column:
    """The first step of ``step_s`` seconds within the lookahead at which a moving centroid (row_c, col_c, vy, vx; ay, ax
    if the motion accelerates) is within proximity of its place, null if none is.

    On a straight way the steps within proximity follow one another, and the first is where the way enters
    the circle; it and its neighbours are tried, as rounding may move it by one."""
    ay, ax = (F.col("ay"), F.col("ax")) if d.accelerate else (F.lit(0.0), F.lit(0.0))

    def near(t: Column) -> Column:
        dr = F.col("row_c") + F.col("vy") * t + 0.5 * ay * t * t - F.col("loc_row")
        dc = F.col("col_c") + F.col("vx") * t + 0.5 * ax * t * t - F.col("loc_col")
        return F.sqrt(dr * dr + dc * dc) <= proximity_px

    last = F.floor(lookahead_s / d.step_s).cast("int")
    if d.accelerate:
        return F.array_min(F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: k * d.step_s), near)).cast("double")
    r, c = F.col("row_c") - F.col("loc_row"), F.col("col_c") - F.col("loc_col")
    speed2 = F.col("vy") * F.col("vy") + F.col("vx") * F.col("vx")
    along = r * F.col("vy") + c * F.col("vx")
    inside = F.greatest(along * along - speed2 * (r * r + c * c - proximity_px * proximity_px), F.lit(0.0))
    enters = F.when(speed2 > 0, (-along - F.sqrt(inside)) / speed2 / d.step_s).otherwise(0.0)
    step = F.ceil(F.greatest(F.least(enters, last + 2.0), F.lit(-2.0))).cast("int")
    tried = F.sequence(F.least(F.greatest(step - 1, F.lit(0)), last), F.least(F.greatest(step + 1, F.lit(0)), last))
    return F.when(F.col("vy").isNotNull(), F.array_min(F.filter(F.transform(tried, lambda k: k * d.step_s), near))).cast("double")


def projection(motions: DataFrame, d: Detector) -> DataFrame:
    """``motions`` (row_c, col_c, vy, vx, loc_row, loc_col; ay, ax if the motion accelerates) with ``w06_s``."""
    return motions.withColumn("w06_s", first_near(d, F.lit(d.proximity_px), F.lit(d.lookahead_s)))


def centroid_trend(entries: DataFrame, d: Detector) -> DataFrame:
    """Per track and place: distances in km of the first, last but one and last centroid."""
    return _trend(entries.withColumn("dist_km", _distance("row_c", "col_c") * d.grid.km_per_px), d)


def edge_trend(pixels: DataFrame, d: Detector) -> DataFrame:
    """The same of the nearest pixel of each cell; ``pixels`` carry their track and a place."""
    each = pixels.groupBy(*PLACED, "frame_idx").agg(F.min(_distance("r", "c")).alias("_d"))
    return _trend(each.withColumn("dist_km", F.col("_d") * d.grid.km_per_px), d)


def _trend(each: DataFrame, d: Detector) -> DataFrame:
    path = F.array_sort(F.collect_list(F.struct("frame_idx", "dist_km")))
    t = each.groupBy(*PLACED).agg(path.alias("_p"))
    n = F.size("_p")
    return t.select(
        *PLACED,
        n.alias("n"),
        F.col("_p")[0]["dist_km"].alias("first_km"),
        F.when(n > 1, F.col("_p")[F.greatest(n - 2, F.lit(0))]["dist_km"]).alias("before_km"),
        F.col("_p")[n - 1]["dist_km"].alias("last_km"),
        ((F.col("_p")[n - 1]["frame_idx"] - F.col("_p")[0]["frame_idx"]) * d.frame_s).cast("double").alias("duration_s"),
    )


def _eta(ok: Column, least_km: float, d: Detector, proximity_km: Column | float, lookahead_s: Column | int) -> Column:
    closing = F.col("first_km") - F.col("last_km")
    rate = closing / F.nullif(F.col("duration_s"), F.lit(0.0)) * 3600
    left = F.col("last_km") - proximity_km
    eta = left / rate * 3600
    return F.when(ok & (closing >= least_km) & (rate <= d.max_speed_kmh), F.when(left <= 0, 0.0).when(eta <= lookahead_s, eta))


def closing_eta(d: Detector, proximity_km: Column | float | None = None, lookahead_s: Column | int | None = None) -> Column:
    """Seconds until a centroid that closes in arrives, oblique or not; from n, first_km, before_km, last_km, duration_s."""
    ok = ((F.col("n") < 3) | (F.col("last_km") < F.col("before_km"))) & (F.col("duration_s") > 0) & (F.col("first_km") > F.col("last_km"))
    return _eta(ok, d.centroid_min_closing_km, d, d.proximity_km if proximity_km is None else proximity_km, d.lookahead_s if lookahead_s is None else lookahead_s)


def edge_eta(d: Detector, proximity_km: Column | float | None = None, lookahead_s: Column | int | None = None) -> Column:
    """The same of the nearest pixel, closing overall and in the last step."""
    ok = (F.col("n") >= 2) & (F.col("last_km") < F.col("first_km")) & (F.col("last_km") < F.col("before_km"))
    return _eta(ok, d.edge_min_closing_km, d, d.proximity_km if proximity_km is None else proximity_km, d.lookahead_s if lookahead_s is None else lookahead_s)


def closing_distance(trend: DataFrame, d: Detector) -> DataFrame:
    """``w04_s``: arrival from a centroid that closes in."""
    return trend.select(*PLACED, closing_eta(d).alias("w04_s"))


def leading_edge(trend: DataFrame, d: Detector) -> DataFrame:
    """``w05_s``: arrival from the nearest pixel."""
    return trend.select(*PLACED, edge_eta(d).alias("w05_s"))


def squares(places: DataFrame, d: Detector) -> DataFrame:
    """The pixels of the square around each place on the grid; ``places`` may have session_id, variant and
    proximity_km."""
    grid = d.grid
    own = [c for c in ("session_id", "variant") if c in places.columns]
    km = F.col("proximity_km") if "proximity_km" in places.columns else F.lit(d.proximity_km)
    inside = places.filter(F.col("loc_row").between(0, grid.height - 1) & F.col("loc_col").between(0, grid.width - 1))
    reach = F.floor(km / grid.km_per_px).cast("int")
    rows = inside.select(*own, "location_id", "loc_col", reach.alias("_k"), F.explode(F.sequence(F.col("loc_row") - reach, F.col("loc_row") + reach)).alias("r"))
    return rows.select(*own, "location_id", "r", F.explode(F.sequence(F.col("loc_col") - F.col("_k"), F.col("loc_col") + F.col("_k"))).alias("c"))


def rain_by_frame(effective: DataFrame, places: DataFrame, d: Detector, with_confidence: bool = False) -> DataFrame:
    """Per (session, place, frame) with rain in the square around the place the greatest intensity there.
    With confidence, frames whose brightest pixel (the first in raster order) is doubtful have none.
    ``places`` may have proximity_km, and variant to tell apart rows of one place."""
    grid = d.grid
    own = [c for c in ("session_id", "variant") if c in places.columns]
    window = squares(places, d)
    met = effective.join(window, [*(c for c in own if c == "session_id"), "r", "c"])
    raster = F.col("r") * grid.width + F.col("c")
    conf = F.coalesce(F.col("conf"), F.lit(1.0)) if with_confidence else F.lit(1.0)
    keys = ["session_id", *(c for c in own if c != "session_id"), "location_id", "frame_idx"]
    each = met.groupBy(*keys).agg(F.max(F.struct(F.col("inten"), (-raster).alias("p"), conf.alias("conf"))).alias("_m"))
    return each.filter((F.col("_m.inten") >= d.intensity) & (F.col("_m.conf") >= d.min_confidence)).select(*keys, F.col("_m.inten").alias("inten"))


def rain_at_location(effective: DataFrame, places: DataFrame, d: Detector, last_frame: int, with_confidence: bool = False) -> DataFrame:
    """Per (session, place): the newest of the last frames with rain in the square around the
    place, and the greatest intensity there. A doubtful frame gives way to the frame before."""
    recent = effective.filter(F.col("frame_idx") > last_frame - d.recent_frames)
    good = rain_by_frame(recent, places, d, with_confidence)
    newest = good.groupBy("session_id", "location_id").agg(F.max(F.struct("frame_idx", "inten")).alias("_n"))
    return newest.select("session_id", "location_id", F.col("_n.frame_idx").alias("rain_frame"), F.col("_n.inten").alias("rain_intensity"))
