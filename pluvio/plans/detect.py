"""Detection: from pixels of some frames to arrivals at places, for all sessions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.config import Detector
from pluvio.operators import arrival, components, filters, qc, tracking
from pluvio.operators.tracking import TRACK
from pluvio.sources.state import stage


@dataclass
class Analysis:
    """Relations that the stages of a detection share."""

    labelled: DataFrame
    entries: DataFrame
    steps: DataFrame


def analyse(pixels: DataFrame, d: Detector, raw: DataFrame | None = None) -> Analysis:
    """Segments, matches and tracks; ``pixels`` are the effective ones. Intensities of the cells are
    those of ``raw``, where given, as confidence decides what is a cell and not how strong it is."""
    labelled = components.label(filters.threshold(pixels, d.intensity))
    if d.min_area > 1:
        labelled = components.label(filters.by_area(labelled, d.min_area).drop("label"))
    if raw is not None:
        measured = raw.select(*qc.PIXEL, F.col("inten").cast("double"))
        labelled = labelled.drop("inten").join(measured, list(qc.PIXEL)).select(*labelled.columns)
    labelled = stage(labelled)  # four branches read it
    entries = stage(tracking.tracks(components.cells(labelled), d.max_match_px))
    return Analysis(labelled, entries, tracking.steps(entries, d.frame_s))


def evaluate(a: Analysis, places: DataFrame, d: Detector, last_frame: int, multiplier: float = 1.0, confidence: DataFrame | None = None) -> DataFrame:
    """Per gated track and place: kind, speed, bearing, arrival in seconds after the last frame
    and contribution. Rows that the rules drop altogether are absent."""
    gated = tracking.gate(tracking.summary(a.entries), d, last_frame, multiplier)
    motion = tracking.velocity(a.steps, d).join(tracking.coherence(a.steps, d.max_angular_variance).select(*TRACK, "coherent"), TRACK)
    if d.accelerate:
        motion = motion.join(tracking.acceleration(a.steps), TRACK)
    known = gated.join(motion, TRACK, "left")
    if confidence is not None:
        mean = components.mean_confidence(a.labelled, confidence).select("session_id", F.col("frame_idx").alias("last_frame"), F.col("label").alias("last_label"), "mean_conf")
        known = known.join(mean, ["session_id", "last_frame", "last_label"], "left")
    else:
        known = known.withColumn("mean_conf", F.lit(1.0))
    placed = arrival.at_places(known, places)
    dr, dc = F.col("row_c") - F.col("loc_row"), F.col("col_c") - F.col("loc_col")
    placed = placed.withColumn("centre_px", F.sqrt(dr * dr + dc * dc)).withColumn("overhead", F.col("centre_px") <= d.proximity_px)
    placed = stage(arrival.projection(placed, d))

    # Only cells that end within reach can arrive by closing in: by their centroid, or at the
    # nearest by the box around their pixels.
    far = d.farthest_km / d.grid.km_per_px + 1e-6
    down = F.greatest(F.col("r_min") - F.col("loc_row"), F.col("loc_row") - F.col("r_max"), F.lit(0))
    across = F.greatest(F.col("c_min") - F.col("loc_col"), F.col("loc_col") - F.col("c_max"), F.lit(0))
    apart = placed.filter(~F.col("overhead"))
    spots = [*TRACK, "location_id", "loc_row", "loc_col"]
    by_centre = apart.filter(F.col("centre_px") <= far).select(*spots)
    by_edge = apart.filter(F.sqrt(down * down + across * across) <= far).select(*spots)
    w04 = arrival.closing_distance(arrival.centroid_trend(a.entries.join(by_centre, TRACK), d), d)
    tracked = a.entries.select(*TRACK, "frame_idx", "label").join(by_edge, TRACK)
    edges = a.labelled.select("session_id", "frame_idx", "label", "r", "c").join(tracked, ["session_id", "frame_idx", "label"])
    w05 = arrival.leading_edge(arrival.edge_trend(edges, d), d)
    every = placed.join(w04, [*TRACK, "location_id"], "left").join(w05, [*TRACK, "location_id"], "left")

    return decided(every, d, [*TRACK, "location_id"])


def decided(every: DataFrame, d: Detector, keys: list[str]) -> DataFrame:
    """The rules over the estimates of each tracked cell and place (overhead, coherent, w04_s, w05_s, w06_s, ...);
    ``keys`` tell the rows apart."""
    fast = F.coalesce(F.col("speed_kmh"), F.lit(0.0)) > d.max_speed_kmh
    eta = (
        F.when(F.col("overhead"), 0.0)
        .when(~F.col("coherent"), F.col("w05_s"))
        .otherwise(F.coalesce("w06_s", "w04_s", "w05_s"))
    )
    dropped = (
        F.when(F.col("overhead"), fast)
        .when(F.col("n_steps").isNull(), True)
        .when(~F.col("coherent"), F.col("w05_s").isNull())
        .otherwise(fast)
    )
    sure = F.col("mean_conf") >= d.min_confidence
    return every.filter(~dropped).select(
        *keys,
        "row_c",
        "col_c",
        F.when(F.col("overhead"), "overhead").otherwise("approaching").alias("kind"),
        F.coalesce("speed_kmh", F.lit(0.0)).alias("speed_kmh"),
        F.coalesce("bearing", F.lit(0.0)).alias("bearing"),
        "mean_conf",
        F.when(sure, eta).alias("arrival_s"),
        F.when(sure & eta.isNotNull(), F.col("last_peak")).alias("contribution"),
    )


def detect(pixels: DataFrame, places: DataFrame, sessions: DataFrame, d: Detector | None = None, frames: int = 8, multiplier: float = 1.0, confidence: DataFrame | None = None) -> DataFrame:
    """One row per (session, place): rain_expected, arrival_s (after the last frame, before it if
    negative), max_intensity, rain_at_location, n_cells, confidence.

    ``sessions`` has session_id and n_frames: sessions without echo have a row too. ``places``:
    location_id, loc_row, loc_col, and session_id if each session has its own."""
    d = d or Detector()
    last = frames - 1
    effective = pixels if confidence is None else qc.effective(pixels, confidence)
    a = analyse(effective.select(*qc.PIXEL, "inten"), d, None if confidence is None else pixels)
    found = evaluate(a, places, d, last, multiplier, confidence)
    if confidence is not None:
        effective = effective.join(confidence.select(*qc.PIXEL, "conf"), list(qc.PIXEL), "left")
    rain = arrival.rain_at_location(effective, places, d, last, confidence is not None)
    return _merged(found, rain, places, sessions, d, last)


def detect_analysed(a: Analysis, places: DataFrame, sessions: DataFrame, d: Detector, frames: int = 8) -> DataFrame:
    """``detect`` from what is known already; rain at a place is that of pixels in cells."""
    found = evaluate(a, places, d, frames - 1)
    return _merged(found, arrival.rain_at_location(a.labelled, places, d, frames - 1), places, sessions, d, frames - 1)


def _merged(found: DataFrame, rain: DataFrame, places: DataFrame, sessions: DataFrame, d: Detector, last: int) -> DataFrame:
    reduced = found.groupBy("session_id", "location_id").agg(F.min("arrival_s").alias("arrival_s"), F.max("contribution").alias("contribution"), F.count(F.lit(1)).alias("n_cells"))
    every = arrival.at_places(sessions, places).drop("loc_row", "loc_col").join(reduced, ["session_id", "location_id"], "left").join(rain, ["session_id", "location_id"], "left")
    return reported(every, d, F.lit(last), ["session_id", "location_id"])


def reported(every: DataFrame, d: Detector, end: Column, keys: list[str]) -> DataFrame:
    """What is reported of each place from the best of its cells and the rain at it (arrival_s, contribution,
    n_cells, rain_frame, rain_intensity) in the n_frames frames up to ``end``."""
    when_rain = (F.col("rain_frame") - end) * float(d.frame_s)
    enough = F.col("n_frames") >= 2
    best = F.when(enough, F.least("arrival_s", when_rain))
    return every.select(
        *keys,
        best.isNotNull().alias("rain_expected"),
        best.alias("arrival_s"),
        F.when(best.isNotNull(), F.greatest(F.coalesce("contribution", F.lit(0.0)), F.coalesce("rain_intensity", F.lit(0.0)))).otherwise(0.0).alias("max_intensity"),
        (enough & F.col("rain_frame").isNotNull()).alias("rain_at_location"),
        F.when(enough, F.coalesce("n_cells", F.lit(0))).otherwise(0).cast("long").alias("n_cells"),
        F.when(F.col("n_frames") < 2, "unavailable").when(F.col("n_frames") < 3, "degraded").otherwise("normal").alias("confidence"),
    )
