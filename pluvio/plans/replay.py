"""Detection at the end of every window of frames, of many settings at once, from one analysis.

Cells are found once a frame and matched once for each pair of neighbouring frames; the matches make
chains of one cell a frame. The tracks of a window are the chains cut at its first frame, and those
that count have a cell in its last frame. So each cell ends exactly one track that counts, and what
a track is (its length, motion, first and last cells) are sliding windows over the rows of its chain.
Nothing is matched again, and the work grows with the frames, not with the windows times their length.

Places, settings of the arrival rules and gates are relations that join the tracks. Distances of a
cell's pixels to a place don't depend on the window, so they are found once for a cell and a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.config import Detector
from pluvio.operators import arrival, filters
from pluvio.operators.tracking import TRACK
from pluvio.plans import detect
from pluvio.sources.state import stage

SPOT = ["variant", "location_id"]
WINDOW = ["session_id", "end_frame"]


def spots(places: DataFrame, d: Detector, variants: DataFrame | None = None) -> DataFrame:
    """``places`` with each of the settings of a run: variant, proximity_km and lookahead_s."""
    own = [c for c in ("session_id",) if c in places.columns]
    base = places.select(*own, "location_id", "loc_row", "loc_col")
    if variants is None:
        return base.select(F.lit(0).alias("variant"), F.lit(d.proximity_km).alias("proximity_km"), F.lit(d.lookahead_s).alias("lookahead_s"), "*")
    return base.crossJoin(F.broadcast(variants.select("variant", "proximity_km", "lookahead_s")))  # the settings of a run


def ended_tracks(entries: DataFrame, d: Detector, length: int) -> DataFrame:
    """For each cell the track that ends with it in the window of ``length`` frames up to its own."""
    by = Window.partitionBy(*TRACK).orderBy("frame_idx")

    def last(n: int) -> Window:
        return by.rowsBetween(1 - n, 0)

    dt = (F.col("frame_idx") - F.lag("frame_idx").over(by)) * d.frame_s
    step = entries.withColumn("_dt", dt).withColumn("_vy", (F.col("row_c") - F.lag("row_c").over(by)) / dt).withColumn("_vx", (F.col("col_c") - F.lag("col_c").over(by)) / dt)
    moving = (F.abs("_vy") > 1e-9) | (F.abs("_vx") > 1e-9)
    step = step.withColumn("_angle", F.when(moving, F.atan2("_vy", "_vx")))
    step = step.withColumn("_ay", (F.col("_vy") - F.lag("_vy").over(by)) / F.col("_dt")).withColumn("_ax", (F.col("_vx") - F.lag("_vx").over(by)) / F.col("_dt"))
    whole, steps = last(length), last(max(1, length - 1))

    def turned(c: str) -> Column:
        return F.coalesce(F.avg(c).over(last(length - 2)), F.lit(0.0)) if length > 2 else F.lit(0.0)

    first = F.first(F.struct("frame_idx", "label", "row_c", "col_c")).over(whole)
    before = F.lag(F.struct("frame_idx", "label", "row_c", "col_c")).over(by)
    n = F.count("_vy").over(steps)
    sin, cos = F.avg(F.sin("_angle")).over(steps), F.avg(F.cos("_angle")).over(steps)
    n_moving = F.count("_angle").over(steps)
    out = step.select(
        *TRACK, F.col("frame_idx").alias("end_frame"), "label", "row_c", "col_c", "r_min", "r_max", "c_min", "c_max", F.col("peak").alias("last_peak"),
        F.count(F.lit(1)).over(whole).alias("n"), F.max("peak").over(whole).alias("track_peak"), first.alias("first"), before.alias("before"),
        F.when(n > 0, n).alias("n_steps"), F.avg("_vy").over(steps).alias("vy"), F.avg("_vx").over(steps).alias("vx"), turned("_ay").alias("ay"), turned("_ax").alias("ax"),
        n_moving.alias("n_moving"), (1 - F.sqrt(sin * sin + cos * cos)).alias("variance"),
    )
    y, x = F.col("vy") * d.grid.km_per_row, F.col("vx") * d.grid.km_per_col
    bearing = F.when((y == 0) & (x == 0), 180.0).otherwise(F.pmod(F.degrees(F.atan2(x, -y)), F.lit(360.0)))
    coherent = F.when(F.col("n_moving") == 0, False).when(F.col("n_moving") == 1, True).otherwise(F.col("variance") <= d.max_angular_variance)
    out = out.withColumn("before", F.when(F.col("n") > 1, F.col("before")))
    return out.withColumn("speed_kmh", F.sqrt(y * y + x * x) * 3600).withColumn("bearing", bearing).withColumn("coherent", F.when(F.col("n_steps").isNotNull(), coherent))


def _km(row: str, col: str, d: Detector) -> Column:
    dr, dc = F.col(row) - F.col("loc_row"), F.col(col) - F.col("loc_col")
    return F.sqrt(dr * dr + dc * dc) * d.grid.km_per_px


def gated(placed: DataFrame, d: Detector, gates: DataFrame | None) -> DataFrame:
    """Tracks at places that are long enough there and then, or strong and nearly so; ``gates``:
    session_id, end_frame, location_id, multiplier (absent: 1)."""
    if gates is not None:
        placed = placed.join(gates.select(*WINDOW, "location_id", "multiplier"), [*WINDOW, "location_id"], "left")
    else:
        placed = placed.withColumn("multiplier", F.lit(1.0))
    need = F.ceil(d.min_frames * F.coalesce("multiplier", F.lit(1.0)))
    strong = (F.col("n") >= d.bypass_frames) & (F.col("track_peak") >= d.bypass_intensity)
    return placed.withColumn("need", need).filter((F.col("n") >= need) | strong)


def _edges(placed: DataFrame, labelled: DataFrame, d: Detector) -> DataFrame:
    """Distances of the nearest pixel in the first cell, the last but one and the last, of each track and
    spot of ``placed``."""
    keys = [*TRACK, "end_frame", *SPOT]
    ends = [F.struct(F.lit(i).alias("i"), F.col(c + "frame").cast("long").alias("frame_idx"), F.col(c + "label").alias("label")) for i, c in enumerate(("first_", "before_", "last_"))]
    named = placed.select(*keys, "loc_row", "loc_col", F.col("first.frame_idx").alias("first_frame"), F.col("first.label").alias("first_label"), F.col("before.frame_idx").alias("before_frame"), F.col("before.label").alias("before_label"), F.col("end_frame").alias("last_frame"), F.col("label").alias("last_label"))
    each = named.select(*keys, "loc_row", "loc_col", F.explode(F.array(*ends)).alias("e")).select(*keys, "loc_row", "loc_col", "e.*").filter("frame_idx is not null")
    each = stage(each)
    cell = ["session_id", "frame_idx", "label"]
    # a cell and a spot once, whatever windows ask
    pairs = each.select(*cell, "loc_row", "loc_col").distinct()
    near = labelled.select(*cell, "r", "c").join(pairs, cell).groupBy(*cell, "loc_row", "loc_col").agg(F.min(_km("r", "c", d)).alias("km"))
    met = each.join(near, [*cell, "loc_row", "loc_col"]).groupBy(*keys)
    return met.agg(*[F.max(F.when(F.col("i") == i, F.col("km"))).alias(c) for i, c in enumerate(("edge_first", "edge_before", "edge_last"))])


def estimates(a: detect.Analysis, where: DataFrame, d: Detector, length: int, gates: DataFrame | None = None, ends: DataFrame | None = None, every_edge: bool = False) -> DataFrame:
    """Per window, gated track and spot the estimates of its arrival: by its way (w06_s), its centroid (w04_s) and
    its edge (w05_s; unless ``every_edge``, only where it decides)."""
    tracks = ended_tracks(a.entries, d, length)
    if ends is not None:
        tracks = tracks.join(ends.select(*WINDOW), WINDOW, "left_semi")
    if gates is None:  # before places multiply the rows
        tracks = gated(tracks, d, None).drop("multiplier", "need")
    own = [c for c in ("session_id",) if c in where.columns]
    placed = tracks.join(where, own) if own else tracks.crossJoin(where)  # the configured places of a run
    placed = gated(placed, d, gates)
    centre = _km("row_c", "col_c", d)
    placed = placed.withColumn("last_km", centre).withColumn("overhead", centre / d.grid.km_per_px <= F.col("proximity_km") / d.grid.km_per_px)
    placed = placed.withColumn("w06_s", arrival.first_near(d, F.col("proximity_km") / d.grid.km_per_px, F.col("lookahead_s")))
    placed = placed.withColumn("first_km", _km("first.row_c", "first.col_c", d)).withColumn("before_km", F.when(F.col("n") > 1, _km("before.row_c", "before.col_c", d)))
    placed = placed.withColumn("duration_s", ((F.col("end_frame") - F.col("first.frame_idx")) * d.frame_s).cast("double"))
    placed = stage(placed.withColumn("w04_s", arrival.closing_eta(d, F.col("proximity_km"), F.col("lookahead_s"))))

    far = (F.col("proximity_km") + d.max_speed_kmh * F.col("lookahead_s") / 3600) / d.grid.km_per_px + 1e-6
    down = F.greatest(F.col("r_min") - F.col("loc_row"), F.col("loc_row") - F.col("r_max"), F.lit(0))
    across = F.greatest(F.col("c_min") - F.col("loc_col"), F.col("loc_col") - F.col("c_max"), F.lit(0))
    # the edge decides where neither the way ahead nor the centroid does
    decides = ~F.col("overhead") & (~F.col("coherent") | (F.col("w06_s").isNull() & F.col("w04_s").isNull()))
    asked = (F.col("n") > 1) & (F.lit(True) if every_edge else decides)
    edges = _edges(placed.filter(asked & (F.sqrt(down * down + across * across) <= far)), a.labelled, d)
    keys = [*TRACK, "end_frame", *SPOT]
    every = placed.join(edges, keys, "left").withColumns({"first_km": F.col("edge_first"), "before_km": F.col("edge_before"), "last_km": F.col("edge_last")})
    return every.withColumn("w05_s", arrival.edge_eta(d, F.col("proximity_km"), F.col("lookahead_s"))).withColumn("mean_conf", F.lit(1.0))


def evaluate(a: detect.Analysis, where: DataFrame, d: Detector, length: int, gates: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Per window, gated track and spot what ``detect.decided`` says of it."""
    return detect.decided(estimates(a, where, d, length, gates, ends), d, [*TRACK, "end_frame", *SPOT])


def windows(frames: DataFrame, length: int, first: int, last: int) -> DataFrame:
    """session_id, end_frame from ``first`` to ``last`` with n_frames: how many of the window's frames are there."""
    each = frames.select("session_id", F.col("frame_idx").cast("long").alias("frame_idx")).distinct()
    seen = each.select("session_id", F.explode(F.sequence(F.col("frame_idx"), F.col("frame_idx") + length - 1)).alias("end_frame"))
    n = seen.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n_frames"))
    ends = each.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("end_frame"))
    return ends.join(n, WINDOW, "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)).cast("long"))


def replay(pixels: DataFrame, places: DataFrame, ends: DataFrame, d: Detector | None = None, length: int = 8, gates: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """Per window end (``ends``: session_id, end_frame, n_frames), place and variant: rain_expected, arrival_s,
    max_intensity, rain_at_location, n_cells and confidence, as ``detect.detect`` has them for one window;
    and actual_s, when rain reached the place in the frames after the window within the lookahead (null: not).

    ``variants``: variant, proximity_km, lookahead_s. Pixels are read once."""
    d = d or Detector()
    where = spots(places, d, variants)
    a = detect.analyse(pixels, d)
    found = evaluate(a, where, d, length, gates, ends)
    key = [*WINDOW, *SPOT]
    best = found.groupBy(*key).agg(F.min("arrival_s").alias("arrival_s"), F.max("contribution").alias("contribution"), F.count(F.lit(1)).alias("n_cells"))

    strong = a.labelled if d.min_area == 1 else filters.threshold(pixels, d.intensity)
    rain = arrival.rain_by_frame(strong, where, d)
    near = rain.join(where.select(*SPOT, "lookahead_s").distinct(), SPOT)
    ahead = F.floor(F.col("lookahead_s") / d.frame_s)
    # a frame is among the recent of some windows and ahead of others
    seen = near.select("session_id", *SPOT, "frame_idx", "inten", F.explode(F.sequence(F.col("frame_idx") - ahead, F.col("frame_idx") + F.lit(min(d.recent_frames, length) - 1))).alias("end_frame"))
    recent, later = F.col("frame_idx") <= F.col("end_frame"), F.col("frame_idx") > F.col("end_frame")
    met = seen.groupBy(*key).agg(F.max(F.when(recent, F.struct("frame_idx", "inten"))).alias("_n"), F.min(F.when(later, F.col("frame_idx"))).alias("actual"))
    met = met.select(*key, F.col("_n.frame_idx").alias("rain_frame"), F.col("_n.inten").alias("rain_intensity"), "actual")

    own = [c for c in ("session_id",) if c in where.columns]
    every = ends.join(where.select(*own, *SPOT), own) if own else ends.crossJoin(where.select(*SPOT))
    every = every.join(best, key, "left").join(met, key, "left").withColumn("actual_s", (F.col("actual") - F.col("end_frame")) * float(d.frame_s))
    return detect.reported(every, d, F.col("end_frame"), [*key, "n_frames", "actual_s"])
