"""Confidence of pixels: texture, persistence, clutter, and refinement by motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.config import Grid, Quality
from pluvio.operators import tiled

PIXEL = ("session_id", "frame_idx", "r", "c")


def texture(pixels: DataFrame, q: Quality | None = None, grid: Grid | None = None, side: int = 64) -> DataFrame:
    """``texture`` of each echo pixel: 1 in smooth surroundings, 0 in rough ones. A task holds a tile of
    ``side`` pixels with its margin."""
    q, grid = q or Quality(), grid or Grid()
    around = tiled.focal(pixels, q.kernel, grid, side)
    std = F.sqrt(F.greatest(F.col("mean_square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    score = 1 - F.least(F.greatest((std - q.texture_low) / (q.texture_high - q.texture_low), F.lit(0.0)), F.lit(1.0))
    return around.select(*PIXEL, score.alias("texture"))


def temporal(pixels: DataFrame, q: Quality | None = None) -> DataFrame:
    """``temporal`` of each echo pixel: in how many frames so far it had echo, up to enough."""
    q = q or Quality()
    by = Window.partitionBy("session_id", "r", "c").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    echo = pixels.filter(F.col("inten") > q.echo)
    return echo.select(*PIXEL, F.least(F.count(F.lit(1)).over(by) / float(q.temporal_frames), F.lit(1.0)).alias("temporal"))


def clutter_state(pixels: DataFrame, frames: int, q: Quality | None = None) -> DataFrame:
    """Per pixel the decayed count of echoes after ``frames`` updates, and its frequency."""
    q = q or Quality()
    echo = pixels.filter(F.col("inten") > q.echo)
    updates = (1 - q.decay**frames) / (1 - q.decay)
    s = echo.groupBy("session_id", "r", "c").agg(F.sum(F.pow(F.lit(q.decay), F.lit(frames - 1) - F.col("frame_idx"))).alias("echo_count"))
    freq = F.least(F.greatest(F.col("echo_count") / updates, F.lit(0.0)), F.lit(1.0))
    return s.select("session_id", "r", "c", "echo_count", F.lit(updates).alias("update_count"), freq.alias("freq"))


def confidence(pixels: DataFrame, frames: int, q: Quality | None = None, grid: Grid | None = None, with_clutter: bool = True, maturity: float | None = None) -> DataFrame:
    """``conf`` of each pixel of every frame, from the factors that are known. ``maturity`` (0 to 1) of a clutter
    statistic that is older than these frames; by default that of the frames alone.

    While the clutter statistic is young its weight moves to the other factors, and everything
    is a little less sure. Frame i sees the frames up to i; the clutter is the same for all."""
    q = q or Quality()
    mature = 0.0
    if with_clutter:
        mature = min(1.0, (1 - q.decay**frames) / (1 - q.decay) / q.mature_updates) if maturity is None else maturity
    met = factors(pixels, frames, q, grid, with_clutter)
    return met.select(*PIXEL, "inten", combined(q, mature, with_clutter).alias("conf"))


def factors(pixels: DataFrame, frames: int, q: Quality, grid: Grid | None = None, with_clutter: bool = True) -> DataFrame:
    """``pixels`` with texture, temporal and freq (null where unknown)."""
    met = pixels.select(*PIXEL, "inten").join(texture(pixels, q, grid), list(PIXEL), "left").join(temporal(pixels, q), list(PIXEL), "left")
    if not with_clutter:
        return met
    return met.join(clutter_state(pixels, frames, q).select("session_id", "r", "c", "freq"), ["session_id", "r", "c"], "left")


def combined(q: Quality, mature: float, with_clutter: bool = True) -> Column:
    """The confidence that follows from the factors of a pixel."""
    t, p = F.coalesce("texture", F.lit(0.0)), F.coalesce("temporal", F.lit(0.0))
    wt, wp, wc = q.texture_weight, q.temporal_weight, q.clutter_weight
    if with_clutter:
        moved = wc * (1 - mature)
        wt, wp, wc = wt + moved * wt / (wt + wp), wp + moved * wp / (wt + wp), wc * mature
        clutter = F.when(F.col("inten") > 0, 1 - F.coalesce("freq", F.lit(0.0))).otherwise(0.0)
        total = (wt * t + wp * p + wc * clutter) / (wt + wp + wc)
    else:
        total = (wt * t + wp * p) / (wt + wp)
    return total * (1.0 if mature >= 0.5 else 1.0 - 0.08 * (1.0 - mature * 2))


def effective(pixels: DataFrame, conf: DataFrame) -> DataFrame:
    """Pixels times their confidence; frames without a confidence keep their values."""
    met = pixels.join(conf.select(*PIXEL, "conf"), list(PIXEL), "left")
    known = conf.select("session_id", "frame_idx").distinct().withColumn("_known", F.lit(True))
    met = met.join(known, ["session_id", "frame_idx"], "left")
    factor = F.when(F.col("_known").isNull(), 1.0).otherwise(F.coalesce("conf", F.lit(0.0)))
    return met.select(*PIXEL, (F.col("inten") * factor).alias("inten"))


def speed_score(speed: Column, q: Quality | None = None) -> Column:
    q = q or Quality()
    return F.when(speed.isNull(), 0.5).when(speed < q.speed_low, 0.2).when(speed > q.speed_high, 0.1).otherwise(1.0)


def motion_score(conf: Column, q: Quality | None = None) -> Column:
    q = q or Quality()
    return F.when(conf.isNull(), 0.5).when(conf >= q.coherent, 1.0).otherwise(0.3)


def refined_background(q: Quality | None = None) -> float:
    """The refined confidence of a pixel without echo: none before, a half for speed and motion."""
    q = q or Quality()
    pre, post = q.texture_weight + q.temporal_weight + q.clutter_weight, q.speed_weight + q.motion_weight
    return 0.5 * post / (pre + post)


def refine(labelled: DataFrame, conf: DataFrame, cells: DataFrame, q: Quality | None = None) -> DataFrame:
    """``refined`` confidence of the last frame's pixels. ``cells``: session_id, label, speed_kmh,
    cell_conf of tracked cells; pixels of other cells and of none score a half for their motion."""
    q = q or Quality()
    pre = q.texture_weight + q.temporal_weight + q.clutter_weight
    at = conf.join(labelled.select(*PIXEL, "label"), list(PIXEL), "left").join(cells, ["session_id", "label"], "left")
    post = q.speed_weight * speed_score(F.col("speed_kmh"), q) + q.motion_weight * motion_score(F.col("cell_conf"), q)
    value = (pre * F.col("conf") + post) / (pre + q.speed_weight + q.motion_weight)
    return at.select(*PIXEL, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("refined"))


def by_position(evaluated: DataFrame) -> DataFrame:
    """Tracked cells (TRACK, location_id, speed_kmh, mean_conf) as ``refine`` takes them, with labels by their
    place in the list of a location's cells instead of their own: the first has label 1. Earlier releases
    mapped cells so; where a cell was left out, later ones lend their scores to other cells."""
    by = Window.partitionBy("session_id", "location_id").orderBy("root_frame", "root_label")
    return evaluated.select("session_id", "location_id", F.row_number().over(by).alias("label"), "speed_kmh", F.col("mean_conf").alias("cell_conf"))
