"""Thresholds and persistence of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = ("session_id", "frame_idx")


def threshold(pixels: DataFrame, least: float = 0.1) -> DataFrame:
    """Pixels of at least ``least``."""
    return pixels.filter(F.col("inten") >= least)


def by_area(labelled: DataFrame, least: int) -> DataFrame:
    """Labelled pixels of components with at least ``least`` pixels."""
    sizes = labelled.groupBy(*FRAME, "label").agg(F.count(F.lit(1)).alias("_area")).filter(F.col("_area") >= least)
    return labelled.join(sizes.drop("_area"), [*FRAME, "label"], "left_semi")


def persistent(pixels: DataFrame, last_frame: int, frames: int = 2) -> DataFrame:
    """(session_id, r, c) with echo in at least ``frames`` frames, the last among them."""
    seen = pixels.groupBy("session_id", "r", "c").agg(F.countDistinct("frame_idx").alias("n"), F.max("frame_idx").alias("last"))
    return seen.filter((F.col("n") >= frames) & (F.col("last") == last_frame)).select("session_id", "r", "c", "n")


def last_frames(frames: DataFrame, n: int, key: str = "session_id", order: str = "frame_idx") -> DataFrame:
    """The most recent ``n`` frames of each key, by a bounded aggregate instead of a sort."""
    newest = frames.groupBy(key).agg(F.slice(F.sort_array(F.collect_set(order), asc=False), 1, n).alias("_kept"))
    return frames.join(newest, key).filter(F.array_contains("_kept", F.col(order))).drop("_kept")
