"""Frames: caches, guards, samples of pixels and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_cache(manifest: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """(location_id, path, origin) of the frames of a manifest: from the cache, newly fetched or
    missing. Cached frames that left the manifest are gone."""
    hit = manifest.join(cache, ["location_id", "path"], "left_semi").withColumn("origin", F.lit("cached"))
    rest = manifest.join(cache, ["location_id", "path"], "left_anti")
    new = rest.join(fetched, ["location_id", "path"], "left_semi").withColumn("origin", F.lit("fetched"))
    gone = rest.join(fetched, ["location_id", "path"], "left_anti").withColumn("origin", F.lit("missing"))
    return hit.unionByName(new).unionByName(gone)


def fetch_guard(frames: DataFrame) -> DataFrame:
    """Per location whether a poll fails (nothing fetched); grids of zeros are valid frames."""
    return frames.groupBy("location_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("origin") != "missing").alias("n_fetched"), (~F.bool_or(F.col("origin") != "missing")).alias("failed"))


def sample_points(pixels: DataFrame, places: DataFrame, height: int, width: int) -> DataFrame:
    """Intensity at the cell of each place and session, clamped to the edges; 0 without echo."""
    at = places.select("location_id", F.greatest(F.least("loc_row", F.lit(height - 1)), F.lit(0)).alias("r"), F.greatest(F.least("loc_col", F.lit(width - 1)), F.lit(0)).alias("c"))
    every = pixels.select("session_id", "frame_idx").distinct().crossJoin(at)
    met = every.join(pixels, ["session_id", "frame_idx", "r", "c"], "left")
    return met.select("session_id", "frame_idx", "location_id", F.coalesce("inten", F.lit(0.0)).alias("inten"))


def same_grid(pixels: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    """The echo of frames whose held box and shape are those asked for; of other frames nothing,
    which is a grid of zeros. ``held`` and ``asked``: session_id, frame_idx, box (struct), height, width."""
    by = ["session_id", "frame_idx"]
    fits = asked.alias("a").join(held.alias("h"), by).filter("a.box <=> h.box and a.height = h.height and a.width = h.width")
    return pixels.join(fits.select(*by).distinct(), by, "left_semi")


def numbered(frames: DataFrame) -> DataFrame:
    """Frames of each session with their number from 1 and how many there are."""
    by = Window.partitionBy("session_id")
    return frames.select("*", F.row_number().over(by.orderBy("frame_idx")).alias("number"), F.count(F.lit(1)).over(by).alias("n_frames"))


def coverage(tiles: DataFrame) -> DataFrame:
    """Per location whether any tile of the first, middle and last frame shows anything."""
    n = tiles.groupBy("location_id").agg(F.max("frame_idx").alias("_last"))
    met = tiles.join(n, "location_id").filter(F.col("frame_idx").isin(0) | (F.col("frame_idx") == F.expr("(_last + 1) div 2")) | (F.col("frame_idx") == F.col("_last")))
    return met.groupBy("location_id").agg(F.bool_or(F.col("alpha") > 10).alias("covered"))


def cloud_fraction(pixels: DataFrame, reach: int, least: float | Column = 120.0, size: int = 256) -> DataFrame:
    """Per place the share of bright pixels in the square around it, cut off at the tile's edges;
    ``pixels`` carry loc_row and loc_col."""
    inside = pixels.filter(F.col("row").between(F.col("loc_row") - reach, F.col("loc_row") + reach) & F.col("col").between(F.col("loc_col") - reach, F.col("loc_col") + reach))
    luma = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    return inside.groupBy("location_id").agg(F.avg((luma >= least).cast("int")).alias("fraction"))


def transition(pixels: DataFrame, band: Column) -> DataFrame:
    """How pixels change their band from frame 0 to frame 1."""
    b = pixels.withColumn("band", band).select("frame_idx", "row", "col", "band")
    first = b.filter("frame_idx = 0").select("row", "col", F.col("band").alias("band0"))
    second = b.filter("frame_idx = 1").select("row", "col", F.col("band").alias("band1"))
    return first.join(second, ["row", "col"]).groupBy("band0", "band1").agg(F.count(F.lit(1)).alias("n"))
