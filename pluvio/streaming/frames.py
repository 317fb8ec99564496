"""Polling as a stream: frames arrive in manifests, late or again, and are detected in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "location_id long, path string, frame_ts timestamp, n_echo long"


def read_frames(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of frames as they appear in ``folder``."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_frames(stream: DataFrame, late: str = "80 minutes") -> DataFrame:
    """Each frame of a location once, as long as a manifest may still name it."""
    return stream.withWatermark("frame_ts", late).dropDuplicatesWithinWatermark(["location_id", "path"])


def sliding_windows(stream: DataFrame, length: str = "80 minutes", step: str = "10 minutes", late: str = "80 minutes") -> DataFrame:
    """Per location the number of frames and echoes in windows of eight frames."""
    w = F.window("frame_ts", length, step)
    counted = stream.withWatermark("frame_ts", late).groupBy("location_id", w).agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n_echo").alias("n_echo"))
    return counted.select("location_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_frames", "n_echo")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stops."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def detect_batches(stream: DataFrame, checkpoint: str, detect: Callable[[DataFrame, int], None]) -> None:
    """``detect`` for each micro-batch of new frames, all locations at once."""
    q = stream.writeStream.foreachBatch(detect).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
