"""State and intermediate relations in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local one only where it is unset, as in tests."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once and read by all that follows; a lost executor costs no more than its tasks."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLUTTER = "location_id long, r long, c long, echo_count double, last_cycle long"


def load_clutter(spark: SparkSession, path: str) -> DataFrame:
    """The clutter state saved at ``path``, empty where there is none yet."""
    try:
        return spark.read.schema(CLUTTER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CLUTTER)


def clutter_or_warning(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The saved clutter state and a relation of warnings (path, warning). State that can't be read counts as none:
    each file is tried for itself, so that detection goes on without it."""
    empty, none = spark.createDataFrame([], CLUTTER), spark.createDataFrame([], "path string, warning string")
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
        n_files = files.count()
    except AnalysisException:
        return empty, none  # nothing saved yet
    if not n_files:
        return empty, none
    whole = spark.read.schema(CLUTTER).option("ignoreCorruptFiles", True).parquet(path)
    read = whole.select(F.input_file_name().alias("path")).distinct()
    bare = F.regexp_replace("path", "^file:/*", "/")
    lost = files.withColumn("_p", bare).join(read.select(bare.alias("_p")), "_p", "left_anti")
    # a file without rows isn't lost; it still has Parquet's mark at both ends
    ends = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", F.substring("content", 1, 4).alias("head"), F.expr("substring(content, -4, 4)").alias("tail"))
    mark = F.lit(bytearray(b"PAR1"))
    broken = ends.join(lost.select("path"), "path", "left_semi").filter((F.col("head") != mark) | (F.col("tail") != mark))
    warnings = broken.select("path", F.lit("clutter state is unreadable; going on without it").alias("warning"))
    return (empty if not warnings.isEmpty() else whole), warnings


def save_clutter(state: DataFrame, path: str) -> None:
    state.select(*[c.split()[0] for c in CLUTTER.split(", ")]).write.mode("overwrite").parquet(path)


def fold_clutter(state: DataFrame, pixels: DataFrame, decay: float = 0.99966, echo: float = 0.01) -> DataFrame:
    """The state after some cycles of ``pixels`` (location_id, cycle, r, c, inten).

    A pixel keeps its value and the cycle of its last echo; the decay since is applied when it is
    read, so that pixels without echo are never touched."""
    new = pixels.filter(F.col("inten") > echo).groupBy("location_id", "r", "c").agg(F.max("cycle").alias("_last"), F.collect_list("cycle").alias("_at"))
    met = state.join(new, ["location_id", "r", "c"], "full_outer")
    last = F.coalesce("_last", "last_cycle")
    added = F.aggregate(F.coalesce("_at", F.array().cast("array<long>")), F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(decay), (last - x).cast("double")))
    kept = F.coalesce(F.col("echo_count") * F.pow(F.lit(decay), (last - F.col("last_cycle")).cast("double")), F.lit(0.0))
    return met.select("location_id", "r", "c", (kept + added).alias("echo_count"), last.alias("last_cycle"))


def clutter_frequency(state: DataFrame, cycle: int, decay: float = 0.99966) -> DataFrame:
    """Frequencies after ``cycle`` (from 0) of all locations."""
    updates = (1 - decay ** (cycle + 1)) / (1 - decay)
    now = F.col("echo_count") * F.pow(F.lit(decay), (F.lit(cycle) - F.col("last_cycle")).cast("double"))
    return state.select("location_id", "r", "c", F.least(now / updates, F.lit(1.0)).alias("freq"))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, as maps of state ask for."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
