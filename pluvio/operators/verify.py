"""Verification of predictions: observation windows, contingency scores, runs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.operators import nearest, scans


def observed(predictions: DataFrame, observations: DataFrame, after_s: int, least_mm: float = 0.2, before_s: int = 0) -> DataFrame:
    """``predictions`` (event_id, station, t, predicted) with ``observed``: rain at the station in
    (t - before, t + after].

    Times are cut into buckets as long as the window, so that the join is on station and bucket
    and a prediction meets the observations of two or three buckets, not of all time."""
    size = max(after_s + before_s, 900)
    rain = observations.filter(F.col("rain_mm") >= least_mm).select("station", "obs").distinct().withColumn("bucket", F.floor(F.col("obs") / size))
    lo, hi = F.col("t") - before_s, F.col("t") + after_s
    spread = predictions.withColumn("bucket", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))
    met = spread.join(rain, ["station", "bucket"]).filter((F.col("obs") > lo) & (F.col("obs") <= hi))
    hits = met.groupBy("event_id").agg(F.min("obs").alias("first_obs"))
    return predictions.join(hits, "event_id", "left").withColumn("observed", F.col("first_obs").isNotNull())


def counts() -> list[Column]:
    p, o = F.col("predicted"), F.col("observed")
    return [F.count_if(p & o).alias("hits"), F.count_if(~p & o).alias("misses"), F.count_if(p & ~o).alias("false_alarms"), F.count_if(~p & ~o).alias("correct_negatives")]


def scores(counted: DataFrame) -> DataFrame:
    """POD, FAR, CSI and bias from contingency counts; null where nothing is to divide by."""
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b)

    return counted.withColumns({"pod": ratio(h, h + m), "far": ratio(f, h + f), "csi": ratio(h, h + m + f), "bias": ratio(h + f, h + m)})


def scorecard(judged: DataFrame, key: str = "station") -> DataFrame:
    """Scores of every station (or other ``key``) and of all together, from pooled counts."""
    return scores(judged.rollup(key).agg(*counts()))


def scorable(replayed: DataFrame, length: int, last_frame: int, ahead: int) -> DataFrame:
    """Windows of a replay that have all their frames, and after them the ``ahead`` frames of the
    lookahead, with what was predicted and what came."""
    whole = replayed.filter((F.col("n_frames") == length) & (F.col("end_frame") + ahead <= last_frame))
    return whole.withColumn("predicted", F.col("rain_expected")).withColumn("observed", F.col("actual_s").isNotNull())


def arrival_error(judged: DataFrame, key: str) -> DataFrame:
    """Of the hits, the mean of predicted less actual arrival in minutes."""
    hits = judged.filter("predicted and observed").groupBy(key)
    return hits.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("arrival_s") - F.col("actual_s")) / 60.0).alias("mean_error_min"))


def delta(card: DataFrame, baseline: DataFrame, key: str = "station") -> DataFrame:
    """How the scores of a variant differ from those of a baseline."""
    names = ("pod", "far", "csi", "bias")
    b = baseline.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in names])
    met = card.join(b, F.col(key).eqNullSafe(F.col("_k")))
    return met.select(key, *[(F.col(x) - F.col(f"_{x}")).alias(f"d_{x}") for x in names])


def window_sweep(predictions: DataFrame, observations: DataFrame, lookahead_s: int, extra_s: list[int], least_mm: float = 0.2) -> DataFrame:
    """Scores for each extension of the forward window, and the share of hits among the rain that
    each extension adds.

    The first observation after a prediction decides for all extensions at once, so the interval
    join runs for the longest only."""
    widest = observed(predictions, observations, lookahead_s + max(extra_s), least_mm)
    wait = F.col("first_obs") - F.col("t")
    each = widest.select("predicted", wait.alias("wait"), F.explode(F.array(*map(F.lit, extra_s))).alias("extra_s"))
    each = each.withColumn("observed", F.coalesce(F.col("wait") <= lookahead_s + F.col("extra_s"), F.lit(False)))
    card = scores(each.groupBy("extra_s").agg(*counts()))
    by = Window.orderBy("extra_s")  # as many rows as extensions
    dh, dr = F.col("hits") - F.lag("hits").over(by), F.col("hits") + F.col("misses") - F.lag(F.col("hits") + F.col("misses")).over(by)
    return card.withColumn("conversion", F.when(dr != 0, dh / dr))


def lead_time(predictions: DataFrame, observations: DataFrame, after_s: int, least_mm: float = 0.2, expected_s: int = 900) -> DataFrame:
    """Per station the mean error in minutes of ``expected_s`` against the first rain of hits."""
    hit = observed(predictions, observations, after_s, least_mm).filter("predicted and observed")
    error = (F.lit(expected_s) - (F.col("first_obs") - F.col("t"))) / 60.0
    return hit.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error_min"))


def nearest_station(places: DataFrame, stations: DataFrame) -> DataFrame:
    """Per place the nearest station, of equal distances the lesser id."""
    return nearest.nearest(places, stations, "location_id", "station")


def windows(frames: DataFrame, length: int, first: int, last: int) -> DataFrame:
    """Windows of ``length`` frames that end at each frame index, and whether all frames are there."""
    ends = frames.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(first + length - 1), F.lit(last))).alias("end_frame"))
    need = ends.select("session_id", "end_frame", F.explode(F.sequence(F.col("end_frame") - length + 1, F.col("end_frame"))).alias("frame_idx"))
    have = frames.select("session_id", F.col("frame_idx").cast("int").alias("frame_idx")).distinct().withColumn("_h", F.lit(1))
    met = need.join(have, ["session_id", "frame_idx"], "left")
    return met.groupBy("session_id", "end_frame").agg(F.count("_h").alias("n_frames")).withColumn("complete", F.col("n_frames") == length)


def alarm_kind(arrival_min: Column) -> Column:
    return F.when(arrival_min.isNull(), "none").when(arrival_min <= 0, "overhead").when(arrival_min < 10, "imminent").when(arrival_min <= 25, "near").when(arrival_min < 30, "between").otherwise("far")


def miss_runs(judged: DataFrame) -> DataFrame:
    """Runs of consecutive misses of a station: islands between other outcomes."""
    miss = ~F.col("predicted") & F.col("observed")
    each = scans.running_sum(judged.withColumn("_m", miss), "station", "t", ["t", "event_id"], (~F.col("_m")).cast("int"), "_island")
    runs = each.filter("_m").groupBy("station", "_island").agg(F.count(F.lit(1)).alias("length"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return runs.drop("_island")


def curated(judged: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each station and outcome: a stratified report, where the bound is the feature."""
    p, o = F.col("predicted"), F.col("observed")
    outcome = F.when(p & o, "hit").when(o, "miss").when(p, "false_alarm").otherwise("correct_negative")
    by = Window.partitionBy("station", "outcome").orderBy("t", "event_id")
    return judged.withColumn("outcome", outcome).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("station", "outcome", "rank", "event_id")
