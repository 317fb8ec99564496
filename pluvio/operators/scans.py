"""Values carried along the history of a key, in two levels.

A history is cut into buckets of time. Each bucket is summed up in one row; the summaries of a key, few,
are scanned in their order; then the buckets are scanned in parallel, each from the value carried into it.
So no task holds a key's whole history, only a bucket of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket.
WEEK = 604_800


def running_sum(rows: DataFrame, key: str, at: str, order: list[str], value: Column, name: str, bucket_s: int = WEEK) -> DataFrame:
    """``rows`` with the sum of ``value`` over those of the key up to and with each, in the order of ``order``, which
    begins with the time ``at``."""
    cut = rows.withColumn("_bucket", F.floor(F.col(at) / bucket_s)).withColumn("_value", value)
    by = Window.partitionBy(key).orderBy("_bucket")
    sums = cut.groupBy(key, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), (F.sum("_sum").over(by) - F.col("_sum")).alias("_before"))
    met = cut.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")))
    within = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(name, F.col("_before") + F.sum("_value").over(within)).drop("_bucket", "_value", "_key", "_of", "_before")


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, state_at: str, value: str, bucket_s: int = WEEK) -> DataFrame:
    """Each event with the latest state of its key at or before it. Within a bucket both sides are sorted together
    and the last state is carried on; a bucket without one takes the last of the buckets before."""
    kind = states.schema[value].dataType
    e = events.withColumns({"_at": F.col(at), "_kind": F.lit(1), "_state": F.lit(None).cast(kind)})
    s = states.select(key, F.col(state_at).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_state"))
    both = e.unionByName(s, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / bucket_s))
    known = F.when((F.col("_kind") == 0) & F.col("_state").isNotNull(), F.col("_at"))
    ends = both.groupBy(key, "_bucket").agg(F.max_by("_state", known).alias("_end"))
    by = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.last("_end", ignorenulls=True).over(by).alias("_carried"))
    met = both.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")))
    within = Window.partitionBy(key, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = met.withColumn(value, F.coalesce(F.last("_state", ignorenulls=True).over(within), F.col("_carried")))
    return out.filter("_kind = 1").drop("_at", "_kind", "_state", "_bucket", "_key", "_of", "_carried")
