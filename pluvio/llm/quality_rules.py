"""Quality rules whose limits come from the corpus itself (operator 9).

Base statistics of every text are plain column expressions. For each language and source a
mergeable quantile sketch of each metric is built, the sketches of one language are merged from
those of its sources, and the limits are Tukey-style fences read from the sketches. A sketch is a
set of counts in buckets whose borders grow by a constant ratio (Masson, Rim and Lee 2019): a
quantile is off by a fixed relative error at most, sketches merge by adding counts, and no order of
rows or tasks, nor a task done twice, changes one, so that every run draws the same limits. A metric's
reach is followed outward from the median, quantile by quantile, as far as they lie together, so
that a long tail widens its group's fence and a bulk of junk apart from the rest doesn't. The
limits are joined back and decide. Only DataFrame functions run; no Python touches a row.

Defined results: a null text has no words and fails the base rule; null ``lang`` or ``source``
form a group of their own; repeated rows are judged alike; an empty table gives an empty one;
columns of the input named like a result column are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.shared import cut, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
METRICS = ("symbols_per_word", "dup_lines_per_word", "repeat_share", "chars_per_word")
#: The bucket of the value 0.
ZERO = -(2**31)


@dataclass(frozen=True)
class QualityLimits:
    """Base rule and the width of the fences.

    The reach on a side of the median starts as ``floor`` (in the metric's own unit; it decides
    only where a group has no spread) and grows to the distance of each quantile of ``ranks`` that
    lies within ``spread`` times the reach so far. The fence stands ``spread`` times the reach
    from the median. Groups with fewer than ``min_group`` documents that pass
    the base rule use the limits of their whole language. ``accuracy`` is the relative error of the sketches'
    quantiles."""

    min_words: int = 50
    max_repeat_percent: int = 50
    spread: float = 3.0
    floor: tuple[float, ...] = (0.01, 0.005, 0.02, 0.1)
    ranks: tuple[float, ...] = (0.75, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99)
    min_group: int = 30
    accuracy: float = 0.001

    @property
    def ratio(self) -> float:
        """Between the borders of a bucket of the sketches."""
        return (1 + self.accuracy) / (1 - self.accuracy)


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the five counts of BASE for each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", words(F.col("text")))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    d = d.withColumn("_lines", lines)
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Windows of three words stand as 64-bit hashes. Only texts where two agree are sorted
    # to find which ones, and the words under those are counted once each.
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(1), F.col("n_words").cast("int") - 2)).otherwise(F.array().cast("array<int>"))
    w = F.col("_words")
    d = d.withColumn("_grams", F.transform(starts, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))
    d = d.withColumn("_any", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    placed = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.col("_any"), placed))
    s, last = F.col("_sorted"), F.size("_sorted")
    twice = F.filter(
        "_sorted",
        lambda x, i: F.when(i > 0, F.element_at(s, F.greatest(i, F.lit(1)))["h"] == x["h"]).otherwise(False)
        | F.when(i < last - 1, F.element_at(s, F.least(i + 2, last))["h"] == x["h"]).otherwise(False),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    d = d.withColumn("n_repeat_words", F.when(F.col("_any"), F.size(covered)).otherwise(0).cast("long"))
    return d.drop("_words", "_lines", "_grams", "_any", "_sorted")


def _metrics() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = (F.col("n_symbols") / n, F.col("n_dup_lines") / n, F.col("n_repeat_words") / n, F.col("word_chars") / n)
    return [v.alias(m) for v, m in zip(values, METRICS, strict=True)]


def base_failed(limits: QualityLimits) -> Column:
    n = F.col("n_words")
    return (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * n)


def sketches(stats: DataFrame, limits: QualityLimits) -> DataFrame:
    """Per (lang, source, metric) the counts ``n`` of ``bucket``, over documents that pass the base rule."""
    ok = stats.filter(~base_failed(limits)).select("lang", "source", *_metrics())
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(limits.ratio)).cast("int")).otherwise(ZERO)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    rows = ok.select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, by: list[str], limits: QualityLimits) -> DataFrame:
    """Per ``by``: ``total``, ``middle``, and the distances ``up`` and ``down`` to the quantiles of ``limits.ranks``."""
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    c = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(limits.ratio), F.col("bucket")) / (limits.ratio + 1))
    c = c.select(*by, value.alias("_v"), F.sum("n").over(upto).alias("_upto"), F.sum("n").over(whole).alias("total"))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.ceil(q * F.col("total")), F.col("_v")))

    ups, downs = [at(q) for q in limits.ranks], [at(round(1 - q, 9)) for q in limits.ranks]
    q = c.groupBy(*by).agg(F.first("total").alias("total"), at(0.5).alias("middle"), F.array(*ups).alias("_up"), F.array(*downs).alias("_down"))
    return q.select(*by, "total", "middle", F.transform("_up", lambda x: x - F.col("middle")).alias("up"), F.transform("_down", lambda x: F.col("middle") - x).alias("down"))


def thresholds(stats: DataFrame, limits: QualityLimits) -> DataFrame:
    """Per (lang, source): the fences of each metric over documents that pass the base rule.

    The counts of a group have no more buckets than the range of a metric has steps of the ratio.
    Partial counts merge before and after the shuffle, so that a hot source is reduced to those in
    every task that meets it; a language's sketch adds up its sources'."""
    counts = cut(sketches(stats, limits))
    own = _quantiles(counts, ["lang", "source", "metric"], limits)
    lang = _quantiles(counts, ["lang", "metric"], limits).select(F.col("lang").alias("_lang"), F.col("metric").alias("_metric"), *[F.col(c).alias(f"{c}_all") for c in ("middle", "up", "down")])
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric")))
    many = F.col("total") >= limits.min_group
    used = both.select("lang", "source", "metric", *[F.when(many, F.col(c)).otherwise(F.col(f"{c}_all")).alias(c) for c in ("middle", "up", "down")])
    out = []
    for m, floor in zip(METRICS, limits.floor, strict=True):
        this, middle = F.col("metric") == m, F.col("middle")
        out += [F.max(F.when(this, middle - _fence(F.col("down"), floor, limits))).alias(f"{m}_low"), F.max(F.when(this, middle + _fence(F.col("up"), floor, limits))).alias(f"{m}_high")]
    return used.groupBy("lang", "source").agg(*out)


def _fence(distances: Column, floor: float, limits: QualityLimits) -> Column:
    """How far from the median a fence stands: past the quantiles that lie together."""
    return limits.spread * F.aggregate(distances, F.lit(float(floor)), lambda reach, d: F.when((d > reach) & (d <= limits.spread * reach), d).otherwise(reach))


def judge(docs: DataFrame, limits: QualityLimits | None = None, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``carry``, default all) with BASE, ``base_failed`` and ``kept``.

    The statistics are computed once, written to the shared folder and read twice: by the
    sketches and by the filter."""
    limits = limits or QualityLimits()
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in (*BASE, "base_failed", "kept")]
    stats = cut(base_statistics(docs).select(*carry, *[c for c in ("lang", "source") if c not in carry], *BASE))
    fences = thresholds(stats, limits).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"{m}_{e}" for m in METRICS for e in ("low", "high")])
    rows = stats.select("*", *_metrics())
    # One row per group: the join below stays a broadcast only as long as its measured size allows.
    met = rows.join(fences, rows["lang"].eqNullSafe(F.col("_lang")) & rows["source"].eqNullSafe(F.col("_source")), "left")
    inside = reduce(lambda a, b: a & b, [F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True)) for m in METRICS])
    failed = base_failed(limits)
    return met.select(*[F.col(c) for c in carry], *BASE, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def keep_good(docs: DataFrame, limits: QualityLimits | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return judge(docs, limits).filter("kept").select(*docs.columns)
