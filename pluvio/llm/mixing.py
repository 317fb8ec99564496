"""Mixing sources to target weights by Poisson replication (operator 6).

Each source gets a mean repetition rate: the characters it should have in the mixture over the
characters it has. Each document draws its number of copies from the Poisson distribution with
that rate, by inverting the distribution at a uniform number made from a seeded hash of the
document's id. The copies are exploded and dealt out globally in the order of another hash.

The distribution of a source is a short array made once by window sums, of the counts around its
mean that uniform numbers of 52 bits can tell from never and always. The rates, a row for each
source, are written once. While they are at most ``FEW_SOURCES`` the documents meet the arrays in a
broadcast, so that no text moves before the final shuffle; more sources meet in a join whose hot keys
are salted. Everything is DataFrame functions.

Defined results: a null source is a source; a null or empty text counts as one character, so
that its source has a rate; rows without an id draw by their text; rows with one id (or one
text, without ids) draw alike; sources without a given weight get none, and their documents go;
extra columns are kept; an empty table gives an empty one. No copy is capped: the array reaches
so far that the rest has a probability below the step of the uniform numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.shared import cut, shuffle_partitions

#: Uniform numbers have 52 bits: 13 hexadecimal digits of a hash.
HEX_DIGITS = 13
SEED = "mix-1"
#: Sources whose arrays (about 1 KB each, 200 KB at a rate of a million) are broadcast.
FEW_SOURCES = 2_000
SALTS = 32
#: Characters of the mixture for each partition of the final shuffle.
PART_CHARS = 16 << 20


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1 from the hash of ``seed`` and ``key``."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)


def draw_key(docs: DataFrame) -> Column:
    """What a document draws by: its id, or its text where there is none."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float = 1.0) -> DataFrame:
    """Per source: its characters and the mean repetition ``rate``.

    The mixture has ``size`` times the characters of all documents. Shares are ``weights`` or,
    without them, in proportion to the source's characters to the power ``power``."""
    length = F.greatest(F.length(F.coalesce(F.col("text"), F.lit(""))), F.lit(1)).cast("long")
    per = docs.groupBy("source").agg(F.sum(length).alias("chars"))
    if weights is None:
        raw = F.pow(F.col("chars").cast("double"), F.lit(power)) if power != 0.5 else F.sqrt(F.col("chars").cast("double"))
    elif weights:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        raw = F.coalesce(given[F.col("source")], F.lit(0.0))
    else:
        raise ValueError("weights, if given, name one source at least")
    per = per.withColumn("raw", raw)
    sums = per.agg(F.sum("raw").alias("all_raw"), F.sum("chars").alias("all_chars"))  # one row
    rated = per.join(F.broadcast(sums), F.lit(True), "inner")
    share = F.col("raw") / F.col("all_raw")
    rate = F.lit(float(size)) * F.col("all_chars").cast("double") * share / F.col("chars").cast("double")
    return rated.select("source", "chars", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def cumulative(rates: DataFrame) -> DataFrame:
    """Per source the array ``cdf`` of P(copies <= n) for n = ``least``, ``least`` + 1, ... as far as
    52 bits can tell it from 0 and 1."""
    spread = 12 * F.sqrt("rate") + 30
    first = F.greatest(F.floor(F.col("rate") - spread), F.lit(0)).cast("long")
    last = F.ceil(F.col("rate") + spread).cast("long")
    steps = rates.select("source", "rate", first.alias("least"), F.explode(F.sequence(first, last)).alias("n"))
    by = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # of the first count by Stirling's series, which is exact to 16 digits where it isn't 0
    x = F.greatest("least", F.lit(1)).cast("double")
    stirling = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    step = F.when(F.col("n") > F.col("least"), F.log(F.greatest("n", F.lit(1)).cast("double"))).otherwise(F.when(F.col("least") > 0, stirling).otherwise(0.0))
    log_factorial = F.sum(step).over(by)
    log_p = F.when(F.col("n") == 0, -F.col("rate")).otherwise(F.col("n") * F.log("rate") - F.col("rate") - log_factorial)
    p = steps.withColumn("p", F.coalesce(F.exp(log_p), F.lit(0.0)))
    up_to = p.withColumn("below", F.sum("p").over(by))
    return up_to.groupBy("source").agg(F.first("least").alias("least"), F.array_sort(F.collect_list("below")).alias("cdf"))


def copies(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` with ``n_copies``; documents that draw none are still there."""
    return _copies(docs, cut(source_rates(docs, weights, power, size)), seed)


def _copies(docs: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    limits = cumulative(rates).select(F.col("source").alias("_source"), F.col("least").alias("_least"), F.col("cdf").alias("_cdf"))
    rows, same = docs.drop("n_copies"), F.col("source").eqNullSafe(F.col("_source"))
    if rates.count() <= FEW_SOURCES:
        met = rows.join(F.broadcast(limits), same, "left")
    else:
        salted = limits.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64(draw_key(docs)), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_salt") == F.col("_other")), "left")
    u = uniform(draw_key(docs), seed)
    drawn = met.withColumn("_u", u).withColumn("n_copies", F.col("_least") + F.size(F.filter("_cdf", lambda c: c < F.col("_u"))))
    return drawn.drop("_source", "_least", "_cdf", "_u", "_salt", "_other")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """The mixture: each document as often as it draws, with ``copy`` (from 1) and ``order_key``,
    dealt out and sorted by that key, so that part files hold a uniform shuffle of all copies."""
    rates = cut(source_rates(docs, weights, power, size))
    drawn = _copies(docs, rates, seed).filter(F.col("n_copies") > 0)
    each = drawn.drop("copy", "order_key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).withColumn("copy", F.col("copy").cast("int")).drop("n_copies")
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), draw_key(docs), F.col("copy").cast("string")))
    keyed = each.withColumn("order_key", key)
    chars = rates.agg(F.sum(F.col("chars") * F.col("rate"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), int(chars // PART_CHARS) + 1)
    return keyed.repartition(parts, "order_key").sortWithinPartitions("order_key")


#: The same in DuckDB's SQL, for the default parameters.
MIX_SQL = f"""
with sized as (
  select *, greatest(length(coalesce(text, '')), 1)::bigint as size from documents
), per as (
  select source, sum(size)::bigint as chars, sqrt(sum(size)::bigint::double) as raw from sized group by source
), rated as (
  select source, (select sum(chars) from per)::bigint::double * (raw / (select sum(raw order by source) from per)) / chars::double as rate from per
), steps as (
  select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as n from rated
), log_p as (
  select source, n, case when n = 0 then -rate
    else n * ln(rate) - rate - sum(ln(greatest(n, 1)::double)) over (partition by source order by n rows unbounded preceding) end as log_p,
  from steps
), cdf as (
  select source, n, sum(exp(log_p)) over (partition by source order by n rows unbounded preceding) as below from log_p
), keyed as (
  select *, coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))) as draw from documents
), uniform as (
  select *, (('0x' || substr(md5('{SEED}:' || draw), 1, {HEX_DIGITS}))::bigint::double + 0.5) / {float(16**HEX_DIGITS)!r} as u from keyed
), drawn as (
  select d.*, (select count(*) from cdf c where c.source is not distinct from d.source and c.below < d.u) as n_copies from uniform d
)
select doc_id, text, lang, source, n_chars, copy::int as copy, md5('{SEED}-order:' || draw || ':' || copy) as order_key
from (select *, unnest(range(1, n_copies + 1)) as copy from drawn where n_copies > 0)
"""
