"""Exact top-k by inner product, in buckets of vectors of similar length (operator 12).

Rows become vectors of integers. They are grouped by length: classes by quantiles of the length, the
longest first, cut by a hash of the row into groups that fit a task. A query first meets the class of
the longest vectors; the ``k``-th best score there is a threshold that its result can't fall below.
A further class gets only those queries whose threshold its longest vector could reach.

In a task the vectors of a group lie in buckets, by falling length. For a query and a bucket the
threshold over both lengths is a local bound on the cosine. It decides how the bucket is pruned:

* over 1: the bucket, and with it all shorter ones, is left out;
* by coordinates: the bound on the cosine confines each coordinate of a unit vector to an interval
  about the query's. The bucket's sorted coordinates tell how much the query's ``focus`` largest ones
  leave; where the narrowest leaves less than a share ``narrow``, its vectors are looked up there,
  those outside the other intervals dropped, and then those whose known coordinates and the lengths
  of the rest stay below the threshold;
* by length, otherwise: the vectors too short to reach the threshold are a tail of the bucket.

What is left is verified by exact integer products, and thresholds rise from bucket to bucket. No
bound is tighter than the truth, so results are those of brute force.

Defined results: vectors that are null or hold null or non-finite components take no part, neither
do null ids; zero vectors do; components and scores beyond 64 bits count as the last that fits; vectors meet
those with as many components; an id that repeats is asked once, by its least vector, while all of its
rows are candidates for others; ties go to the smaller id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.integer_vectors import best, integer_vectors, matrix, packs, pair_products, products, unpacked, wave
from pluvio.llm.shared import cut


@dataclass(frozen=True)
class Settings:
    k: int = 5
    classes: int = 16  # of length
    most_block: int = 32_768  # vectors of a group
    bucket: int = 2_048  # vectors with one local threshold
    pack: int = 256  # queries that travel together
    wave: int = 8_192  # queries that one task holds
    focus: int = 3  # coordinates that are looked up
    narrow: float = 0.5  # share of a bucket below which the look-up is worth it


NEAR = "query_id long, vec_id long, score long"
_NEAR = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])
_NONE = np.iinfo(np.int64).min // 4
_SLACK = 1e-9


class Bucket:
    """Vectors of similar length, the longest first."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
        self.ids, self.v, self.norms = ids, v, norms
        self._unit: np.ndarray | None = None

    @property
    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.v / np.maximum(self.norms, 1e-300)[:, None]
            self.order = np.argsort(self._unit, 0, kind="stable")
            self.sorted = np.take_along_axis(self._unit, self.order, 0)
        return self._unit


class Search:
    """The best of some queries so far, and their thresholds."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, s: Settings) -> None:
        self.q_ids, self.q, self.s = q_ids, q, s
        self.norms = np.sqrt((q * q).sum(1))
        self.least = floor.copy()  # scores below it aren't wanted
        self.found = [np.empty(0, np.int64)] * 3  # query, place in ids, score

    def bounds(self, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """Whether a bucket can hold something for each query, and the least cosine wanted there."""
        reach = self.norms * longest * (1 + _SLACK)
        wanted = self.least - 0.5  # scores are integers
        cosine = np.where(wanted <= 0, -1.0, np.maximum(wanted, 0) / np.maximum(reach, 1e-300))
        return wanted <= reach, cosine

    def take(self, of: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        other = (ids != self.q_ids[of]) & (score >= self.least[of])
        of, ids, score = (np.concatenate((a, b[other])) for a, b in zip(self.found, (of, ids, score), strict=True))
        kept = best(of, score, ids, self.s.k)
        self.found = [of[kept], ids[kept], score[kept]]
        count = np.bincount(self.found[0], minlength=len(self.q_ids))
        full = np.flatnonzero(count >= self.s.k)
        if len(full):
            last = np.cumsum(count)[full] - 1  # kept are sorted by query and rank
            self.least[full] = np.maximum(self.least[full], self.found[2][last])

    def by_length(self, b: Bucket, which: np.ndarray) -> None:
        wanted = np.maximum(self.least[which] - 0.5, 0) / np.maximum(self.norms[which], 1e-300) * (1 - _SLACK)
        length = np.where(wanted <= 0, len(b.ids), np.searchsorted(-b.norms, -wanted, "right"))
        n = int(length.max(initial=0))
        if not n:
            return
        score = products(self.q[which], b.v[:n])
        score[np.arange(n)[None] >= length[:, None]] = _NONE
        score[b.ids[None, :n] == self.q_ids[which][:, None]] = _NONE
        low = self.least[which]
        if n > self.s.k:  # all below the k-th of this bucket can go
            low = np.maximum(low, np.partition(score, n - self.s.k, 1)[:, n - self.s.k])
        i, j = np.nonzero((score >= low[:, None]) & (score > _NONE))
        self.take(which[i], b.ids[j], score[i, j])

    def by_coordinate(self, b: Bucket, which: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Looks up the queries for which that leaves few vectors; returns the other ones."""
        unit = b.unit
        q = self.q[which] / self.norms[which][:, None]
        f = np.argsort(-np.abs(q), 1, kind="stable")[:, : self.s.focus]
        alpha, beta = np.arccos(np.clip(np.take_along_axis(q, f, 1), -1, 1)), np.arccos(np.clip(cosine - _SLACK, -1, 1))[:, None]
        low = np.cos(np.minimum(np.pi, alpha + beta)) - 1e-7
        high = np.cos(np.maximum(0.0, alpha - beta)) + 1e-7
        first, end = np.zeros(f.shape, np.int64), np.zeros(f.shape, np.int64)
        for c in np.unique(f):
            at = f == c
            first[at] = np.searchsorted(b.sorted[:, c], low[at], "left")
            end[at] = np.searchsorted(b.sorted[:, c], high[at], "right")
        cover = end - first
        narrowest = cover.argmin(1)
        few = cover.min(1) < self.s.narrow * len(b.ids)
        of, at = [], []
        for j in np.flatnonzero(few):
            m = narrowest[j]
            near = b.order[first[j, m] : end[j, m], f[j, m]]
            x = unit[near][:, f[j]]
            inside = ((x >= low[j]) & (x <= high[j])).all(1)
            near, x = near[inside], x[inside]
            rest = np.sqrt(max(0.0, 1 - (q[j, f[j]] ** 2).sum())) * np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
            upper = (x @ q[j, f[j]] + rest + 1e-7) * b.norms[near] * self.norms[which[j]]
            near = near[upper >= self.least[which[j]] - 0.5]
            of.append(np.full(len(near), which[j]))
            at.append(near)
        if of:
            i, j = np.concatenate(of), np.concatenate(at)
            for low_i in range(0, len(i), 65_536):
                a, c = i[low_i : low_i + 65_536], j[low_i : low_i + 65_536]
                self.take(a, b.ids[c], pair_products(self.q[a], b.v[c]))
        return which[~few]


def search(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Queries (their places), ids and scores of the best of one group of vectors."""
    norms = np.sqrt((v * v).sum(1))
    order = np.lexsort((ids, -norms))
    found = Search(q_ids, q, least, s)
    for low in range(0, len(ids), s.bucket):
        at = order[low : low + s.bucket]
        b = Bucket(ids[at], v[at], norms[at])
        alive, cosine = found.bounds(float(b.norms[0]))
        if not alive.any():
            break
        rest = np.flatnonzero(alive & (cosine <= 0))
        looked = np.flatnonzero(alive & (cosine > 0))
        if len(looked):
            rest = np.concatenate((rest, found.by_coordinate(b, looked, cosine[looked])))
        if len(rest):
            found.by_length(b, rest)
    return found.found


def _run(s: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows or not sent.num_rows:
            return _NEAR.empty_table()
        ids, v = rows.column("vec_id").to_numpy(), matrix(rows.column("v"))
        out = []
        for q_ids, q, extra in unpacked(sent):
            least = np.floor(extra[:, 0] - np.abs(extra[:, 0]) * 1e-12).astype(np.int64)  # no double is above its integer
            of, near, score = search(ids, v, q_ids, q, least, s)
            out.append(pa.table([pa.array(q_ids[of]), pa.array(near), pa.array(score)], schema=_NEAR))
        return pa.concat_tables(out)

    return run


def _ranked(near: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(placed: DataFrame, classes: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """The best of each query (with ``least``) in the groups of ``classes``, of those queries that a class could help."""
    met = queries.join(F.broadcast(classes), "dim")
    able = met.filter((F.col("least") <= 0) | (F.col("norm") * F.col("longest") * (1 + _SLACK) >= F.col("least") - 0.5))
    by = ["dim", "cls"]
    asked = able.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"))
    asked = cut(asked.withColumn("waves", F.ceil(F.col("n_queries") / s.wave)))
    more = F.array(F.col("least").cast("double"))
    sent = packs(able.join(F.broadcast(asked), by).withColumn("wave", wave(F.col("waves"))).withColumn("more", more), by, s.pack)
    groups = F.broadcast(classes.select(*by, "parts"))
    sent = sent.join(groups, by).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = placed.join(F.broadcast(asked), by).withColumn("wave", F.explode(F.sequence(F.lit(0).cast("long"), F.col("waves") - 1)))
    key = [*by, "part", "wave"]
    near = rows.select(*key, "vec_id", "v").groupBy(*key).cogroup(sent.select(*key, "ids", "vectors", "extra").groupBy(*key)).applyInArrow(_run(s), NEAR)
    return _ranked(near, s.k)


def top_products(vectors: DataFrame, is_query: Column, settings: Settings | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` greatest inner products of each row that
    ``is_query`` (a condition on vec_id) selects, with the other rows. Joins are broadcast from the
    classes: ``classes`` rows for each number of components."""
    s = settings or Settings()
    every = integer_vectors(vectors).withColumn("dim", F.col("dim").cast("long"))
    steps = [i / s.classes for i in range(1, s.classes)] or [1.0]
    cuts = cut(every.groupBy("dim").agg(F.percentile_approx("norm", steps, 1_000).alias("cuts")))
    classed = every.join(F.broadcast(cuts), "dim").withColumn("cls", F.size(F.filter("cuts", lambda c: c > F.col("norm"))).cast("long")).drop("cuts")
    sizes = classed.groupBy("dim", "cls").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    classes = cut(sizes.select("dim", "cls", "longest", F.ceil(F.col("n") / s.most_block).alias("parts")))
    placed = classed.join(F.broadcast(classes.select("dim", "cls", "parts")), ["dim", "cls"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    once = every.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "dim", "norm")).alias("q"))
    queries = once.select("query_id", "q.v", "q.dim", "q.norm")
    first = cut(_searched(placed, classes.filter("cls = 0"), queries.withColumn("least", F.lit(_NONE)), s))
    reached = first.filter(F.col("rank") == s.k).select("query_id", F.col("score").alias("least"))
    narrowed = queries.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(_NONE)))
    rest = _searched(placed, classes.filter("cls > 0"), narrowed, s)
    return _ranked(first.drop("rank").unionByName(rest.drop("rank")), s.k)


#: The same in DuckDB's SQL, for vectors of one size.
TOP_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
