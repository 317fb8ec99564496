"""Approximate nearest neighbours by collision counting (operator 1).

Vectors are dealt by a hash of their id into blocks of bounded size. A block projects its
vectors on ``projections`` random lines, the same in every block, and keeps each projection as a
sorted array. A query opens a window around its own projection in each array. Windows widen by
virtual rehashing: the radius is multiplied by ``ratio``, and only the newly covered ends of the
arrays are read. A vector that lies in the windows of at least ``threshold`` of the projections
is verified by its exact distance. A query ends in a block when its ``k`` nearest so far lie
within the radius, or with every vector of the block verified, so that it always finds ``k``
where the block has as many. The nearest of all blocks are merged by partial aggregation.

Every query meets every block, in packs of queries; the block size grows with the table up to a
bound that fits a task, so that the packs sent grow slower than the pairs. No pair of a query
and a vector leaves a block but the ``k`` nearest.

Defined results: vectors that are null or zero or hold null or non-finite components take no
part, neither as query nor as candidate; a null id takes no part; vectors are searched among those
of their own length; an id that repeats is asked once, by its
least vector; ties of equal distance go to the smaller
id; rows that repeat an id other than the query's are candidates of their own; with fewer than
``k`` candidates all are returned; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    k: int = 10
    projections: int = 40
    threshold: float = 0.5  # share of the projections in whose windows a candidate lies
    first_share: float = 0.1  # share of a block that the first window of a projection covers
    ratio: float = 1.5
    nearness: float = 0.65  # a query ends when its k nearest lie within this share of the radius
    least_block: int = 4_096
    most_block: int = 65_536
    pack: int = 256  # queries that travel together
    seed: int = 11


NEAR = "query_id long, vec_id long, score double"
_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as ``v``, of rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return kept.filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull()) & finite)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def lines(dim: int, s: Settings) -> np.ndarray:
    """The directions of the projections; the same wherever they are drawn."""
    return np.random.default_rng(s.seed).standard_normal((dim, s.projections))


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, s: Settings) -> None:
        self.ids, self.v, self.s = ids, v, s
        self.a = lines(v.shape[1], s)
        p = v @ self.a
        self.order = np.argsort(p, 0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(p, self.order.T.astype(np.int64), 0).T.copy()
        # the first half window: that which covers ``first_share`` of a projection about its middle
        n = len(ids)
        reach = max(1, int(n * s.first_share / 2))
        low, high = max(0, n // 2 - reach), min(n - 1, n // 2 + reach)
        widths = (self.sorted[:, high] - self.sorted[:, low]) / 2
        self.start = max(float(np.median(widths)), 1e-9)

    def search(self, query_id: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest found, by distance and id."""
        s, n, m = self.s, len(self.ids), self.s.projections
        at = q @ self.a
        counts = np.zeros(n, np.int16)
        verified = np.zeros(n, bool)
        own = self.ids == query_id
        need = max(1, int(np.ceil(s.threshold * m)))
        lo = hi = np.array([np.searchsorted(self.sorted[j], at[j]) for j in range(m)])
        found, distance = np.empty(0, np.int64), np.empty(0)
        half = self.start
        while True:
            new_lo = np.array([np.searchsorted(self.sorted[j], at[j] - half, "left") for j in range(m)])
            new_hi = np.array([np.searchsorted(self.sorted[j], at[j] + half, "right") for j in range(m)])
            new_lo, new_hi = np.minimum(new_lo, lo), np.maximum(new_hi, hi)
            ends = [self.order[j, new_lo[j] : lo[j]] for j in range(m)] + [self.order[j, hi[j] : new_hi[j]] for j in range(m)]
            counts += np.bincount(np.concatenate(ends), minlength=n).astype(np.int16)
            lo, hi = new_lo, new_hi
            fresh = np.flatnonzero((counts >= need) & ~verified)
            verified[fresh] = True
            fresh = fresh[~own[fresh]]
            d = np.sqrt(((self.v[fresh] - q) ** 2).sum(1))
            found, distance = np.concatenate((found, fresh)), np.concatenate((distance, d))
            best = np.lexsort((self.ids[found], distance))[: s.k]
            found, distance = found[best], distance[best]
            # a vector at distance r is as likely as not within about 0.67 r on a line
            if (len(found) >= s.k and distance[-1] * s.nearness <= half) or ((lo == 0).all() and (hi == n).all()):
                return self.ids[found], distance
            half *= s.ratio


def search_block(s: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(vectors: pa.Table, packs: pa.Table) -> pa.Table:
        if not vectors.num_rows or not packs.num_rows:
            return pa.Table.from_pylist([], schema=_NEAR)
        ids = vectors.column("vec_id").to_numpy()
        block = Block(ids, _matrix(vectors.column("v")), s)
        out = []
        for row in packs.to_pylist():
            q_ids = np.frombuffer(row["ids"], np.int64)
            for q_id, q in zip(q_ids, np.frombuffer(row["vectors"], np.float64).reshape(len(q_ids), -1), strict=True):
                near, distance = block.search(int(q_id), q)
                out.append(pa.table([pa.array(np.full(len(near), q_id)), pa.array(near), pa.array(distance)], schema=_NEAR))
        return pa.concat_tables(out)

    return run


def _packs(table: pa.Table) -> pa.Table:
    v = _matrix(table.column("v"))
    return pa.table({"dim": table.column("dim")[:1], "blocks": table.column("blocks")[:1], "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())})


def nearest(vectors: DataFrame, is_query: Column, settings: Settings | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row that
    ``is_query`` (a condition on vec_id) selects, among all other rows of its length."""
    s = settings or Settings()
    spark = vectors.sparkSession
    every = usable(vectors).withColumn("dim", F.size("v"))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.col("n")
    rows = F.least(F.greatest(F.floor(n / max(1, 2 * slots)), F.lit(s.least_block)), F.lit(s.most_block))
    sizes = every.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    # one row for each length of vectors
    sizes = F.broadcast(sizes.select("dim", F.ceil(n / rows).alias("blocks"), F.greatest(F.ceil(F.col("q") / s.pack), F.lit(1)).alias("packs")))
    # rows that repeat an id still spread: the vector has its part in the hash
    placed = every.join(sizes, "dim").withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).select("vec_id", "v", "dim", "b")
    once = every.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("q"))
    queries = once.select("vec_id", "q.v", "q.dim").join(sizes, "dim").withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.col("packs")).cast("int"))
    packed = queries.select("vec_id", "v", "dim", "blocks", "pack").groupBy("dim", "blocks", "pack").applyInArrow(_packs, "dim int, blocks long, ids binary, vectors binary")
    sent = packed.select("dim", "ids", "vectors", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("b"))
    near = placed.groupBy("dim", "b").cogroup(sent.groupBy("dim", "b")).applyInArrow(search_block(s), NEAR)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= s.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
