"""Vectors of integers, and tiles of queries and candidates, for the exact searches.

A search meets a set of queries with all rows. Candidates are dealt to groups of bounded size and
queries, in packs, to waves of bounded size; one task holds one group and one wave, and only the
best of each query leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of products up to here are exact in double precision.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, *carry: str, scale: int = 256) -> DataFrame:
    """vec_id, ``carry``, the integers floor(scale * x) as ``v`` (array<double>), their number ``dim`` and the
    length ``norm``, of rows that take part: null ids, null vectors and null or non-finite components don't."""
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ok)
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    out = kept.select(F.col("vec_id").cast("long").alias("vec_id"), *carry, v.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c * c)
    return out.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(squares))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a.flatten()) else np.zeros((len(a), 0))


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    return not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < EXACT


def _held(exact: np.ndarray) -> np.ndarray:
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, exact; beyond 64 bits, the last integer of 64."""
    if _fits(a, b):
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in b]
    return _held(np.array([[sum(int(x) * y for x, y in zip(r, o, strict=True)) for o in whole] for r in a], object).reshape(len(a), len(b)))


def pair_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of each row of ``a`` with the same row of ``b``, as exact."""
    if _fits(a, b):
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return _held(np.array([sum(int(x) * int(y) for x, y in zip(r, o, strict=True)) for r, o in zip(a, b, strict=True)], object))


def best(of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each ``of``: higher scores first, ties by the smaller id."""
    order = np.lexsort((ids, -score, of))
    grouped = of[order]
    start = np.flatnonzero(np.concatenate(([True], grouped[1:] != grouped[:-1]))) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def packs(queries: DataFrame, by: list[str], size: int) -> DataFrame:
    """``queries`` (long ``by``, wave and packs, query_id, v, and ``more``, an array of doubles as long in each) in
    packs: one row for a pack, with what its queries hold one after the other."""
    keys = [*by, "wave"]
    fields = [*((c, pa.int64()) for c in keys), *((c, pa.binary()) for c in ("ids", "vectors", "extra"))]

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        held = [t.column("query_id").to_numpy(), *(matrix(t.column(c)) for c in ("v", "more"))]
        row = [*(k.as_py() for k in key[:-1]), *(np.ascontiguousarray(x).tobytes() for x in held)]
        return pa.Table.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, fields, strict=True)], names=[c for c, _ in fields])

    dealt = queries.withColumn("pack", F.pmod(F.shiftright(F.xxhash64("query_id"), 20), F.ceil(F.col("n_queries") / F.col("waves") / size)))
    ddl = ", ".join(f"{c} {'binary' if t == pa.binary() else 'long'}" for c, t in fields)
    return dealt.select(*keys, "pack", "query_id", "v", "more").groupBy(*keys, "pack").applyInArrow(pack, ddl)


def wave(waves: Column) -> Column:
    """The wave of a query."""
    return F.pmod(F.xxhash64("query_id"), waves)


def unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors and extra of each pack."""
    for row in table.select(["ids", "vectors", "extra"]).to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        yield ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1), np.frombuffer(row["extra"], np.float64).reshape(len(ids), -1)
