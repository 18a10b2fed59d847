"""Common parts of the vector searches: valid rows, bounded samples, blocks, top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096  # vectors a data block
QUERY_ROWS = 512  # vectors a query block


def valid(rows: DataFrame, id_col: str, vector_col: str, *, zero_ok: bool) -> DataFrame:
    """id, vector (array<double>), query-ready: no null id, vector or component, none that is not
    finite, no zero vector unless ``zero_ok``; of the length that most rows have (the largest of
    equals), since vectors of unequal lengths have no product."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if not zero_ok:
        out = out.where(F.exists(v, lambda x: x != 0))
    lengths = out.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return out.where(F.size(v) == (lengths[0].n if lengths else 0))


def sample(rows: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of about ``n`` rows, each drawn by itself, so that copies can't exceed the bound."""
    drawn = rows if total <= n else rows.where(F.rand(7) < F.lit(n / total))
    found = sorted((r.id, tuple(r.vector)) for r in drawn.collect())
    ids = np.array([i for i, _ in found], np.int64)
    return ids, np.array([v for _, v in found], float) if found else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array<double> column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each point, some points at a time."""
    square, step = (centres**2).sum(1), max(1, (4 << 20) // max(1, len(centres)))
    parts = [np.argmin(square - 2 * points[a : a + step] @ centres.T, axis=1) for a in range(0, len(points), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spread start points; never more centres than different points."""
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        n = np.bincount(at, minlength=len(centres))
        for d in range(points.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(at, points[:, d], len(centres)) / np.maximum(n, 1), centres[:, d])
    return centres


def best(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each owner, ties to the smaller id, by owner and rank."""
    order = np.lexsort((ids, -scores, owner))
    o = owner[order]
    new = np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.empty(0, bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    return order[rank < k]


def chunk_of(salt: int, counts: Column) -> Column:
    """A group's row to one of so many chunks."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), counts).cast("int")


def top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def lookup(values: dict[int, int], key: str, default: int) -> Column:
    """A small driver-side table as an expression."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(int(x)) for kv in values.items() for x in kv])[F.col(key)], F.lit(default))
