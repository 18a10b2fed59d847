"""Exact top-k inner-product search by a Voronoi kNN join.

Vectors are scaled and floored to integers. An extra coordinate gives all data
the same length, so that the largest product is the smallest distance:
x' = (x, sqrt(M - |x|^2)), q' = (q, 0).

1. Pivots from a bounded sample cut data and queries into Voronoi cells, one for about
   QUERY_ROWS queries, so that data are never replicated more often than query blocks ask.
2. A query's reach is a distance within which k rows of other ids are certain to lie: the
   k-th of the bounded sample's rows, or what the summaries of the cells promise (their
   k + 1 smallest distances to the pivot, of different ids). A group's bound is the largest
   reach of its queries.
3. Data go to a group only if they can lie within the bound: by the distance to the group's
   pivot (triangle inequality, from both sides of the ring of its queries) and by the
   distance to the hyperplane between both cells.
4. Pairs of blocks are solved one by one: queries whose reach ends before the ring of the
   data block are left out, the others are compared exactly in integers; per query the best
   k of all blocks remain.

No bound prunes where distances concentrate (many dimensions without clusters): there every
group needs all data, and the join is a blocked scan with as many copies as groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

MOST_PIVOTS, SAMPLE = 1024, 2048
DATA_ROWS, QUERY_ROWS, DEAL = 4096, 512, 16


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer products of all rows; by floats where those are exact."""
    limit = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if limit < 2**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ y.T.astype(np.int64)


def _least(ids: np.ndarray, far: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` different ids of the smallest distances, and these distances, ascending."""
    order = np.lexsort((ids, far))
    _, first = np.unique(ids[order], return_index=True)
    at = order[np.sort(first)[:n]]
    return ids[at], far[at]


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    """Integers in the smallest type that holds them all."""
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.abs(x).max(initial=0) <= np.iinfo(t).max)
    return x.astype(kind).tobytes(), kind


class Pivots:
    """Distances in the lifted space."""

    def __init__(self, points: np.ndarray, reach: float):
        self.points, self.reach = points, reach
        #: Distances come from differences of squares up to ``reach``: what rounding may add.
        self.slack = 1e-6 * (1 + np.sqrt(reach))

    def lift(self, x: np.ndarray, data: bool) -> np.ndarray:
        x = x.astype(np.float64)
        extra = np.sqrt(np.maximum(self.reach - (x**2).sum(1), 0)) if data else np.zeros(len(x))
        return np.column_stack([x, extra])

    def distances(self, x: np.ndarray, data: bool, to: np.ndarray | None = None) -> np.ndarray:
        y, to = self.lift(x, data), self.points if to is None else to
        return np.sqrt(np.maximum((y**2).sum(1)[:, None] + (to**2).sum(1) - 2 * y @ to.T, 0))


def sample_reach(space: Pivots, q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Distance within which each query has ``k`` sample rows of other ids; infinite with fewer."""
    if len(s_ids) < k:
        return np.full(len(q), np.inf)
    far = space.distances(q, False, sample)
    far[q_ids[:, None] == s_ids] = np.inf
    return np.partition(far, k - 1, axis=1)[:, k - 1] + space.slack


class Bounds:
    """What the groups of queries need: rings around their pivots and the reach of their queries."""

    def __init__(self, space: Pivots, groups: list[int], ring: np.ndarray, reach: np.ndarray):
        self.space, self.groups = space, np.array(groups, np.int64)
        self.ring, self.reach = ring.reshape(-1, 2), reach
        self.apart = np.sqrt(((space.points[:, None, :] - space.points[None, self.groups, :]) ** 2).sum(2))

    def needed(self, x: np.ndarray) -> np.ndarray:
        """Which groups may need which data rows."""
        far = self.space.distances(x, True)
        cell = far.argmin(1)
        mine, own = far[:, self.groups], far[np.arange(len(x)), cell][:, None]
        reach = self.reach + self.space.slack
        apart = self.apart[cell]
        # every query of group i is at least as near to pivot i as to pivot j of the row's cell
        plane = np.where(apart > 0, (mine**2 - own**2) / np.maximum(2 * apart, 1e-300), 0)
        return (mine - self.ring[:, 1] <= reach) & (self.ring[:, 0] - mine <= reach) & (plane <= reach)


def search(rows: DataFrame, is_query, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` rows with the largest integer product.

    ``is_query``: a Column over ``id``. Components become floor(scale * x). A query's candidates
    are all rows with another id; with fewer than k of them, all come. Ties go to the smaller
    id. Vectors that are null or hold a null or non-finite component take no part, nor do
    null ids or vectors of another length than most. Repeated ids are candidates and
    queries row by row, never for rows of the same id. Vectors whose products may pass 64-bit
    integers raise an OverflowError. Other columns are ignored; an empty table gives an empty
    result.
    """
    space, placed, s_ids, sample, near, sizes, asked = _place(rows, is_query, k, scale, id_col, vector_col, pivots)
    if space is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bounds = _bounds(space, placed, asked)
    groups = bounds.groups.tolist()
    q_chunks = {i: -(-asked[i] // QUERY_ROWS) for i in groups}
    deals = {i: -(-n // DEAL) for i, n in q_chunks.items()}
    chunks = {j: -(-n // DATA_ROWS) for j, n in sizes.items()}
    spread = max(1, -(-sum(chunks.values()) // DEAL))

    def replicate(key: tuple, table: pa.Table) -> pa.Table:
        """One block of a cell's rows for each group that may need some of them."""
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<i8").reshape(len(ids), -1)[order]
        ids, cell, place = ids[order], key[0].as_py(), (key[0].as_py() * 31 + key[1].as_py()) % spread
        need, far = bounds.needed(x), space.distances(x, True)[:, cell]
        out = []
        for i, n in zip(groups, need.T):
            if n.any():
                out += [(i, deal, place, cell, float(far[n].min()), float(far[n].max()), ids[n].tobytes(), *_packed(x[n])) for deal in range(deals[i])]
        cols = list(zip(*out)) if out else [[]] * 9
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.string())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["to", "deal", "place", "cell", "low", "high", "d_ids", "d", "kind"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<i8").reshape(len(ids), -1)
        packed, kind = _packed(x)
        cols = [table.column("q_cell")[:1], pa.array([key[1].as_py() % deals[key[0].as_py()]], pa.int32()), *(pa.array([c], pa.binary()) for c in (ids.tobytes(), packed)), pa.array([kind]), pa.array([table.column("reach").to_numpy().tobytes()], pa.binary())]
        return pa.Table.from_arrays(cols, ["q_cell", "q_deal", "q_ids", "q", "q_kind", "q_reach"])

    blocks = placed.select("id", "v", "cell", vectors.chunk_of(1, vectors.lookup(chunks, "cell", 1)).alias("chunk")).groupBy("cell", "chunk").applyInArrow(replicate, "to int, deal int, place int, cell int, low double, high double, d_ids binary, d binary, kind string")
    queries = placed.where("q_cell >= 0").select("id", "v", "q_cell", "reach", vectors.chunk_of(2, vectors.lookup(q_chunks, "q_cell", 1)).alias("chunk")).groupBy("q_cell", "chunk").applyInArrow(gather, "q_cell int, q_deal int, q_ids binary, q binary, q_kind string, q_reach binary")
    queries = queries.withColumn("q_place", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, q_kind, reach, d_ids, d, kind, cell, low, high in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q", "q_kind", "q_reach", "d_ids", "d", "kind", "cell", "low", "high"))):
                q_ids, d_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(d_ids, "<i8")
                q, d = np.frombuffer(q, q_kind).reshape(len(q_ids), -1), np.frombuffer(d, kind).reshape(len(d_ids), -1)
                away = space.distances(q, False, space.points[cell : cell + 1])[:, 0]
                some = np.flatnonzero(np.maximum(away - high, low - away) <= np.frombuffer(reach) + space.slack)
                scores = _exact(q[some], d)
                mine = np.where(q_ids[some][:, None] == d_ids, np.iinfo(np.int64).min, scores)
                edge = np.partition(mine, len(d_ids) - k, axis=1)[:, -k][:, None] if len(d_ids) > k else np.iinfo(np.int64).min + 1
                row, at = np.nonzero((mine >= edge) & (q_ids[some][:, None] != d_ids))
                top = vectors.best(row, scores[row, at], d_ids[at], k)
                row, at = row[top], at[top]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[some][row]), pa.array(d_ids[at]), pa.array(scores[row, at])], ["query_id", "vec_id", "score"])

    met = (F.col("to") == F.col("q_cell")) & (F.col("place") == F.col("q_place")) & (F.col("deal") == F.col("q_deal"))
    pairs = blocks.join(queries, met).select("q_ids", "q", "q_kind", "q_reach", "d_ids", "d", "kind", "cell", "low", "high")
    return vectors.top(pairs.mapInArrow(solve, "query_id long, vec_id long, score long"), k)


def replicated_share(rows: DataFrame, is_query, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> float:
    """Of all pairs of a data row and a group of queries, the share that the bounds keep."""
    space, placed, _, _, _, _, asked = _place(rows, is_query, k, scale, id_col, vector_col, pivots)
    if space is None or not asked:
        return 0.0
    bounds = _bounds(space, placed, asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i8").reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([int(bounds.needed(x).sum())]), pa.array([batch.num_rows * len(bounds.groups)])], ["kept", "all"])

    kept, of = placed.select("v").mapInArrow(count, "kept long, all long").agg(F.sum("kept"), F.sum("all")).first()
    return kept / of


def _place(rows: DataFrame, is_query, k: int, scale: int, id_col: str, vector_col: str, pivots: int | None):
    """Pivots, all rows with their cells, the sample, and each cell's summary, size and queries."""
    scaled = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    # floor gives a long: what passes one is kept as it is, for the test of the products' size
    huge = F.exists("vector", lambda x: F.abs(x) * F.lit(float(scale)) >= F.lit(2.0**62))
    data = vectors.valid(rows, id_col, vector_col, zero_ok=True).select("id", F.when(huge, F.col("vector")).otherwise(scaled).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    total, reach, wanted = data.agg(F.count("*"), F.max(norm), F.count_if("query")).first()
    if not total:
        return (None,) * 7
    if reach >= 2.0**62:
        raise OverflowError("inner products may not fit 64-bit integers")
    s_ids, sample = vectors.sample(data, SAMPLE, total)
    space = Pivots(np.zeros((1, 1)), reach)
    lifted = space.lift(sample, True)
    space.points = vectors.k_means(lifted, pivots or max(1, min(MOST_PIVOTS, -(-wanted // QUERY_ROWS)))) if len(sample) else np.zeros((1, 1 + len(data.select("vector").first().vector)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = vectors.matrix(batch.column("vector")), batch.column("id").to_numpy()
            query = batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            own, to = space.distances(x, True), space.distances(x, False)
            bound = np.full(len(x), np.inf)
            bound[query] = sample_reach(space, ids[query], x[query], s_ids, lifted, k)
            cols = [own.argmin(1), own.min(1), np.where(query, to.argmin(1), -1), to.min(1), bound]
            packed = [v.tobytes() for v in x.astype("<i8")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary()), *(pa.array(c.astype(t)) for c, t in zip(cols, ("i4", "f8", "i4", "f8", "f8")))], ["id", "v", "cell", "far", "q_cell", "q_far", "bound"])

    placed = storage.written(data.mapInArrow(cells, "id long, v binary, cell int, far double, q_cell int, q_far double, bound double"), "voronoi")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, cell, far = (batch.column(c).to_numpy() for c in ("id", "cell", "far"))
            for j in np.unique(cell).tolist():
                had = kept.get(j, (np.empty(0, np.int64), np.empty(0)))
                kept[j] = _least(np.append(had[0], ids[cell == j]), np.append(had[1], far[cell == j]), k + 1)
        rows = [(j, *r) for j, (ids, far) in kept.items() for r in zip(ids.tolist(), far.tolist())]
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64()))], ["cell", "id", "far"])

    close = placed.select("id", "cell", "far").mapInArrow(smallest, "cell int, id long, far double").groupBy("cell", "id").agg(F.min("far").alias("far"))
    close = close.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("near"))
    near = {r.cell: (np.array([x.id for x in r.near]), np.array([x.far for x in r.near])) for r in close.collect()}
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asked = {r.q_cell: r.n for r in placed.where("q_cell >= 0").groupBy("q_cell").agg(F.count("*").alias("n")).collect()}
    # the summaries promise, for every group, k + 1 rows of different ids (a query's own is one at
    # most) within a distance of its pivot; a query is at most q_far from that
    apart = np.sqrt(((space.points[:, None, :] - space.points[None, :, :]) ** 2).sum(2))
    promise = {}
    for i in asked:
        _, found = _least(np.concatenate([ids for ids, _ in near.values()]), np.concatenate([apart[i, j] + d for j, (_, d) in near.items()]), k + 1)
        promise[i] = float(found[k]) if len(found) > k else float("inf")
    told = F.create_map(*[F.lit(x) for kv in promise.items() for x in kv])[F.col("q_cell")] if promise else F.lit(float("inf"))
    placed = placed.withColumn("reach", F.least("bound", F.coalesce(told, F.lit(float("inf"))) + F.col("q_far")))
    return space, placed, s_ids, sample, near, sizes, asked


def _bounds(space: Pivots, placed: DataFrame, asked: dict[int, int]) -> Bounds:
    found = placed.where("q_cell >= 0").groupBy("q_cell").agg(F.min("q_far").alias("low"), F.max("q_far").alias("high"), F.max("reach").alias("reach")).orderBy("q_cell").collect()
    return Bounds(space, [r.q_cell for r in found], np.array([(r.low, r.high) for r in found], float), np.array([r.reach for r in found], float))
