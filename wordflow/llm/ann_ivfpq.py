"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

1. Coarse centroids (about the square root of the number of rows) and codebooks of residuals
   are fitted on a bounded sample; every row is indexed: a cell, and one byte a part.
2. A query's exact products with the sample give a floor: its k-th best of all rows is no worse.
   Its best sample rows also tell how far a product lies from that of the row's cell or code, in
   lengths of what cell or code leave out of the row. A query visits every cell whose product,
   raised by that much of the cell's radius, reaches the floor; besides as many of the best as
   hold TARGET of the nearest neighbours of the sample's rows, and the cells about itself. So
   clustered vectors need few cells, vectors spread evenly over a sphere most. The rule is the
   same at any size.
3. A query estimates its products with all rows of the visited cells by asymmetric distance
   tables from the codes alone. A row is scored on its original vector where its estimate, raised by what
   its code may leave out, reaches the floor (or the query's estimate of itself, which near
   copies share), and where it is one of about ``rerank`` of the whole search by the
   sample's codes.

Cells go in blocks of bounded size, large cells in several; a query goes once to each block
that holds a cell it visits. A pair of a data block and a block of queries is solved by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

#: Bounds of the fit: most cells, sample rows, sample rows that act as queries, and that set the bar.
MOST_CELLS, SAMPLE, TRIALS, BAR_ROWS = 1024, 16384, 256, 8192
PARTS = 16
TARGET = 0.98
#: Rows that a query scores exactly, as a multiple of the root of the table's rows.
RERANK_ROOT = 2.0
#: Best sample rows that tell a query how much cells and codes leave out, and what is added for rows outside the sample.
TELL, SLACK = 256, 1.25
DATA_ROWS, QUERY_ROWS, DEAL = 4096, 256, 32
CELLS_AT_ONCE = 2 << 20  # estimates, or components scored exactly, at a time


@dataclass
class Index:
    """Coarse centroids and one codebook a part of the residual."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, cells: int, parts: int) -> "Index":
        centres = vectors.k_means(points, cells)
        rest = points - centres[vectors.nearest(points, centres)]
        cuts = np.linspace(0, points.shape[1], min(parts, points.shape[1]) + 1).astype(int)
        return cls(centres, [vectors.k_means(rest[:, a:b], 256) for a, b in zip(cuts, cuts[1:])], cuts)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centres[cell]
        return np.column_stack([vectors.nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.column_stack([book[codes[:, part]] for part, book in enumerate(self.books)])

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of each query's parts with each book's entries."""
        return [(q[:, a:b] @ book.T).astype(np.float32) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def estimate(self, near: np.ndarray, tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Products of each query with coded rows, whose centroids' products are ``near``."""
        out = np.empty((len(near), len(codes)), np.float32)
        out[:] = near
        for part, table in enumerate(tables):
            out += table[:, codes[:, part]]
        return out


def visits(points: np.ndarray, index: Index, k: int, target: float = TARGET) -> int:
    """How many of the best cells hold ``target`` of the ``k`` nearest of different sample points."""
    points = np.unique(points, axis=0)
    at = np.linspace(0, len(points) - 1, min(TRIALS, len(points))).astype(int)
    some = points[at]
    scores = some @ points.T
    scores[np.arange(len(at)), at] = -np.inf
    found = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = np.empty((len(some), len(index.centres)), np.int64)
    np.put_along_axis(place, np.argsort(-(some @ index.centres.T), axis=1, kind="stable"), np.arange(len(index.centres))[None], axis=1)
    depth = np.sort(np.take_along_axis(place, vectors.nearest(points, index.centres)[found], axis=1).reshape(-1))
    return int(depth[min(len(depth) - 1, math.ceil(target * len(depth)))]) + 1


def search(rows: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, probes: int | None = None, rerank: int | None = None, parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score (the inner product in double) of each query's ``k`` nearest found.

    ``is_query``: a Column over ``id``. Candidates are all rows with another id. Ties go to the
    smaller id. Empty cells are no probes; while the probed cells hold fewer than k candidates,
    the next are probed too, at any size of the table. ``cells`` (by default the root of the
    rows, at most MOST_CELLS), ``probes`` (measured) and ``rerank`` (RERANK_ROOT times the root
    of the rows) may be given; given probes and reranks are all there are. Null, zero and non-finite vectors take no part, nor do null ids
    or vectors of another length than most. Repeated ids are queries and candidates row by
    row. Other columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    data = vectors.valid(rows, id_col, vector_col, zero_ok=False)
    total = data.count()
    s_ids, points = vectors.sample(data, SAMPLE, max(total, 1))
    if not len(points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    root = math.isqrt(max(total, 1) - 1) + 1
    index = Index.fit(points, cells or min(MOST_CELLS, root), parts)
    by_cell, by_code = probes is None, rerank is None
    probes = probes or visits(points, index, k)
    goal = rerank or max(k, math.ceil(RERANK_ROOT * root))
    some = np.linspace(0, len(points) - 1, min(BAR_ROWS, len(points))).astype(int)
    s_ids, points = s_ids[some], points[some]
    s_cell = vectors.nearest(points, index.centres)
    s_codes = index.encode(points, s_cell)
    s_radius, s_error = (np.linalg.norm(points - near, axis=1) for near in (index.centres[s_cell], index.decode(s_cell, s_codes)))
    passing = max(k, math.ceil(goal * len(points) / total))  # sample rows that reach the bar

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column("vector"))
            cell = vectors.nearest(x, index.centres)
            codes = index.encode(x, cell)
            radius, error = (np.linalg.norm(x - near, axis=1) for near in (index.centres[cell], index.decode(cell, codes)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("query"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(radius), pa.array(error.astype(np.float32))],
                ["id", "query", "cell", "code", "v", "radius", "error"],
            )

    indexed = storage.written(data.withColumn("query", F.coalesce(is_query, F.lit(False))).mapInArrow(assign, "id long, query boolean, cell int, code binary, v binary, radius double, error float"), "ivfpq")
    sizes = {r.cell: (r.n, r.asked, r.radius) for r in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("query").alias("asked"), F.max("radius").alias("radius")).collect()}
    # neighbouring cells lie in a block: in the order of the centroids' main direction
    live = np.array(sorted(sizes), np.int64)
    middle = index.centres[live] - index.centres[live].mean(0)
    live = live[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]
    counts = np.array([sizes[c][0] for c in live.tolist()])
    first, pieces, at, room = {}, {}, 0, 0  # block of each cell, and in how many it lies
    for c, n in zip(live.tolist(), counts.tolist()):
        if n > DATA_ROWS:
            at += room > 0
            first[c], pieces[c], room = at, -(-n // DATA_ROWS), 0
            at += pieces[c]
        else:
            if room + n > DATA_ROWS:
                at, room = at + 1, 0
            first[c], pieces[c] = at, 1
            room += n
    blocks_of = [np.arange(first[c], first[c] + pieces[c]) for c in live.tolist()]
    reach = np.zeros(len(index.centres))  # radius of each cell
    reach[live] = [sizes[c][2] for c in live.tolist()]
    asked = sum(n for _, n, _ in sizes.values())
    chunks = max(1, -(-asked // QUERY_ROWS))
    deals = -(-chunks // DEAL)

    def pack(table: pa.Table) -> pa.Table:
        """A block of data, by cell and id."""
        ids, cell = table.column("id").to_numpy(), table.column("cell").to_numpy()
        order = np.lexsort((ids, cell))
        table = table.take(pa.array(order))
        cols = [ids[order].tobytes(), cell[order].astype("<i4").tobytes(), table.column("error").to_numpy().astype("<f4").tobytes(), *(b"".join(table.column(c).to_pylist()) for c in ("code", "v"))]
        return pa.Table.from_arrays([table.column("block")[:1], *(pa.array([x], pa.binary()) for x in cols)], ["block", "d_ids", "d_cell", "d_error", "codes", "d"])

    block = vectors.lookup(first, "cell", 0) + vectors.chunk_of(1, vectors.lookup(pieces, "cell", 1))
    blocks = indexed.select("id", "cell", "code", "v", "error", block.alias("block")).groupBy("block").applyInArrow(pack, "block int, d_ids binary, d_cell binary, d_error binary, codes binary, d binary")
    blocks = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """A chunk of queries, once for each block that some of them visit.

        bar: the estimate that a row must reach, or the floor it must reach when raised by its error
        times the third number; mine: (query, cell) of all visits there."""
        ids = table.column("id").to_numpy()
        q = np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(len(ids), -1)
        near = (q @ index.centres.T).astype(np.float32)
        order = np.argsort(-near[:, live], axis=1, kind="stable")
        _, one = np.unique(ids, return_inverse=True)  # all rows of an id are in the chunk
        own = np.zeros((one.max() + 1, len(live)), np.int64)
        place = np.empty(len(index.centres), np.int64)
        place[live] = np.arange(len(live))
        np.add.at(own, (one, place[table.column("cell").to_numpy()]), 1)
        others = np.cumsum(np.take_along_axis(counts - own[one], order, axis=1), axis=1)
        mine = np.zeros((len(ids), len(index.centres)), bool)
        np.put_along_axis(mine, live[order], np.arange(len(live)) < np.maximum(probes, (others < k).sum(1) + 1)[:, None], axis=1)
        bar, floor, lift = np.full(len(ids), -np.inf), np.full(len(ids), np.inf), np.zeros(len(ids))
        home, length = table.column("cell").to_numpy(), np.linalg.norm(q, axis=1)
        own_code = index.encode(q, home)
        own_guess = np.einsum("qd,qd->q", q, index.decode(home, own_code))
        away = np.maximum(0, length[:, None] ** 2 - 2 * q @ index.centres[live].T + (index.centres[live] ** 2).sum(1))
        for a in range(0, len(ids), step := max(1, CELLS_AT_ONCE // len(points))):
            x = slice(a, a + step)
            guess = index.estimate(near[x][:, s_cell], index.tables(q[x]), s_codes)
            same = ids[x][:, None] == s_ids
            if by_cell or by_code:
                exact = q[x] @ points.T
                exact[same] = -np.inf
                tell = min(max(k, TELL), len(points))
                top = np.argpartition(exact, len(points) - tell, axis=1)[:, -tell:]
                best = np.take_along_axis(exact, top, axis=1)
                real = np.isfinite(best)
                floor[x] = np.partition(best, tell - k, axis=1)[:, -k] if tell >= k else -np.inf
                missed = lambda told, length: np.where(real & (length[top] > 0), best - np.take_along_axis(told, top, axis=1), 0) / np.where(length[top] > 0, length[top], 1)  # noqa: E731, B023
                lift[x] = np.minimum(SLACK * np.maximum(missed(guess, s_error).max(1), 0), length[x])
                rise = np.minimum(SLACK * np.maximum(missed(near[x][:, s_cell], s_radius).max(1), 0), length[x])
                floor[x] -= 1e-5 * np.abs(np.where(np.isfinite(floor[x]), floor[x], 0))
            if by_cell:
                close = away[x] <= 1.1 * np.take_along_axis(away[x], place[home[x]][:, None], axis=1)
                mine[np.ix_(np.arange(x.start, min(x.stop, len(ids))), live)] |= close | (near[x][:, live] + rise[:, None] * reach[live] >= floor[x, None])
            guess[~mine[x][:, s_cell] | same] = -np.inf
            if passing <= guess.shape[1]:
                bar[x] = np.partition(guess, guess.shape[1] - passing, axis=1)[:, -passing]
        bar -= 1e-5 * np.abs(np.where(np.isfinite(bar), bar, 0))  # estimates may differ by rounding
        floor = np.minimum(floor, own_guess - 1e-5 * np.abs(own_guess)) if by_code else np.full(len(ids), np.inf)
        bar = np.column_stack([bar, floor, lift])
        to: dict[int, list[int]] = {}
        for i, c in enumerate(live.tolist()):
            for b in blocks_of[i].tolist():
                to.setdefault(b, []).append(c)
        deal, out = key[0].as_py() % deals, []
        for b, own_cells in to.items():
            some = np.flatnonzero(mine[:, own_cells].any(1))
            if len(some):
                seen = np.argwhere(mine[some][:, own_cells]).astype("<i4")
                seen[:, 1] = np.array(own_cells)[seen[:, 1]]
                out.append((b, deal, ids[some].tobytes(), q[some].tobytes(), bar[some].tobytes(), seen.tobytes()))
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(x, pa.int32() if i < 2 else pa.binary()) for i, x in enumerate(cols)], ["q_block", "q_deal", "q_ids", "q", "bar", "seen"])

    queries = indexed.where("query").select("id", "cell", "v", vectors.chunk_of(2, F.lit(chunks)).alias("chunk")).groupBy("chunk").applyInArrow(gather, "q_block int, q_deal int, q_ids binary, q binary, bar binary, seen binary")

    def pairs_of(near: np.ndarray, tables: list[np.ndarray], bar: np.ndarray, q_ids: np.ndarray, d_ids: np.ndarray, d_error: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) whose estimate reaches the query's bar, or raised by the row's error its floor."""
        guess = index.estimate(near[:, None], tables, codes)
        least = np.minimum(bar[:, :1], bar[:, 1:2] - bar[:, 2:] * d_error)
        return np.nonzero((guess >= least) & (q_ids[:, None] != d_ids))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("d_ids", "d_cell", "d_error", "codes", "d", "q_ids", "q", "bar", "seen")
        for batch in batches:
            for d_ids, d_cell, d_error, codes, d, q_ids, q, bar, seen in zip(*(batch.column(c) for c in names)):
                d_ids, d_cell, d_error, q_ids = (np.frombuffer(x.as_buffer(), t) for x, t in ((d_ids, "<i8"), (d_cell, "<i4"), (d_error, "<f4"), (q_ids, "<i8")))
                codes, d = np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(d_ids), -1), np.frombuffer(d.as_buffer()).reshape(len(d_ids), -1)
                q, bar, seen = np.frombuffer(q.as_buffer()).reshape(len(q_ids), -1), np.frombuffer(bar.as_buffer()).reshape(-1, 3), np.frombuffer(seen.as_buffer(), "<i4").reshape(-1, 2)
                near, tables = (q @ index.centres.T).astype(np.float32), index.tables(q)
                who, row, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
                edges = np.searchsorted(d_cell, [np.arange(len(index.centres)), np.arange(1, len(index.centres) + 1)])
                for c in np.unique(d_cell).tolist():
                    x, y = int(edges[0, c]), int(edges[1, c])
                    visitors, step = seen[seen[:, 1] == c, 0], max(1, CELLS_AT_ONCE // (y - x) // q.shape[1])
                    for a in range(0, len(visitors), step):
                        v = visitors[a : a + step]
                        i, j = pairs_of(near[v, c], [t[v] for t in tables], bar[v], q_ids[v], d_ids[x:y], d_error[x:y], codes[x:y])
                        i, j = v[i], j + x
                        for b in range(0, len(i), some := max(1, CELLS_AT_ONCE // q.shape[1])):
                            iq, jd = i[b : b + some], j[b : b + some]
                            exact = np.einsum("pd,pd->p", q[iq], d[jd])
                            top = vectors.best(iq, exact, d_ids[jd], k)
                            who.append(iq[top])
                            row.append(jd[top])
                            score.append(exact[top])
                who, row, score = np.concatenate(who), np.concatenate(row), np.concatenate(score)
                top = vectors.best(who, score, d_ids[row], k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who[top]]), pa.array(d_ids[row[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    pairs = blocks.join(queries, (F.col("block") == F.col("q_block")) & (F.col("deal") == F.col("q_deal"))).select("d_ids", "d_cell", "d_error", "codes", "d", "q_ids", "q", "bar", "seen")
    return vectors.top(pairs.mapInArrow(solve, "query_id long, vec_id long, score double"), k)
