"""Pairs of words within one or two edits, by hashed deletions.

Two words within k edits share a string that each reaches by at most k deletions. Blocks of words
deal the 64-bit hashes of these strings, packed, into buckets of about BUCKET_KEYS; a bucket matches
equal hashes in arrays and keeps the pairs whose exact distance is small enough, so neither keys
nor untested pairs are ever rows of a table. Equal hashes of different strings only cost a test.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

BLOCK_ROWS, BUCKET_KEYS = 8192, 1 << 19
#: Pairs tested at a time.
PAIRS_AT_ONCE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words after each other, where each word begins, and the words' lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size


def keys(words: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of all strings that at most ``most`` (one or two) deletions leave of each word."""
    codes, start, size = flat(words)
    longest = int(size.max(initial=0))
    power = np.append(np.uint64(1), np.cumprod(np.full(longest, _BASE, np.uint64)))
    at = np.arange(len(codes)) - np.repeat(start, size)
    total = np.append(np.uint64(0), np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * power[at]))
    base = total[start]
    whole = total[start + size] - base
    back, twice = np.uint64(_BACK), np.uint64(_BACK * _BACK % (1 << 64))
    one = np.repeat(np.arange(len(words)), size)
    i = np.arange(len(codes))
    owners, found = [np.arange(len(words)), one], [whole, total[i] - base[one] + (total[(start + size)[one]] - total[i + 1]) * back]
    if most > 1:
        later = (start + size)[one] - i - 1  # places after each letter
        first = np.repeat(i, later)
        second = np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later) + first + 1
        two = one[first]
        owners.append(two)
        found.append(total[first] - base[two] + (total[second] - total[first + 1]) * back + (total[(start + size)[two]] - total[second + 1]) * twice)
    return np.concatenate(owners), _mixed(np.concatenate(found))


def _run(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many letters agree from a[at] and b[to] on, at most ``most`` each."""
    out, live, k = np.zeros(len(at), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        live = live[a[at[live] + step * k] == b[to[live] + step * k]]
        out[live] += 1
        k += 1
        live = live[most[live] > k]
    return out


#: An edit at a core's front or back: letters it takes from either side, and whether it is a swap.
_EDITS = ((1, 1, False), (1, 0, False), (0, 1, False), (2, 2, True))


def distances(left: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, right: tuple[np.ndarray, np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """``distance.osa`` of the words i of one side and j of the other (both ``flat``), 3 for more than 2.

    Words less their common ends are two edits apart if one edit at the front and one at the end leave the same."""
    (a, x, n), (b, y, m) = left, right
    x, n, y, m = x[i], n[i], y[j], m[j]
    front = _run(a, b, x, y, np.minimum(n, m), 1)
    back = _run(a, b, x + n - 1, y + m - 1, np.minimum(n, m) - front, -1)
    x, y, n, m = x + front, y + front, n - front - back, m - front - back
    longest = np.maximum(n, m)
    out = np.where(longest == 0, 0, np.where(longest == 1, 1, np.where(longest == 2, 2, 3)))

    def swapped(at: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return at[(a[s[at]] == b[t[at] + 1]) & (a[s[at] + 1] == b[t[at]])]

    out[swapped(np.flatnonzero((n == 2) & (m == 2)), x, y)] = 1
    for p, q, swap in _EDITS:
        for r, s, also in _EDITS:
            at = np.flatnonzero((out == 3) & (n - p - r == m - q - s) & (n >= p + r) & (m >= q + s))
            at = swapped(at, x, y) if swap else at
            at = swapped(at, x + n - 2, y + m - 2) if also else at
            if len(at):
                between = (n - p - r)[at]
                out[at[_run(a, b, x[at] + p, y[at] + q, between, 1) == between]] = 2
    return out


def pairs(queries: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """query, word, distance: all pairs of different words within ``most`` (one or two) edits."""
    sides = [t.select("word").where("word is not null").distinct() for t in (queries, words)]
    n = F.length("word").cast("double")
    size = [t.agg(F.count("*").alias("n"), F.sum(n * (n + 1) / 2 + 1 if most > 1 else n + 1).alias("keys")).first() for t in sides]
    cores = queries.sparkSession.sparkContext.defaultParallelism
    buckets = max(2 * cores, int(sum(s.keys or 0 for s in size)) // BUCKET_KEYS + 1)

    def deal(side: int):
        def dealt(key: tuple, table: pa.Table) -> pa.Table:
            names = table.column("word").combine_chunks()
            owner, hashed = keys(names.to_pylist(), most)
            to = (hashed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            owner, hashed, to = owner[order], hashed[order], to[order]
            edges, rows = np.flatnonzero(np.append(True, to[1:] != to[:-1])), []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(to)]):
                some, mine = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(to[a]), side, hashed[a:b].tobytes(), mine.astype("<i4").tobytes(), names.take(pa.array(some)).to_pylist()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()))
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "side", "hashes", "owners", "names"])

        t, number = blocks.numbered(sides[side], "word", "block", max(256, min(BLOCK_ROWS, size[side].n // cores + 1)), size[side].n)
        return t.repartition(min(number, 1 << 14), "block").groupBy("block").applyInArrow(dealt, "bucket int, side int, hashes binary, owners binary, names array<string>")

    def match(key: tuple, table: pa.Table) -> pa.Table:
        both = []
        for side in (0, 1):
            hashed, owner, names = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
            for row in table.filter(pa.compute.equal(table.column("side"), side)).select(["hashes", "owners", "names"]).to_batches():
                for h, o, w in zip(*row.columns):
                    hashed.append(np.frombuffer(h.as_buffer(), np.uint64))
                    owner.append(np.frombuffer(o.as_buffer(), "<i4").astype(np.int64) + len(names))
                    names += w.as_py()
            both.append((np.concatenate(hashed), np.concatenate(owner), names))
        (h, who, asked), (g, whom, known) = both
        order = np.argsort(g, kind="stable")
        g, whom = g[order], whom[order]
        low = np.searchsorted(g, h)
        size = np.searchsorted(g, h, side="right") - low
        some = np.flatnonzero(size)
        low, size, who = low[some], size[some], who[some]
        piece = np.cumsum(size) // PAIRS_AT_ONCE
        left, right, found = flat(asked), flat(known), []
        edges = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.empty(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(piece)]):
            at = np.arange(size[a:b].sum()) + np.repeat(low[a:b] - np.cumsum(size[a:b]) + size[a:b], size[a:b])
            pair = np.unique(np.repeat(who[a:b], size[a:b]) * len(known) + whom[at])
            i, j = pair // len(known), pair % len(known)
            d = distances(left, i, right, j)
            ok = (d > 0) & (d <= most)
            found.append(pair[ok] * 4 + d[ok])
        pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        d, pair = pair % 4, pair // 4
        i, j = (pair // len(known), pair % len(known)) if known else (pair, pair)
        return pa.Table.from_arrays([pa.array(asked, pa.string()).take(pa.array(i)), pa.array(known, pa.string()).take(pa.array(j)), pa.array(d.astype(np.int32))], ["query", "word", "distance"])

    met = deal(0).unionByName(deal(1)).repartition(min(buckets, 1 << 14), "bucket").groupBy("bucket").applyInArrow(match, "query string, word string, distance int")
    return met.distinct()
