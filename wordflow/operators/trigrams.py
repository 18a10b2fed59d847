"""Pairs of words by trigrams, in blocks of bounded size.

Queries go into chunks of QUERY_ROWS, words into blocks of WORD_ROWS; chunks and blocks meet on the
cells of a grid (``blocks.meet``). A chunk counts the trigrams it shares with every word of a block
through the block's lists of words by trigram, so no pair is written out before its score is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .deletions import flat

QUERY_ROWS, WORD_ROWS = 2048, 65536
#: Counts, and entries of the lists, at a time.
CELLS_AT_ONCE = 1 << 20


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, trigram) of all words of three letters or more, by word, and each word's number of them."""
    codes, start, size = flat(words)
    n = np.maximum(size - 2, 0)
    owner = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[owner]
    c = codes.astype(np.int64)
    return owner, (c[at] << 42) | (c[at + 1] << 21) | c[at + 2], n


def _elements(owner: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """An id of each trigram and its number of equal ones before it in the word, so that multisets become sets."""
    grams, ids = np.unique(gram, return_inverse=True)
    key = owner * len(grams) + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
    copies = np.empty(len(key), np.int64)
    copies[order] = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return ids + copies * len(grams)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each of many ranges, after each other."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class Letters:
    """Letters of many lower-case words: their sets as bits, and their ends."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        codes, self.start, self.size = flat(words)
        self.codes = np.searchsorted(alphabet, codes)
        self.bits = np.zeros((len(words), len(alphabet) // 64 + 1), np.uint64)
        np.bitwise_or.at(self.bits, (np.repeat(np.arange(len(words)), self.size), self.codes >> 6), np.uint64(1) << (self.codes & 63).astype(np.uint64))
        self.front, self.back = (np.full((len(words), 4), -1, np.int64) for _ in range(2))
        for k in range(4):
            has = self.size > k
            self.front[has, k] = self.codes[self.start[has] + k]
            self.back[has, k] = self.codes[(self.start + self.size)[has] - 1 - k]


def _similarity(q: Letters, i: np.ndarray, w: Letters, j: np.ndarray) -> np.ndarray:
    """``distance.typo_similarity`` of the words i of one side and j of the other."""
    n, m = q.size[i], w.size[j]
    shared, live = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(int(n.max(initial=0))):
        live = live[n[live] > k]
        code = q.codes[q.start[i[live]] + k]
        shared[live] += ((w.bits[j[live], code >> 6] >> (code & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
    ends = []
    for a, b in ((q.front, w.front), (q.back, w.back)):
        same, out = np.ones(len(i), bool), np.zeros(len(i), np.int64)
        for k in range(4):
            same &= (a[i, k] == b[j, k]) & (a[i, k] >= 0)
            out += same
        ends.append(out)
    score = shared / np.maximum(np.maximum(n, m), 1) + ends[0] * 0.15 + ends[1] * 0.05 - np.abs(n - m) * 0.1
    return np.clip(score, 0.0, 1.0)


def _needs(sizes: np.ndarray, n: int, least: float) -> np.ndarray:
    """How many trigrams a word of n must share with words of these numbers for the overlap ``least``."""
    most = int(sizes.max(initial=0))
    shared = np.arange(min(n, most) + 1)
    ok = shared / np.maximum(n + np.arange(most + 1)[:, None] - shared, 1) >= least
    ok &= shared <= np.minimum(n, np.arange(most + 1))[:, None]
    return np.where(ok.any(1), ok.argmax(1), 1 << 30)[sizes]


def overlaps(left: list[str], right: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, Jaccard) of the words whose trigram multisets overlap by ``least`` (above 0), some queries at a time."""
    (a, g, n), (b, h, m) = _grams(left), _grams(right)
    element = _elements(np.append(a, b + len(left)), np.append(g, h))
    mine, theirs = element[: len(a)], element[len(a) :]
    order = np.argsort(theirs, kind="stable")
    theirs, who = theirs[order], b[order]
    low, high = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, side="right")
    begin = np.append(np.cumsum(n) - n, len(a))
    step = max(1, CELLS_AT_ONCE // max(1, len(right)))
    for size in np.unique(n[n > 0]).tolist():
        need = np.maximum(_needs(m, size, least), 1)
        some = np.flatnonzero(n == size)
        for x in range(0, len(some), step):
            q = some[x : x + step]
            at = (begin[q][:, None] + np.arange(size)).ravel()
            length = high[at] - low[at]
            key = who[_ranges(low[at], length)] + np.repeat(np.repeat(np.arange(len(q)) * len(right), size), length)
            count = np.bincount(key, minlength=len(q) * len(right)).reshape(len(q), -1)
            i, j = np.nonzero(count >= need)
            if len(i):
                shared = count[i, j]
                yield q[i], j, shared / (size + m[j] - shared)


def _first(i: np.ndarray, low: np.ndarray, keys: list[np.ndarray], most: int) -> np.ndarray:
    """Places of the first ``most`` of each i by the keys, of equal ``low`` only the first."""
    order = np.lexsort((*reversed(keys), i))
    pair = i[order].astype(np.int64) * (int(low.max(initial=0)) + 1) + low[order]
    _, once = np.unique(pair, return_index=True)
    order = order[np.sort(once)]
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < most]


def search(queries: DataFrame, words: DataFrame, least: float, least_similarity: float, most: int | None = None) -> DataFrame:
    """query, word, jaccard, similarity of different words above both bounds.

    With ``most`` only those that can be among a query's first ``most`` different lower-case words
    by distance (a tenth of the overlap's lack, not 0), difference in length, similarity, lower-case word, word."""
    side = lambda t: t.select("word", F.lower("word").alias("low")).where(F.length("word") >= 3).distinct()

    def pack(name: str):
        def packed(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by([("low", "ascending"), ("word", "ascending")])
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([table.column(c).to_pylist()], pa.list_(pa.string())) for c in ("word", "low"))], [name, f"{name}_words", f"{name}_low"])

        return packed

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*(batch.column(c) for c in ("chunk_words", "chunk_low", "block_words", "block_low"))):
                left, left_low, right, right_low = (x.as_py() for x in cells)
                alphabet = np.unique(flat([*left_low, *right_low])[0])
                q, w = Letters(left_low, alphabet), Letters(right_low, alphabet)
                names, others, place = pa.array(left, pa.string()), pa.array(right, pa.string()), {x: j for j, x in enumerate(right)}
                own = np.array([place.get(x, -1) for x in left])
                lows = np.unique(right_low, return_inverse=True)[1] if most is not None else None
                long, wide = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
                same = {x: j for j, x in enumerate(dict.fromkeys([*left_low, *right_low]))}
                one, two = (np.array([same[x] for x in t]) for t in (left_low, right_low))
                for i, j, jaccard in overlaps(left, right, least):
                    for a in range(0, len(i), CELLS_AT_ONCE):
                        x = slice(a, a + CELLS_AT_ONCE)
                        p, r, overlap = i[x], j[x], jaccard[x]
                        similarity = np.where(one[p] == two[r], 1.0, _similarity(q, p, w, r))
                        ok = np.flatnonzero((similarity >= least_similarity) & (own[p] != r))
                        if most is not None:
                            distance = np.floor((1.0 - overlap) * 10).astype(np.int64)
                            ok = ok[distance[ok] != 0]
                            ok = ok[_first(p[ok], lows[r[ok]], [distance[ok], np.abs(wide[r[ok]] - long[p[ok]]), -similarity[ok], r[ok]], most)]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(p[ok])), others.take(pa.array(r[ok])), pa.array(overlap[ok]), pa.array(similarity[ok])], ["query", "word", "jaccard", "similarity"])

    chunks, n = blocks.numbered(side(queries), "word", "chunk", QUERY_ROWS)
    parts, m = blocks.numbered(side(words), "word", "block", WORD_ROWS)
    chunks = chunks.groupBy("chunk").applyInArrow(pack("chunk"), "chunk int, chunk_words array<string>, chunk_low array<string>")
    parts = parts.groupBy("block").applyInArrow(pack("block"), "block int, block_words array<string>, block_low array<string>")
    met = blocks.meet(chunks, parts, "chunk", "block", n, m)
    return met.mapInArrow(solve, "query string, word string, jaccard double, similarity double")
