"""A compact n-gram trie: Elias-Fano levels with quantised weights in one memory map.

The trie is kept in prediction order: level 1 holds predicted words, level 2
the words seen before them, level 3 the words before those. A level stores a
monotone sequence of pointers to its children's ranges, and the children's ids
as offsets by parent, which makes the whole level monotone too. Queries walk
down by a successor search inside the parent's range, on the packed bits: no
level is ever unpacked.
"""

from __future__ import annotations

import json
import mmap
import struct

import numpy as np


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, one after the other."""
    if not bits or not len(values):
        return np.empty(0, np.uint8)
    as_bytes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8]
    return np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little")


def _words64(data: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words, with one more at the end."""
    padded = np.zeros(len(data) + 8 + (-len(data)) % 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


#: The place of each byte's n-th one.
_PLACE = np.zeros((256, 8), np.int64)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _PLACE[_b, : len(_set)] = _set
del _b, _set
_U1, _U6, _U63, _U64 = np.uint64(1), np.uint64(6), np.uint64(63), np.uint64(64)


class Select:
    """Places of the n-th one (or zero) of a bit vector, without unpacking it.

    The directory holds the number of ones before every 8 bytes."""

    def __init__(self, data: np.ndarray):
        self.words = _words64(data)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def nth(self, n: np.ndarray, one: bool = True) -> np.ndarray:
        """Bit index of each ``n``-th (from 0) one or zero; a place past the end if there are fewer zeros."""
        before = self.before if one else np.arange(len(self.before)) * 64 - self.before
        at = np.minimum(np.searchsorted(before, n, side="right") - 1, len(before) - 2)
        left, word = n - before[at], self.words[at] if one else ~self.words[at]
        at = at * 64
        for half in (32, 16, 8):  # halve the word until a byte holds it
            ones = np.bitwise_count(word & np.uint64((1 << half) - 1))
            on = left >= ones
            left = left - ones * on
            step = on * half
            word >>= step.astype(np.uint64)
            at += step
        return at + _PLACE[(word & np.uint64(255)).astype(np.int64), np.minimum(left, 7)]


class EliasFano:
    """A monotone sequence in about 2 + log2(universe / n) bits a value.

    Each value's low bits are packed, its high part is a one in a bit vector, after as many
    zeros as the high part says. Reading a value is a select of its one; a successor search
    selects the zeros around a high part and compares low bits between them."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._select: Select | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        marks[places] = 1
        return cls(n, bits, _pack(values, bits), np.packbits(marks, bitorder="little"))

    @property
    def select(self) -> Select:
        if self._select is None:
            self._select, self._low = Select(self.high), _words64(self.low)
            self._top = int(self._select.nth(np.array([self.n - 1]))[0]) - self.n + 1 if self.n else 0  # the last value's high part
        return self._select

    def low_bits(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the values at these places."""
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        self.select  # opens the words
        bit = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (bit >> _U6).astype(np.int64), bit & _U63
        value = self._low[word] >> shift
        over = shift + np.uint64(self.bits) > _U64
        value[over] |= self._low[word[over] + 1] << (_U64 - shift[over])
        return value & np.uint64((1 << self.bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        high = (self.select.nth(at) - at).astype(np.uint64)
        return high << np.uint64(self.bits) | self.low_bits(at)

    def successor(self, keys: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value >= each key among those from ``first`` to below ``last``; ``last`` if there is none."""
        keys = keys.astype(np.uint64)
        low = np.zeros(len(keys), np.int64) if first is None else first.astype(np.int64)
        high = np.full(len(keys), self.n, np.int64) if last is None else last.astype(np.int64)
        if not self.n:
            return low
        select = self.select
        part = np.minimum(keys >> np.uint64(self.bits), np.uint64(self._top + 1)).astype(np.int64)
        begin = np.where(part > 0, select.nth(np.maximum(part - 1, 0), one=False) - part + 1, 0)
        end = select.nth(part, one=False) - part
        low, high = np.minimum(np.maximum(low, begin), high), np.maximum(np.minimum(high, end), np.minimum(np.maximum(low, begin), high))
        wanted = keys & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.low_bits(middle) < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


class Codebook:
    """Up to 256 levels of a weight: the values themselves if they are few, else the means of bins.

    Half the bins' edges are quantiles, half are spaced evenly, so that no weight is off by more
    than a 128th of the range."""

    @staticmethod
    def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, levels)."""
        some, codes = np.unique(values, return_inverse=True)
        if len(some) > 256:
            edges = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, 129)[1:-1]), np.linspace(some[0], some[-1], 130)[1:-1]]))
            codes = np.searchsorted(edges, values, side="right")
            count = np.bincount(codes, minlength=len(edges) + 1)
            some = np.bincount(codes, values, len(edges) + 1) / np.maximum(count, 1)
        return codes.astype(np.uint8), some.astype(np.float32)


class Trie:
    """Levels over one buffer; build with ``build``, reopen with ``Trie(buffer)``."""

    def __init__(self, buffer):
        self.buffer = buffer
        (size,) = struct.unpack_from("<I", buffer)
        self.meta = json.loads(bytes(buffer[4 : 4 + size]))
        base = 4 + size + (-(4 + size)) % 8

        def view(name: str) -> np.ndarray:
            kind, at, n = self.meta["arrays"][name]
            return np.frombuffer(buffer, kind, n, base + at)

        self.words = view("words")
        self.universe = self.meta["universe"]
        self.contexts = EliasFano(*self.meta["contexts"], view("contexts_low"), view("contexts_high"))
        self.levels = []
        for k in range(3):
            level = {"weight": view(f"weight{k}"), "weight_at": view(f"weight_at{k}")}
            if k < 2:
                level |= {"next": view(f"next{k}"), "next_at": view(f"next_at{k}")}
            if k:
                level["pointers"] = EliasFano(*self.meta[f"pointers{k}"], view(f"pointers{k}_low"), view(f"pointers{k}_high"))
                level["ids"] = EliasFano(*self.meta[f"ids{k}"], view(f"ids{k}_low"), view(f"ids{k}_high"))
            self.levels.append(level)

    @classmethod
    def build(cls, words: np.ndarray, parents: list[np.ndarray], fingerprints: list[np.ndarray], weight: list[np.ndarray], next_: list[np.ndarray]) -> "Trie":
        """``words``: sorted; levels 2 and 3 by their parent's index and the context's fingerprint,
        sorted by both; ``weight``: of each node of the three levels; ``next_``: of the first two."""
        contexts = np.unique(np.concatenate(fingerprints)).astype(np.uint64)
        universe = max(1, len(contexts))
        arrays: dict[str, np.ndarray] = {"words": words.astype("<u8")}
        meta: dict = {"universe": universe}

        def put(name: str, ef: EliasFano) -> None:
            meta[name] = (ef.n, ef.bits)
            arrays[f"{name}_low"], arrays[f"{name}_high"] = ef.low, ef.high

        put("contexts", EliasFano.encode(contexts))
        for k in range(3):
            arrays[f"weight{k}"], arrays[f"weight_at{k}"] = Codebook.quantise(weight[k])
            if k < 2:
                arrays[f"next{k}"], arrays[f"next_at{k}"] = Codebook.quantise(next_[k])
            if k:
                ids = np.searchsorted(contexts, fingerprints[k - 1].astype(np.uint64)).astype(np.uint64)
                put(f"ids{k}", EliasFano.encode(parents[k - 1].astype(np.uint64) * np.uint64(universe) + ids))
                above = len(words) if k == 1 else len(parents[0])
                put(f"pointers{k}", EliasFano.encode(np.searchsorted(parents[k - 1], np.arange(above + 1)).astype(np.uint64)))
        meta["arrays"], at = {}, 0
        for name, a in arrays.items():
            meta["arrays"][name] = (a.dtype.str, at, len(a))
            at += a.nbytes + (-a.nbytes) % 8
        head = json.dumps(meta).encode()
        base = 4 + len(head) + (-(4 + len(head))) % 8
        buffer = mmap.mmap(-1, base + at + 1)
        buffer[:4] = struct.pack("<I", len(head))
        buffer[4 : 4 + len(head)] = head
        for name, a in arrays.items():
            offset = base + meta["arrays"][name][1]
            buffer[offset : offset + a.nbytes] = a.tobytes()
        return cls(buffer)

    def child(self, k: int, parent: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """Node of level ``k`` under each parent (-1: none) with the given context, or -1.

        The search stays inside the parent's range, between two of its pointers."""
        out = np.full(len(parent), -1, np.int64)
        if not self.contexts.n:
            return out
        some, back = np.unique(fingerprint, return_inverse=True)
        found = self.contexts.successor(some)
        found[found < self.contexts.n] = np.where(self.contexts.get(found[found < self.contexts.n]) == some[found < self.contexts.n], found[found < self.contexts.n], self.contexts.n)
        rank = found[back]
        rows = np.flatnonzero((parent >= 0) & (rank < self.contexts.n))
        if not len(rows):
            return out
        level, p = self.levels[k], parent[rows]
        new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))  # queries of a parent come together
        first, last = (np.repeat(level["pointers"].get(x).astype(np.int64), np.diff(np.append(new, len(p)))) for x in (p[new], p[new] + 1))
        key = p.astype(np.uint64) * np.uint64(self.universe) + rank[rows].astype(np.uint64)
        at = level["ids"].successor(key, first, last)
        ok = np.flatnonzero(at < last)
        ok = ok[level["ids"].get(at[ok]) == key[ok]]
        out[rows[ok]] = at[ok]
        return out

    def root(self, word: np.ndarray) -> np.ndarray:
        """Level 1 node of each word, or -1."""
        if not len(self.words):
            return np.full(len(word), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)

    def weight(self, k: int, node: np.ndarray) -> np.ndarray:
        level = self.levels[k]
        return level["weight_at"][level["weight"][node]].astype(np.float64)

    def next(self, k: int, node: np.ndarray) -> np.ndarray:
        level = self.levels[k]
        return level["next_at"][level["next"][node]].astype(np.float64)
