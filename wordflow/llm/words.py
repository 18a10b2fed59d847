"""Words and their 64-bit hashes, vectorised over a document."""

from __future__ import annotations

import numpy as np
import xxhash

from . import memos

MEMO_ENTRIES = 300_000
MEMO_BYTES = 64

#: ASCII characters other than letters become blanks; all other bytes stay.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def split(data: bytes) -> list[bytes]:
    """Maximal runs without bytes 0x20 and 0x09-0x0D (what bytes.split parts at)."""
    return data.split()


class WordHasher(dict):
    """word -> xxh3 64-bit hash; remembers short words, up to MEMO_ENTRIES."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One a worker process, kept for its later tasks.
HASHER = WordHasher()
memos.register("words", HASHER.clear)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, by doubling: log2(size) passes."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out, have, power, length = None, 0, hashes, 1
    while True:
        if size & length:
            part = power[have : have + n]
            out = part + np.uint64(size) if out is None else mix(out * _BASE + part)
            have += length
        if 2 * length > size:
            return mix(out)
        power = mix(power[: len(power) - length] * _BASE + power[length:])
        length *= 2


_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Words of more bytes are hashed one by one, all others together, AT_ONCE characters of text at a time.
LONG, AT_ONCE = 64, 1 << 19
_BLANKS = bytes(b == 0x20 or 0x09 <= b <= 0x0D for b in range(256))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ONE, _THREE, _MOST = np.uint64(1), np.uint64(3), np.uint64(63)


def _hash_some(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = b" " + b" ".join(texts)
    data += b" " * (16 - len(data) % 8)  # at least one blank and one more word of 64 bits
    blank = np.frombuffer(data.translate(_BLANKS), bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    first, size = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    bits = np.frombuffer(data, "<u8")

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bytes of a word from each place, 8 at most, as a number."""
        word, shift = at >> 3, (at & 7).astype(np.uint64) << _THREE
        return (bits[word] >> shift | bits[word + 1] << _ONE << (_MOST - shift)) & _LOW[np.minimum(left, 8)]

    out = mix(eight(first, size) + size.astype(np.uint64) * _BASE)
    some = np.flatnonzero((size > 8) & (size <= LONG))
    at, left = first[some] + 8, size[some] - 8
    while len(some):
        out[some] = mix(out[some] * _BASE + eight(at, left))
        on = np.flatnonzero(left > 8)
        some, at, left = some[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + size[i]])
    return out, np.diff(np.searchsorted(first, begins))


def text_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, end to end, and how many each text has.

    No step is taken for each word. The hashes are not those of ``WordHasher``."""
    found, some, held = [], [], 0
    for t in texts:
        some.append(t.encode("utf-8").lower())
        held += len(t)
        if held >= AT_ONCE:
            found.append(_hash_some(some))
            some, held = [], 0
    if some or not found:
        found.append(_hash_some(some))
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, of all words as one if there are fewer."""
    if not len(hashes):
        return hashes
    return np.unique(run_hashes(hashes, min(size, len(hashes))))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` consecutive values."""
    length = 1
    while 2 * length <= width:
        values = pick(values[: len(values) - length], values[length:])
        length *= 2
    rest = width - length
    return pick(values[: len(values) - rest], values[rest:]) if rest else values
