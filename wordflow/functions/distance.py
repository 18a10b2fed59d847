"""Distances and similarities of words, as native expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import chars


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment: edits and swaps of neighbours cost one each.

    ``a`` and ``b`` are arrays of units. If one is empty, the other's size. Rows of the
    usual table are folded one after the other, so nothing leaves the JVM.
    """
    n, m = F.size(a), F.size(b)
    first = F.transform(F.sequence(F.lit(0), m), lambda j: j)
    big = F.lit(1 << 20)

    def row(state: Column, i: Column) -> Column:
        p2, p1 = state["p2"], state["p1"]
        x, before = a[i - 1], F.get(a, i - 2)

        def cell(done: Column, j: Column) -> Column:
            y, left = b[j - 1], F.get(b, j - 2)
            swap = F.when((i > 1) & (j > 1) & (x == left) & (before == y), F.get(p2, j - 2) + 1).otherwise(big)
            best = F.least(p1[j] + 1, F.element_at(done, -1) + 1, p1[j - 1] + F.when(x == y, 0).otherwise(1), swap)
            return F.concat(done, F.array(best))

        return F.struct(p1.alias("p2"), F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell).alias("p1"))

    table = F.aggregate(F.sequence(F.lit(1), n), F.struct(first.alias("p2"), first.alias("p1")), row, lambda s: s["p1"][m])
    return F.when(n == 0, m).when(m == 0, n).otherwise(table)


def osa_words(a: Column, b: Column) -> Column:
    return osa(chars(a), chars(b))


def _table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = max(1, int(sizes.max(initial=0)))
    return np.array(words, dtype=f"U{width}").view(np.int32).reshape(len(words), width), sizes


def osa_batch(left: list[str], right: list[str]) -> np.ndarray:
    """``osa`` of many pairs of words at once, a table cell at a time over all pairs."""
    if not left:
        return np.empty(0, np.int64)
    (a, n), (b, m) = _table(left), _table(right)
    rows = [np.broadcast_to(np.arange(b.shape[1] + 1, dtype=np.int16), (len(a), b.shape[1] + 1))]
    out = np.where(n == 0, m, 0)
    for i in range(1, a.shape[1] + 1):
        row = np.empty((len(a), b.shape[1] + 1), np.int16)
        row[:, 0] = i
        same = a[:, i - 1 : i] == b
        best = np.minimum(rows[-1][:, 1:] + 1, rows[-1][:, :-1] + ~same)
        if i > 1:
            swap = (a[:, i - 1 : i] == b[:, :-1]) & (a[:, i - 2 : i - 1] == b[:, 1:])
            best[:, 1:] = np.where(swap, np.minimum(best[:, 1:], rows[-2][:, :-2] + 1), best[:, 1:])
        for j in range(1, b.shape[1] + 1):
            row[:, j] = np.minimum(best[:, j - 1], row[:, j - 1] + 1)
        rows = [rows[-1], row]
        done = n == i
        out[done] = row[done, m[done]]
    return out


@F.pandas_udf(IntegerType())
def osa_fast(a: pd.Series, b: pd.Series) -> pd.Series:
    """``osa`` of two word columns, batch by batch through Arrow."""
    return pd.Series(osa_batch(a.tolist(), b.tolist()), dtype="int32")


def _ends(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of rows of code points, at most ``most``."""
    out, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(min(most, a.shape[1], b.shape[1])):
        same &= (n > k) & (m > k) & (a[:, k] == b[:, k])
        out += same
    return out


def typo_similarity_batch(left: list[str], right: list[str]) -> np.ndarray:
    """``typo_similarity`` of many pairs at once."""
    if not left:
        return np.empty(0)
    x, y = [w.lower() for w in left], [w.lower() for w in right]
    (a, n), (b, m) = _table(x), _table(y)
    shared = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        shared += (n > i) & ((a[:, i : i + 1] == b) & (np.arange(b.shape[1]) < m[:, None])).any(1)
    front = _ends(a, n, b, m, 4)
    (c, _), (d, _) = _table([w[-4:][::-1] for w in x]), _table([w[-4:][::-1] for w in y])
    back = _ends(c, np.minimum(n, 4), d, np.minimum(m, 4), 4)
    score = shared / np.maximum(np.maximum(n, m), 1) + front * 0.15 + back * 0.05 - np.abs(n - m) * 0.1
    equal = np.array([p == q for p, q in zip(x, y)])
    return np.where((n == 0) | (m == 0), 0.0, np.where(equal, 1.0, np.clip(score, 0.0, 1.0)))


def _gram_ids(words: list[str]) -> np.ndarray:
    """Trigrams of each word with the number of equal ones before, as ids; -1 past the end."""
    codes, n = _table(words)
    if codes.shape[1] < 3:
        return np.full((len(words), 1), -1, np.int64)
    c = codes.astype(np.int64)
    g = (c[:, :-2] << 42) | (c[:, 1:-1] << 21) | c[:, 2:]
    copies = np.zeros(g.shape, np.int64)
    for i in range(1, g.shape[1]):
        copies[:, i] = (g[:, :i] == g[:, i : i + 1]).sum(1)
    grams, ids = np.unique(g, return_inverse=True)
    ids = ids.reshape(g.shape) + copies * len(grams)  # a copy is an id of its own
    return np.where(np.arange(g.shape[1]) < n[:, None] - 2, ids, -1)


def trigram_jaccard_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard of the trigram multisets of many pairs; 0 where both are empty."""
    if not left:
        return np.empty(0)
    both = _gram_ids([*left, *right])
    a, b = both[: len(left)], both[len(left) :]
    shared = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        shared += ((a[:, i : i + 1] == b) & (a[:, i : i + 1] >= 0)).any(1)
    union = (a >= 0).sum(1) + (b >= 0).sum(1) - shared
    return shared / np.maximum(union, 1)


def _common(a: Column, b: Column, most: int, end: bool) -> Column:
    """Length of the common prefix (or suffix), at most ``most``."""
    part = (lambda w, k: F.right(w, F.lit(k))) if end else (lambda w, k: F.left(w, F.lit(k)))
    out = F.lit(0)
    for k in range(1, most + 1):
        out = F.when((F.length(a) >= k) & (F.length(b) >= k) & (part(a, k) == part(b, k)), k).otherwise(out)
    return out


def typo_similarity(a: Column, b: Column) -> Column:
    """Share of a's letters that b holds, plus common ends, less the difference in length; 0 to 1."""
    x, y = F.lower(a), F.lower(b)
    shared = F.size(F.filter(chars(x), lambda c: F.contains(y, c)))
    longest = F.greatest(F.length(x), F.length(y))
    score = (
        shared.cast("double") / longest + _common(x, y, 4, False) * F.lit(0.15) + _common(x, y, 4, True) * F.lit(0.05)
        - F.abs(F.length(x) - F.length(y)) * F.lit(0.1)
    )
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def transposition_bonus(a: Column, b: Column) -> Column:
    """100 for each crossing of equal-length words, 200 for exactly one."""
    x, y = chars(F.lower(a)), chars(F.lower(b))

    def crossing(i: Column) -> Column:
        later = F.array_position(F.slice(y, i + 1, F.size(y)), x[i - 1]).cast("int")
        at = i + later
        return F.when((x[i - 1] != F.get(y, i - 1)) & (later > 0) & ((later == 1) | F.coalesce(F.get(x, at - 1) == y[i - 1], F.lit(False))), 1).otherwise(0)

    n = F.aggregate(F.transform(F.sequence(F.lit(1), F.size(x)), crossing), F.lit(0), lambda s, v: s + v)
    return F.when((F.length(a) != F.length(b)) | (F.length(a) == 0), 0).when(n == 1, 200).otherwise(100 * n)


def doubled(short: Column, long: Column) -> Column:
    """Whether ``long`` is ``short`` with one letter doubled."""
    size = F.length(long)
    at = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))
    hit = lambda i: (F.substring(long, i, F.lit(1)) == F.substring(long, i + 1, F.lit(1))) & (F.concat(F.left(long, i), F.substring(long, i + 2, size)) == short)
    return (size == F.length(short) + 1) & F.exists(at, hit)


def typo_pattern_bonus(original: Column, candidate: Column) -> Column:
    """300 for a missing double letter, 30 for a longer word with the same three letters in front."""
    longer = F.length(candidate) > F.length(original)
    return F.when(doubled(original, candidate), 300).otherwise(0) + F.when(longer & F.startswith(original, F.left(candidate, F.lit(3))), 30).otherwise(0)


def double_letter_pattern(original: Column, candidate: Column) -> Column:
    """One letter longer, with a double letter in the original or doubled from it; or doubled the other way."""
    has = original.rlike(r"(.)\1")
    return ((F.length(candidate) == F.length(original) + 1) & (has | doubled(original, candidate))) | doubled(candidate, original)


def enhanced_score(original: Column, candidate: Column, distance: Column, bonus: Column) -> Column:
    """Score of an edit candidate, lower is better."""
    from .keyboard import penalty

    return (
        distance.cast("double") * 1000 - bonus + penalty(original, candidate) - transposition_bonus(original, candidate)
        - typo_pattern_bonus(original, candidate) + F.abs(F.length(original) - F.length(candidate)) * 50
    )


def combined_score(distance: Column, confidence: Column) -> Column:
    """Order of suggestions: three tenths closeness, seven tenths confidence."""
    return (F.lit(1.0) - F.least(distance, F.lit(5)) / F.lit(5.0)) * F.lit(0.3) + confidence * F.lit(0.7)
