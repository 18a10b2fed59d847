"""Single edits of words, as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<string>"


def _over(low: Column | int, high: Column, make) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    return F.when(high >= low, F.transform(F.sequence(low, high), make)).otherwise(F.array().cast(_NONE))


def _cut(w: Column, i: Column, gone: int, put: Column | None = None) -> Column:
    """w with ``gone`` characters from place i replaced by ``put``."""
    parts = [F.left(w, i - 1), *([put] if put is not None else []), F.substring(w, i + gone, F.length(w))]
    return F.concat(*parts)


def deletes(w: Column) -> Column:
    """All results of deleting one character; none is empty."""
    return F.filter(_over(1, F.length(w), lambda i: _cut(w, i, 1)), lambda x: x != "")


def extra_char(w: Column) -> Column:
    """All results of deleting one character."""
    return _over(1, F.length(w), lambda i: _cut(w, i, 1))


def transpositions(w: Column) -> Column:
    """All swaps of neighbours."""
    return _over(1, F.length(w) - 1, lambda i: _cut(w, i, 2, F.concat(F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1)))))


def double_swaps(w: Column) -> Column:
    """Both swaps of words of four letters, and the two pairs of outer swaps of words of five."""
    at = lambda k: F.substring(w, F.lit(k), F.lit(1))
    four = F.array(F.concat(at(2), at(1), at(4), at(3)))
    five = F.array(F.concat(at(2), at(1), at(3), at(5), at(4)), F.concat(at(1), at(3), at(2), at(5), at(4)))
    return F.when(F.length(w) == 4, four).when(F.length(w) == 5, five).otherwise(F.array().cast(_NONE))


def swap_char(w: Column) -> Column:
    """All swaps of neighbours, and the double swaps."""
    return F.concat(transpositions(w), double_swaps(w))


def bad_char(w: Column, alphabet: str) -> Column:
    """One character replaced by each other letter of the alphabet, places from the end."""
    letters = F.array(*[F.lit(c) for c in alphabet]) if alphabet else F.array().cast(_NONE)
    n = F.length(w)
    each = lambda c: F.filter(_over(1, n, lambda k: F.when(F.substring(w, n - k + 1, F.lit(1)) != c, _cut(w, n - k + 1, 1, c))), lambda x: x.isNotNull())
    return F.flatten(F.transform(letters, each))


def forgotten_char(w: Column, alphabet: str) -> Column:
    """Each letter of the alphabet put at each place."""
    letters = F.array(*[F.lit(c) for c in alphabet]) if alphabet else F.array().cast(_NONE)
    return F.flatten(F.transform(letters, lambda c: _over(1, F.length(w) + 1, lambda i: _cut(w, i, 0, c))))


def sweep(w: Column, alphabet: str) -> Column:
    """All single edits in order of generation, repeats and the word itself left out."""
    everything = F.concat(swap_char(w), bad_char(w, alphabet), forgotten_char(w, alphabet), extra_char(w))
    return F.filter(F.array_distinct(everything), lambda x: x != w)
