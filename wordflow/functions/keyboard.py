"""Keyboard geometry: a grid of keys and a table of neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rows of a QWERTY keyboard from the left.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

#: Neighbours of each key, keys with longer names spelled out.
NEIGHBOURS = {
    "`": ("1", "tab"),
    "1": ("`", "2", "q"),
    "2": ("1", "3", "w", "q"),
    "3": ("2", "4", "e", "w"),
    "4": ("3", "5", "r", "e"),
    "5": ("4", "6", "t", "r"),
    "6": ("5", "7", "y", "t"),
    "7": ("6", "8", "u", "y"),
    "8": ("7", "9", "i", "u"),
    "9": ("8", "0", "o", "i"),
    "0": ("9", "p", "o"),
    "-": ("0", "="),
    "=": ("-",),
    "q": ("tab", "w", "a", "1"),
    "w": ("q", "e", "a", "s", "2"),
    "e": ("w", "r", "s", "d", "3"),
    "r": ("e", "t", "d", "f", "4"),
    "t": ("r", "y", "f", "g", "5"),
    "y": ("t", "u", "g", "h", "6"),
    "u": ("y", "i", "h", "j", "7"),
    "i": ("u", "o", "j", "k", "8"),
    "o": ("i", "p", "k", "l", "9"),
    "p": ("o", "l", ";", "0"),
    "[": ("p", "'"),
    "]": ("enter", "\\"),
    "\\": ("enter",),
    "a": ("caps", "s", "z", "q"),
    "s": ("a", "d", "z", "x", "w"),
    "d": ("s", "f", "x", "c", "e"),
    "f": ("d", "g", "c", "v", "r"),
    "g": ("f", "h", "v", "b", "t"),
    "h": ("g", "j", "b", "n", "y"),
    "j": ("h", "k", "n", "m", "u"),
    "k": ("j", "l", "m", ",", "i"),
    "l": ("k", ";", ",", ".", "o"),
    ";": ("l", "'", ".", "p"),
    "'": (";",),
    "z": ("shift", "s", "x", "a"),
    "x": ("z", "c", "s", "d"),
    "c": ("x", "v", "d", "f"),
    "v": ("c", "b", "f", "g"),
    "b": ("v", "n", "g", "h"),
    "n": ("b", "m", "h", "j"),
    "m": ("n", ",", "j", "k"),
    ",": ("m", ".", "k", "l"),
    ".": (",", "/", "l", ";"),
    "/": (".", "shift"),
}


def position(key: Column) -> Column:
    """100 * row + column of a key, null if it is not on the grid."""
    k = F.lower(key)
    out = F.lit(None).cast("int")
    for r, keys in reversed(list(enumerate(ROWS))):
        at = F.position(k, F.lit(keys))
        out = F.when((F.length(k) == 1) & (at > 0), F.lit(100 * r) + at - 1).otherwise(out)
    return out.cast("int")


def distance(a: Column, b: Column) -> Column:
    """Manhattan distance on the grid; null if a key is unknown."""
    p, q = position(a), position(b)
    return F.abs(F.floor(p / 100) - F.floor(q / 100)) + F.abs(p % 100 - q % 100)


def neighbours(key: Column) -> Column:
    """Neighbours of a key; null if it has none."""
    table = F.create_map(*[x for k, v in NEIGHBOURS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return F.try_element_at(table, F.lower(key))


def penalty(a: Column, b: Column) -> Column:
    """Penalty of the substitutions between words of equal length; 0 for others.

    Each place that differs: 50 for an unknown key, 10 and 30 for keys one and two apart, else 100.
    """
    from .text import chars

    def one(x: Column, y: Column) -> Column:
        d = distance(x, y)
        return F.when(x == y, 0).when(d.isNull(), 50).when(d == 1, 10).when(d == 2, 30).otherwise(100)

    return F.when(F.length(a) == F.length(b), F.aggregate(F.zip_with(chars(a), chars(b), one), F.lit(0), lambda s, v: s + v)).otherwise(0)
