"""Tokenising, casing and keys of words, as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and marks with inner apostrophes.
WORD = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*"
#: Words of the reranker, joined by apostrophes and hyphens.
CONTEXT_WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
#: Combining vowel marks of Hebrew and Arabic.
VOWEL_MARKS = "[֑-ֽֿׁ-ׂׄ-ׇًׅ-ٰٟ]"
#: White space of the language-identification tokenizer.
LID_SPACE = "[ \\t\\n\\r\\f\\x0B\\x00]+"


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a text, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def chars(word: Column) -> Column:
    """Code points as an array; empty for an empty word."""
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def grams(word: Column, n: int) -> Column:
    """All substrings of n code points, repeats kept."""
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def substring_grams(word: Column, low: int = 3, high: int = 6) -> Column:
    """Distinct lower-case substrings of low to high code points."""
    w = F.lower(word)
    return F.array_distinct(F.flatten(F.array(*[grams(w, n) for n in range(low, high + 1)])))


def is_number(word: Column) -> Column:
    """Digits with at most one decimal part, ASCII."""
    return word.rlike(r"^[0-9]+(\.[0-9]+)?$")


def strip_vowel_marks(word: Column) -> Column:
    return F.regexp_replace(word, VOWEL_MARKS, "")


def captype(word: Column, german: bool = False) -> Column:
    """no, all, init, huhinit or huh. ``german``: a sharp s does not stand against ``all``."""
    low, up = F.lower(word), F.upper(word)
    head, tail = F.substring(word, 1, 1), F.substring(word, F.lit(2), F.length(word))
    full = F.regexp_replace(word, "ß", "") if german else word
    all_up = (F.upper(full) == full) if german else (up == word)
    first_up = (F.upper(head) == head) & (F.lower(head) != head)
    return F.when(low == word, "no").when(all_up, "all").when(first_up & (F.lower(tail) == tail), "init").when(first_up, "huhinit").otherwise("huh")


def case_variants(word: Column) -> Column:
    """The word, then what its casing may stand for: lower case, capitalised, or a lower first letter."""
    low = F.lower(word)
    capital = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)))
    first = F.concat(F.lower(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    kind = captype(word)
    return F.array_distinct(F.when(kind == "init", F.array(word, low)).when(kind == "huhinit", F.array(word, first)).when(kind == "all", F.array(word, low, capital)).otherwise(F.array(word)))


def soundex(word: Column) -> Column:
    """Four-character code; letters without a digit never part equal digits; null without A-Z.

    (In Spark's own ``soundex`` vowels part them.)
    """
    letters = F.regexp_replace(F.upper(word), "[^A-Z]", "")
    code = lambda c: F.translate(c, "AEIOUYHWBFPVCGJKQSXZDTLMNR", "00000000111122222222334556")
    runs = F.regexp_replace(F.translate(code(letters), "0", ""), r"([0-9])\1+", "$1")
    rest = F.when(F.left(runs, F.lit(1)) == code(F.left(letters, F.lit(1))), F.substring(runs, F.lit(2), F.length(runs))).otherwise(runs)
    return F.when(letters == "", F.lit(None).cast("string")).otherwise(F.rpad(F.concat(F.left(letters, F.lit(1)), rest), 4, "0"))


def _folds() -> tuple[str, str]:
    """Lower-case letters that decompose to a base letter, from the Unicode data of Python."""
    pairs = {}
    for i in range(0xC0, 0x250):
        c = chr(i)
        base = unicodedata.normalize("NFD", c)[0]
        if c.islower() and base != c and base.isascii():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


def fold_units(word: Column) -> Column:
    """Folded units of a word: lower case without accents or vowel marks; a sharp s is one unit ``ss``."""
    source, target = _folds()
    plain = strip_vowel_marks(F.translate(F.lower(word), source, target))
    return F.transform(chars(plain), lambda c: F.when(c == "ß", "ss").otherwise(c))


def fold(word: Column) -> Column:
    return F.array_join(fold_units(word), "")


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a over UTF-8 with sign-extended bytes, as a long."""
    text = F.hex(F.encode(word, "UTF-8"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(F.when(b > 127, b + 4294967040).otherwise(b)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(text) == 0, F.lit(2166136261)).otherwise(F.aggregate(at, F.lit(2166136261).cast("long"), step))


def sentences(text: Column) -> Column:
    """Pieces up to and with each full stop, exclamation or question mark, and the rest."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0)), F.array().cast("array<string>"))
