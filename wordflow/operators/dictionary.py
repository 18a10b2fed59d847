"""Dictionary correctness: affix analysis as joins, the full check in an Arrow UDF.

``analyses`` is the native form for dictionaries without compounding: all cuts of a
word meet the affix table and the entries in equi-joins. ``correct`` runs every rule
(breaks, conversions, casing, compounds) on distinct words; a compiled dictionary is
a fixed-size input that travels with the function.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..sources.hunspell import Affix, Affixes, Entry, encoding_of, parse_aff, parse_dic

#: Languages with dotless i.
TURKIC = ("tr", "az", "crh", "tt", "krc", "kaa")


class Casing:
    def __init__(self, lang: str, sharps: bool):
        self.turkic = lang.split("_")[0] in TURKIC
        self.german = sharps or (not self.turkic and lang.startswith("de"))

    def lower(self, w: str) -> list[str]:
        """Lower-case readings of a word."""
        if self.turkic:
            return [w.replace("I", "ı").replace("İ", "i").lower()]
        if w[:1] == "İ":
            return []
        low = w.lower().replace("i̇", "i")
        if not self.german or "SS" not in w:
            return [low]
        parts = low.split("ss")
        readings = [parts[0]]
        for p in parts[1:]:
            readings = [r + s + p for r in readings for s in ("ß", "ss")]
        return readings

    def upper(self, w: str) -> str:
        return (w.replace("i", "İ").replace("ı", "I") if self.turkic else w).upper()

    def guess(self, w: str) -> str:
        if w == w.lower():
            return "no"
        if self.upper(w.replace("ß", "") if self.german else w) == (w.replace("ß", "") if self.german else w):
            return "all"
        if w[:1] == w[:1].upper() and w[:1] != w[:1].lower():
            return "init" if w[1:] == w[1:].lower() else "huhinit"
        return "huh"

    def variants(self, w: str) -> tuple[str, list[str]]:
        kind = self.guess(w)
        more: list[str] = []
        if kind == "init":
            more = self.lower(w)
        elif kind == "huhinit":
            more = [x + w[1:] for x in self.lower(w[0])]
        elif kind == "all":
            low = self.lower(w)
            more = [*low, *(self.upper(x[0]) + x[1:] for x in low)]
        return kind, [w, *more]


class Form:
    """A reading of a word: its stem and the affixes around it."""

    __slots__ = ("prefix", "prefix2", "stem", "suffix", "suffix2")

    def __init__(self, stem, prefix=None, suffix=None, prefix2=None, suffix2=None):
        self.stem, self.prefix, self.suffix, self.prefix2, self.suffix2 = stem, prefix, suffix, prefix2, suffix2

    def affixes(self) -> list[Affix]:
        return [a for a in (self.prefix, self.suffix, self.prefix2, self.suffix2) if a]


class Dictionary:
    """A compiled dictionary: ``correct(word)``, its word list and its TRY letters."""

    def __init__(self, aff: bytes | str, dic: bytes | str):
        raw = aff.encode() if isinstance(aff, str) else aff
        self.aff: Affixes = parse_aff(aff)
        self.entries, reps = parse_dic(dic, self.aff, encoding_of(raw))
        self.aff.rep += reps
        self.casing = Casing(self.aff.lang, "check_sharps" in self.aff.switches)
        self.by_stem: dict[str, list[Entry]] = defaultdict(list)
        self.by_lower: dict[str, list[Entry]] = defaultdict(list)
        for e in self.entries:
            self.by_stem[e.stem].append(e)
            if self.casing.guess(e.stem) != "no":
                for low in self.casing.lower(e.stem):
                    self.by_lower[low].append(e)
        self.suffixes: dict[str, list[Affix]] = defaultdict(list)
        self.prefixes: dict[str, list[Affix]] = defaultdict(list)
        for a in self.aff.affixes:
            (self.suffixes if a.kind == "SFX" else self.prefixes)[a.add].append(a)
        self.longest = {k: max(map(len, t), default=0) for k, t in (("SFX", self.suffixes), ("PFX", self.prefixes))}
        self.spaced = any(" " in e.stem for e in self.entries)
        self._links = self._seams()

    def _seams(self) -> set[str] | None:
        """Pairs of neighbouring letters, lower case, that a right word of ASCII letters may hold: those
        inside stems and affixes, and an end by a front. None where other rules rewrite words."""
        aff = self.aff
        rebuilt = "simplified_triple" in aff.switches or any(put for _, _, put in aff.compound_patterns)
        if aff.iconv or aff.ignore or rebuilt or self.casing.turkic or self.casing.german:
            return None
        low = lambda x: {x.lower(), *self.casing.lower(x)}
        pieces = {p for x in [*self.by_stem, *self.by_lower, *self.suffixes, *self.prefixes] for p in low(x) if p}
        inside, fronts, ends = set(), {p[0] for p in pieces}, {p[-1] for p in pieces}
        cut = {(a.kind, p) for a in aff.affixes for p in low(a.strip) if p}
        for p in pieces:
            inside.update(p[i : i + 2] for i in range(len(p) - 1))
            for kind, strip in cut:
                for i in range(len(p) - len(strip)):  # an affix may be taken off after another
                    if kind == "SFX" and p.startswith(strip, i + 1):
                        ends.add(p[i])
                    elif kind == "PFX" and p.startswith(strip, i):
                        fronts.add(p[i + len(strip)])
        return inside | {a + b for a in ends for b in fronts}

    def _wrong_at(self, word: str) -> list[int]:
        """Places of two neighbouring letters that no right word holds; none where that can't be told."""
        if self._links is None or not (word.isascii() and word.isalpha()) or any(c in b for b in self.aff.breaks for c in word):
            return []
        low = word.lower()
        return [i for i in range(len(low) - 1) if low[i : i + 2] not in self._links]

    def edits(self, word: str) -> set[str]:
        """The right words that a single edit with the letters of TRY makes (``edits.sweep``).

        An edit changes few neighbouring pairs of letters: places where others would stay wrong are left out."""
        letters, n = self.aff.try_, len(word)
        plain = letters.isascii() and letters.isalpha() and not any(c in b for b in self.aff.breaks for c in letters)
        wrong = self._wrong_at(word) if plain else []
        low, high = (wrong[0], wrong[-1]) if wrong else (n, -1)
        may = lambda i, first, last: low >= i + first and high <= i + last  # noqa: E731  all wrong pairs are among those from i + first to i + last
        swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        out = {swap(word, i) for i in range(n - 1) if may(i, -1, 1)}
        for i in range(n):
            if may(i, -1, 0):
                out.add(word[:i] + word[i + 1 :])
                out.update(word[:i] + c + word[i + 1 :] for c in letters)
        for i in range(n + 1):
            if may(i, -1, -1):
                out.update(word[:i] + c + word[i:] for c in letters)
        out |= {swap(swap(word, a), b) for a, b in {4: ((0, 2),), 5: ((0, 3), (1, 3))}.get(n, ())}
        return {w for w in out - {word} if self.correct(w)}

    @property
    def words(self) -> list[str]:
        """Distinct lower-case stems in file order."""
        return list(dict.fromkeys(e.stem.lower() for e in self.entries))

    def has_flag(self, word: str, flag: str | None) -> bool:
        found = self.by_stem.get(word, ())
        return bool(flag and found) and all(flag in e.flags for e in found)

    def correct(self, word: str | None) -> bool:
        """Whether the dictionary takes the word; empty and null words are never right."""
        if not word or self.has_flag(word, self.aff.flag("forbidden")) or self._wrong_at(word):
            return False
        if self.aff.iconv:
            word = self._convert(word)
        word = word.translate({ord(c): None for c in self.aff.ignore})
        if re.fullmatch(r"[0-9]+(\.[0-9]+)?", word):
            return True
        return any(all(not p or self._good(p) for p in parts) for parts in self._breaks(word, 0))

    def _convert(self, word: str) -> str:
        """Longest row at each place; ``_`` anchors a row to the word's ends."""
        out, at = [], 0
        rows = sorted(self.aff.iconv, key=lambda r: -len(r[0].strip("_")))
        while at < len(word):
            for pattern, put in rows:
                bare = pattern.strip("_")
                if bare and word.startswith(bare, at) and (pattern[0] != "_" or at == 0) and (pattern[-1] != "_" or at + len(bare) == len(word)):
                    out.append(put.replace("_", " "))
                    at += len(bare)
                    break
            else:
                out.append(word[at])
                at += 1
        return "".join(out)

    def _breaks(self, word: str, depth: int) -> Iterator[list[str]]:
        yield [word]
        if depth > 10:
            return
        for b in self.aff.breaks:
            bare = re.escape(b.removeprefix("^").removesuffix("$"))
            pattern = f"^{bare}" if b[0] == "^" else f"{bare}$" if b[-1] == "$" else f"(?<=.){bare}(?=.)"
            for m in re.finditer(pattern, word):
                for rest in self._breaks(word[m.end() :], depth + 1):
                    yield [word[: m.start()], *rest]

    def _good(self, word: str) -> bool:
        kind, variants = self.casing.variants(word)
        keep = self.aff.flag("keep_case")
        for v in variants:
            for form, entry in self._forms(v, kind):
                sharp = "check_sharps" in self.aff.switches and keep and "ß" in entry.stem and kind == "all" and "ß" in word
                if not (sharp and keep in self._flags(form, entry)):
                    return True
            if self._compound(v, kind):
                return True
        return False

    def _flags(self, form: Form, entry: Entry) -> set[str]:
        out = set(entry.flags)
        for a in (form.prefix, form.suffix):
            if a:
                out |= a.flags
        return out

    def _forms(self, word: str, kind: str, place: str | None = None, forbidden_too: bool = False) -> Iterator[tuple[Form, Entry]]:
        """Good readings of a word, outside or at a place of a compound."""
        bad = self.aff.flag("forbidden")
        for form in self._analyses(word, place):
            found = False
            entries = self.by_stem.get(form.stem, [])
            if bad and not forbidden_too and (place or form.affixes()) and any(bad in e.flags for e in entries):
                continue
            if place == "begin" and self.aff.flag("force_ucase") and kind == "init":
                entries = [*entries, *self.by_stem.get(form.stem.lower(), [])]
            for e in entries:
                if self._is_good(form, e, kind, place):
                    found = True
                    yield form, e
            if found or place or kind != "all" or self.casing.guess(word) != "no":
                continue
            for e in self.by_lower.get(form.stem, ()):
                if not (bad and not forbidden_too and form.affixes() and bad in e.flags) and self._is_good(form, e, kind, place):
                    yield form, e

    def _analyses(self, word: str, place: str | None) -> Iterator[Form]:
        yield Form(word)
        permit, forbid = self.aff.flag("compound_permit"), self.aff.flag("compound_forbid")
        need = {permit} if place and permit else set()
        bar = {forbid} if place and forbid else set()
        end = place in (None, "end") or bool(need)
        begin = place in (None, "begin") or bool(need)
        s_need = set() if place in (None,) else (need if place != "end" or need else set())
        if end:
            yield from self._suffixed(word, s_need, bar, False, False)
        if begin:
            for form in self._prefixed(word, s_need, bar, False):
                yield form
                if end and form.prefix.cross:
                    for f in self._suffixed(form.stem, s_need, bar, False, True):
                        yield Form(f.stem, form.prefix, f.suffix, form.prefix2, f.suffix2)

    def _suffixed(self, word: str, need: set, bar: set, inner: bool, cross: bool) -> Iterator[Form]:
        for k in range(min(len(word), self.longest["SFX"]) + 1):
            for a in self.suffixes.get(word[len(word) - k :], ()):
                if (cross and not a.cross) or not need <= a.flags or bar & a.flags:
                    continue
                stem = word[: len(word) - k] + a.strip
                if a.condition and not re.search(a.condition, stem):
                    continue
                yield Form(stem, suffix=a)
                if not inner:
                    for f in self._suffixed(stem, need | {a.flag}, bar, True, cross):
                        yield Form(f.stem, suffix=f.suffix, suffix2=a)

    def _prefixed(self, word: str, need: set, bar: set, inner: bool) -> Iterator[Form]:
        for k in range(min(len(word), self.longest["PFX"]) + 1):
            for a in self.prefixes.get(word[:k], ()):
                if not need <= a.flags or bar & a.flags:
                    continue
                stem = a.strip + word[k:]
                if a.condition and not re.search(a.condition, stem):
                    continue
                yield Form(stem, prefix=a)
                if not inner and "complex_prefixes" in self.aff.switches:
                    for f in self._prefixed(stem, need | {a.flag}, bar, True):
                        yield Form(f.stem, prefix=f.prefix, prefix2=a)

    def _is_good(self, form: Form, entry: Entry, kind: str, place: str | None) -> bool:
        flag, every = self.aff.flag, self._flags(form, entry)
        keep, need, circumfix, only = flag("keep_case"), flag("need_affix"), flag("circumfix"), flag("only_in_compound")
        if keep and keep in entry.flags and kind != self.casing.guess(entry.stem) and not ("check_sharps" in self.aff.switches and "ß" in entry.stem):
            return False
        if need and ((need in entry.flags and not form.affixes()) or (form.affixes() and all(need in a.flags for a in form.affixes()))):
            return False
        if any(a and a.flag not in every for a in (form.prefix, form.suffix)):
            return False
        if circumfix and (bool(form.suffix) and circumfix in form.suffix.flags) != (bool(form.prefix) and circumfix in form.prefix.flags):
            return False
        if place is None:
            return not (only and only in every)
        if place == "end" and only and not form.prefix and any(a and a.add and only in a.flags for a in (form.suffix, form.suffix2)):
            return False
        return any(f and f in every for f in (flag("compound"), flag(f"compound_{place}")))

    def _compound(self, word: str, kind: str) -> bool:
        bad = self.aff.flag("forbidden")
        if bad and any(bad in self._flags(f, e) for f, e in self._forms(word, kind, None, True)):
            return False
        if (self.aff.flag("compound_begin") or self.aff.flag("compound")) and any(not self._bad_compound(p, kind) for p in self._by_flags(word, kind, 0)):
            return True
        return bool(self.aff.compound_rules) and any(not self._bad_compound([(w, None, None, False) for w in p], kind) for p in self._by_rules(word, []))

    def _by_flags(self, rest: str, kind: str, depth: int) -> Iterator[list[tuple]]:
        """Lists of (text, form, entry, whether a replacement rebuilt the seam after it)."""
        if depth:
            for f, e in self._forms(rest, kind, "end"):
                yield [(rest, f, e, False)]
        least = self.aff.compound_min
        if len(rest) < 2 * least or (self.aff.compound_words and depth >= self.aff.compound_words):
            return
        place = "middle" if depth else "begin"
        for cut in range(least, len(rest) - least + 1):
            for left, right, rebuilt in self._junctions(rest, cut):
                readings = list(self._forms(left, kind, place))
                if readings:
                    for tail in self._by_flags(right, kind, depth + 1):
                        for f, e in readings:
                            yield [(left, f, e, rebuilt), *tail]

    def _junctions(self, rest: str, cut: int) -> Iterator[tuple[str, str, bool]]:
        left, right = rest[:cut], rest[cut:]
        yield left, right, False
        if "simplified_triple" in self.aff.switches and left[-1] == left[-2:-1]:
            yield left + left[-1], right, False
        for a, b, put in self.aff.compound_patterns:
            if put and rest.startswith(put, cut):
                yield left + a.split("/")[0], b.split("/")[0] + rest[cut + len(put) :], True

    def _by_rules(self, rest: str, before: list[str]) -> Iterator[list[str]]:
        if before and rest in self.by_stem and self._rules([*before, rest], True):
            yield [rest]
        least = self.aff.compound_min
        if len(rest) < 2 * least or (self.aff.compound_words and len(before) >= self.aff.compound_words):
            return
        for cut in range(least, len(rest) - least + 1):
            left = rest[:cut]
            if left in self.by_stem and self._rules([*before, left], False):
                for tail in self._by_rules(rest[cut:], [*before, left]):
                    yield [left, *tail]

    def _rules(self, parts: list[str], whole: bool) -> bool:
        """Whether the parts' flags can follow a rule (to its end, if whole). ``.`` takes any flag
        that the rule names."""
        flags = [set().union(*(e.flags for e in self.by_stem[p])) for p in parts]

        def run(rule: list[tuple[str, str]], at: int, i: int) -> bool:
            named = {f for f, _ in rule if f != "."}
            if i == len(flags):
                return not whole or all(q for _, q in rule[at:])
            if at == len(rule):
                return False
            flag, q = rule[at]
            if not flags[i].isdisjoint(named) and (flag == "." or flag in flags[i]) and run(rule, at if q == "*" else at + 1, i + 1):
                return True
            return bool(q) and run(rule, at + 1, i)

        return any(run(r, 0, 0) for r in self.aff.compound_rules)

    def _bad_compound(self, parts: list[tuple], kind: str) -> bool:
        aff, texts = self.aff, [p[0] for p in parts]
        force = aff.flag("force_ucase")
        if force and kind not in ("all", "init") and any(force in e.flags for e in self.by_stem.get(texts[-1], ())):
            return True
        for i, (left, right) in enumerate(zip(texts, texts[1:])):
            forbid = aff.flag("compound_forbid")
            if forbid and any(forbid in e.flags for e in self.by_stem.get(left, ())):
                return True
            rebuilt = parts[i][3]  # its letters are none that anybody typed: no check of the seam
            tripled = (len(left) > 1 and len({*left[-2:], right[:1]}) == 1) or (len(right) > 1 and len({left[-1:], *right[:2]}) == 1)
            if "check_triple" in aff.switches and not rebuilt and tripled:
                return True
            if "check_case" in aff.switches and not rebuilt and (left[-1:].isupper() or right[:1].isupper()) and "-" not in (left[-1:], right[:1]):
                return True
            if not rebuilt and any(self._ends(a, parts[i]) and self._begins(b, parts[i + 1]) for a, b, _ in aff.compound_patterns):
                return True
            if "check_dup" in aff.switches and left == right and i == len(texts) - 2:
                return True
        return "check_rep" in aff.switches and any(self._misread("".join(texts[a:b])) for a in range(len(texts)) for b in range(a + 2, len(texts) + 1))

    def _flagged(self, flag: str, part: tuple) -> bool:
        return not flag or (part[2] is not None and flag in self._flags(part[1], part[2]))

    def _ends(self, pattern: str, part: tuple) -> bool:
        """Left side of a seam's pattern: text it ends with, or after a ``0`` its bare stem; and a flag."""
        text, _, flag = pattern.partition("/")
        end = part[1].stem if text[:1] == "0" and part[1] is not None else "" if text[:1] == "0" else text
        return part[0].endswith(end) and self._flagged(flag, part)

    def _begins(self, pattern: str, part: tuple) -> bool:
        """Right side: text it begins with, in which a ``.`` stands for nothing; and a flag."""
        text, _, flag = pattern.partition("/")
        return part[0].startswith(text.replace(".", "")) and self._flagged(flag, part)

    def _misread(self, text: str) -> bool:
        """A replacement or a blank makes it a word of the dictionary."""
        plain = lambda w: any(True for _ in self._forms(w, "no"))
        for a, b in self.aff.rep:
            for m in re.finditer(re.escape(a.strip("^$")), text):
                if plain(text[: m.start()] + b.replace("_", " ") + text[m.end() :]):
                    return True
        return self.spaced and any(plain(text[:i] + " " + text[i:]) for i in range(1, len(text)))


def entry_table(spark, dictionary: Dictionary) -> DataFrame:
    return spark.createDataFrame([(i, e.stem, sorted(e.flags)) for i, e in enumerate(dictionary.entries)], "entry_id long, stem string, flags array<string>")


def affix_table(spark, dictionary: Dictionary) -> DataFrame:
    rows = [(i, a.kind, a.flag, a.cross, a.strip, a.add, a.condition, sorted(a.flags)) for i, a in enumerate(dictionary.aff.affixes)]
    return spark.createDataFrame(rows, "affix_id int, kind string, flag string, crossproduct boolean, strip string, add string, cond_regex string, cont_flags array<string>")


def analyses(words: DataFrame, entries: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, stem, prefix, suffix (affix ids): readings as a whole, with one suffix, one prefix, or both.

    Every cut of a word up to the affixes' lengths is exploded and joined on equality; an
    empty ending stands for an affix that adds nothing.
    """
    most = F.lit(affixes.agg(F.max(F.length("add"))).first()[0] or 0)
    side = lambda kind: affixes.where(F.col("kind") == kind).select(*[F.col(c).alias(f"{kind}_{c}") for c in ("affix_id", "flag", "crossproduct", "strip", "add", "cond_regex")])
    ok = lambda kind, stem: (F.col(f"{kind}_cond_regex") == "") | F.rlike(stem, F.col(f"{kind}_cond_regex"))
    w = F.col("rest")

    def strip_suffix(t: DataFrame) -> DataFrame:
        cut = t.select("*", F.explode(F.sequence(F.lit(0), F.least(F.length(w), most))).alias("k")).withColumn("end", F.right(w, F.col("k")))
        out = cut.join(side("SFX"), F.col("end") == F.col("SFX_add")).withColumn("stem", F.concat(F.left(w, F.length(w) - F.col("k")), F.col("SFX_strip")))
        return out.where(ok("SFX", F.col("stem"))).drop("k", "end")

    start = words.select("word").distinct().withColumn("rest", F.col("word"))
    cut = start.select("*", F.explode(F.sequence(F.lit(0), F.least(F.length(w), most))).alias("k")).withColumn("head", F.left(w, F.col("k")))
    prefixed = cut.join(side("PFX"), F.col("head") == F.col("PFX_add")).withColumn("stem", F.concat(F.col("PFX_strip"), F.substring(w, F.col("k") + 1, F.length(w))))
    prefixed = prefixed.where(ok("PFX", F.col("stem"))).drop("k", "head")
    none = F.lit(None).cast("int")
    shapes = [
        start.select("word", F.col("rest").alias("stem"), none.alias("prefix"), none.alias("suffix"), F.array().cast("array<string>").alias("need")),
        strip_suffix(start).select("word", "stem", none, F.col("SFX_affix_id"), F.array("SFX_flag")),
        prefixed.select("word", "stem", F.col("PFX_affix_id"), none, F.array("PFX_flag")),
        strip_suffix(prefixed.where("PFX_crossproduct").select("word", F.col("stem").alias("rest"), "PFX_affix_id", "PFX_flag")).where("SFX_crossproduct").select("word", "stem", "PFX_affix_id", "SFX_affix_id", F.array("PFX_flag", "SFX_flag")),
    ]
    forms = shapes[0]
    for s in shapes[1:]:
        forms = forms.union(s)
    found = forms.join(entries.select(F.col("stem").alias("entry"), "flags"), F.col("stem") == F.col("entry"))
    return found.where(F.forall("need", lambda f: F.array_contains("flags", f))).select("word", "stem", "prefix", "suffix").distinct()


@lru_cache(maxsize=8)
def _compiled(aff: str, dic: str) -> Dictionary:
    return Dictionary(aff, dic)


def correct(words: DataFrame, aff: str, dic: str, column: str = "word") -> DataFrame:
    """Distinct words with ``correct``; each is checked once, on all cores: few bytes of words are much work."""
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    @F.pandas_udf(BooleanType())
    def check(w: pd.Series) -> pd.Series:
        d = _compiled(aff, dic)
        return w.map(d.correct)

    return words.select(F.col(column).alias("word")).repartition(parts, "word").distinct().withColumn("correct", check("word"))


class Speller:
    """A dictionary over tables: ``correct`` and ``suggest`` of word columns.

    Files are read by Spark, from any store it knows; a dictionary is a fixed-size input."""

    def __init__(self, spark, aff: bytes | str, dic: bytes | str):
        self.spark, self.compiled = spark, Dictionary(aff, dic)
        encoding = encoding_of(aff if isinstance(aff, bytes) else aff.encode())
        self.aff, self.dic = (x.decode(encoding, "replace") if isinstance(x, bytes) else x for x in (aff, dic))

    @classmethod
    def load(cls, spark, aff_path: str, dic_path: str) -> "Speller":
        read = lambda path: bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
        return cls(spark, read(aff_path), read(dic_path))

    @property
    def words(self) -> DataFrame:
        """word: distinct lower-case stems."""
        return self.spark.createDataFrame([(w,) for w in self.compiled.words], "word string")

    def correct(self, words: DataFrame, column: str = "word") -> DataFrame:
        """Distinct words with ``correct``."""
        return correct(words, self.aff, self.dic, column)

    def accepted(self, words: DataFrame) -> DataFrame:
        """word: the distinct words that the dictionary takes."""
        return self.correct(words).where("correct").select("word")

    def suggest(self, words: DataFrame, column: str = "word", limit: int = 5, *, lexicon: DataFrame | None = None) -> DataFrame:
        """query, rank, word, distance, confidence, source for each distinct word that the dictionary
        does not take. Besides its stems, forms that a single edit (letters of TRY) makes and the
        dictionary takes are candidates. With a ``lexicon`` (word, rank) its words lead."""
        from . import suggest as S

        aff, dic, letters = self.aff, self.dic, self.compiled.aff.try_
        asked = self.correct(words, column).where("not correct and word is not null and word <> ''").select("word").persist(StorageLevel.DISK_ONLY)  # read twice

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = _compiled(aff, dic)
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*map(d.edits, batch.column("word")[a : a + 1024].to_pylist()))), pa.string())], ["word"])

        forms = (asked.mapInArrow(made, "word string").union(self.words) if letters else self.words).distinct().persist(StorageLevel.DISK_ONLY)
        return S.suggest(asked, self.words, lexicon=lexicon, accepted=forms, alphabet=letters, limit=limit)


def by_language(requests: DataFrame, spellers: dict[str, Speller], limit: int = 5) -> DataFrame:
    """Answers to requests (req_id, kind, language, words): check gives word, correct; suggest gives
    word, rank, suggestion, distance, confidence, source. Requests in a language without a
    dictionary get one row with the status ``unknown_language``."""
    each = requests.select("req_id", "kind", "language", F.explode_outer("words").alias("word"))
    none = {"correct": "boolean", "rank": "int", "suggestion": "string", "distance": "int", "confidence": "double", "source": "string"}
    columns = ["req_id", "kind", "language", "word", *none, "status"]
    fill = lambda t, **have: t.select(*[have[c].alias(c) if c in have else F.lit(None).cast(none[c]).alias(c) if c in none else F.col(c) for c in columns])
    known = F.col("language").isin(list(spellers)) if spellers else F.lit(False)
    out = fill(each.where(~F.coalesce(known, F.lit(False))).select("req_id", "kind", "language").distinct().withColumn("word", F.lit(None).cast("string")), status=F.lit("unknown_language"))
    for language, speller in spellers.items():
        mine = each.where(F.col("language") == language).where("word is not null")
        told = speller.correct(mine.where("kind = 'check'")).withColumnRenamed("word", "w")
        checked = mine.where("kind = 'check'").join(told, F.col("word") == F.col("w"))
        out = out.unionByName(fill(checked, correct=F.col("correct"), status=F.lit("ok")))
        found = speller.suggest(mine.where("kind = 'suggest'"), limit=limit).withColumnRenamed("word", "suggestion")
        met = mine.where("kind = 'suggest'").join(found, F.col("word") == F.col("query"))
        out = out.unionByName(fill(met, **{c: F.col(c) for c in ("rank", "suggestion", "distance", "confidence", "source")}, status=F.lit("ok")))
    return out


def register(spark, name: str, aff: str, dic: str) -> None:
    """SQL function ``name(word)``: whether the dictionary takes a word."""

    @F.pandas_udf(BooleanType())
    def check(w: pd.Series) -> pd.Series:
        d = _compiled(aff, dic)
        return w.map(d.correct)

    spark.udf.register(name, check)
