"""Candidate generation for misspelled words: equi-joins on keys, never on ranges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import edits as E
from ..functions import keyboard as K
from ..functions import text as T
from . import deletions, trigrams


def _folded_keys(t: DataFrame, w: Column) -> DataFrame:
    """``t`` with the words' folded units (``units``, computed once) and the deletions of these, where folding changes a word."""
    t = t.withColumn("units", T.fold_units(w))
    units = F.col("units")
    less = F.transform(F.sequence(F.lit(1), F.size(units)), lambda i: F.array_join(F.concat(F.slice(units, F.lit(1), i - 1), F.slice(units, i + 1, F.size(units))), ""))
    return t.withColumn("folded", F.when(F.array_join(units, "") != w, less).otherwise(F.array().cast("array<string>")))


def deletion_index(lexicon: DataFrame) -> DataFrame:
    """key, word: deletions, swaps, and deletions of the folded form, of each lexicon word."""
    w = F.col("word")
    keys = F.concat(E.deletes(w), F.filter(E.transpositions(w), lambda x: x != w), F.col("folded"))
    return _folded_keys(lexicon.select("word"), w).select(F.explode(F.array_distinct(keys)).alias("key"), "word").where("key <> ''")


def query_keys(queries: DataFrame) -> DataFrame:
    """word, key: what a query looks up: itself, one and two deletions, deletions of its folded form."""
    low = F.col("low")
    t = _folded_keys(queries.select("word", F.lower("word").alias("low")), low).withColumn("once", F.array_distinct(E.deletes(low)))
    keys = F.concat(F.array(low), F.col("once"), F.flatten(F.transform("once", E.deletes)), F.col("folded"))
    return t.select("word", F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''")


def symspell_pairs(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """query, word: distinct pairs that share a key, or where a deletion of the query is a word."""
    keys = query_keys(queries).withColumnRenamed("word", "query")
    index = deletion_index(lexicon)
    lower = F.lower(F.col("query"))
    shared = keys.join(index, "key").select("query", "word")
    promoted = keys.join(lexicon.select(F.col("word").alias("key")), "key").where(F.col("key") != lower).select("query", F.col("key").alias("word"))
    return shared.union(promoted).where(F.col("word") != lower).distinct()


def symspell_slate(queries: DataFrame, lexicon: DataFrame, limit: int = 5) -> DataFrame:
    """query, rank, word, distance, confidence: up to ``limit`` (at most 10) words within distance 3,
    by distance, double letters first, frequency rank, word. Queries that are words have none."""
    unknown = queries.select("word").distinct().join(lexicon.select(F.col("word").alias("known")), F.lower("word") == F.col("known"), "left_anti")
    pairs = symspell_pairs(unknown, lexicon)
    near = F.abs(F.length("query") - F.length("word")) <= 3
    scored = pairs.where(near).withColumn("distance", D.osa_fast(F.lower(F.col("query")), F.col("word"))).where("distance <= 3")
    scored = scored.join(lexicon.select("word", F.col("rank").alias("frequency")), "word")
    order = Window.partitionBy("query").orderBy("distance", (~D.double_letter_pattern(F.col("query"), F.col("word"))).cast("int"), "frequency", "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(limit, 10)).select("query", "rank", "word", "distance", (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("confidence"))


def edit_pairs(queries: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """query, word, distance: all pairs within OSA distance ``most`` (one or two), by shared deletions (``deletions``)."""
    return deletions.pairs(queries, words, most)


def edit_sweep(queries: DataFrame, accepted: DataFrame, alphabet: str | None = None) -> DataFrame:
    """query, word, distance: accepted words that a single edit of each query makes: a swap of
    neighbours, one letter less, more or other, or two outer swaps of a word of four or five letters.

    ``alphabet``: the letters that may be put in; by default all. The words meet on deletion
    keys (all words one edit away); no edit is written out but the double swaps."""
    words = accepted.select("word").distinct()
    one = edit_pairs(queries, words, 1)
    if alphabet is not None:
        q, w = F.col("query"), F.col("word")
        same = F.length(F.regexp_extract(F.concat_ws("\x00", q, w), "^(.*)[^\x00]*\x00\\1", 1))  # the common front
        put = F.substring(w, same + 1, F.lit(1))
        swapped = (F.length(q) == F.length(w)) & (F.array_sort(T.chars(q)) == F.array_sort(T.chars(w)))
        one = one.where((F.length(w) < F.length(q)) | swapped | F.contains(F.lit(alphabet), put))
    twice = queries.select(F.col("word").alias("query"), F.explode(E.double_swaps(F.col("word"))).alias("word")).distinct()
    both = twice.join(words, "word", "left_semi").where("query <> word").select("query", "word", D.osa_fast(F.col("query"), F.col("word")).alias("distance"))
    return one.unionByName(both.where("distance = 2"))


def phonetic_pairs(queries: DataFrame, words: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """query, word, distance: words of equal soundex code (none equals none) within two edits.

    The distance bounds the join by deletion keys; the code then filters, so a code
    that many words share makes no large group.
    """
    near = edit_pairs(queries, words) if near is None else near
    return near.where(T.soundex(F.col("query")).eqNullSafe(T.soundex(F.col("word"))))


def keyboard_round(t: DataFrame) -> DataFrame:
    """Each variant's mutations by one neighbour substitution, deletion or insertion, or one swap."""
    v = F.col("variant")
    at = F.sequence(F.lit(1), F.length(v))

    def mutate(i):
        c = F.substring(v, i, F.lit(1))
        near = F.coalesce(K.neighbours(c), F.array().cast("array<string>"))
        head, tail, rest = F.left(v, i - 1), F.substring(v, i + 1, F.length(v)), F.substring(v, i, F.length(v))
        return F.when(F.size(near) > 0, F.concat(F.array(F.concat(head, tail)), F.transform(near, lambda n: F.concat(head, n, tail)), F.transform(near, lambda n: F.concat(head, n, rest)))).otherwise(near)

    made = F.when(F.length(v) > 0, F.concat(F.flatten(F.transform(at, mutate)), E.transpositions(v))).otherwise(F.array().cast("array<string>"))
    return t.select("query", F.explode(F.array_distinct(made)).alias("variant"))


def _keyboard_once(word: str) -> set[str]:
    """``keyboard_round`` of one word."""
    out = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    for i, c in enumerate(word):
        near = K.NEIGHBOURS.get(c.lower(), ())
        if near:
            out.add(word[:i] + word[i + 1 :])
            out.update(word[:i] + n + word[i + 1 :] for n in near)
            out.update(word[:i] + n + word[i:] for n in near)
    return out


def _shorter(word: str) -> set[str]:
    """The word and all its deletions of one character."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


#: Names of keys that are longer than a character: an operation may put in one of these.
_NAMES = sorted({n for near in K.NEIGHBOURS.values() for n in near if len(n) > 1})


def _twice(query: str, words: list[str]) -> set[str]:
    """Those of the words that exactly two keyboard operations make of the query.

    Of the first operation's results only those go on from which a word is one edit away (they share
    a deletion), unless the word holds a key's name."""
    first = _keyboard_once(query.lower())
    near = set().union(*map(_shorter, words))
    if not any(n in w for w in words for n in _NAMES):
        first = {v for v in first if not near.isdisjoint(_shorter(v))}
    return set().union(*map(_keyboard_once, first)).intersection(words)


def keyboard_pairs(queries: DataFrame, words: DataFrame, least_similarity: float = 0.70, near: DataFrame | None = None) -> DataFrame:
    """query, word, distance, similarity: words that exactly two keyboard operations reach.

    Only words within two edits may count, so the variants (some ten thousand a query) are
    never joined: a query's candidates (``near``, by default ``edit_pairs``) are held against
    its variants, which live for that query alone. A query's candidates are the lexicon's words
    within two edits: their number follows the language, not the size of the texts.
    """
    near = edit_pairs(queries, words) if near is None else near
    asked = near.where("distance <= 2").groupBy("query").agg(F.collect_list(F.struct("word", "distance")).alias("found"))

    def reached(batches):
        for batch in batches:
            rows = []
            for query, found in zip(batch.column("query").to_pylist(), batch.column("found").to_pylist()):
                second = _twice(query, [f["word"] for f in found]) if query else set()
                rows += [(query, f["word"], f["distance"]) for f in found if f["word"] in second]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["query", "word", "distance"])

    pairs = asked.mapInArrow(reached, "query string, word string, distance int")
    return pairs.withColumn("similarity", D.typo_similarity(F.col("query"), F.col("word"))).where(F.col("similarity") >= least_similarity)


def ngram_pairs(queries: DataFrame, words: DataFrame, least: float = 0.3, least_similarity: float = 0.70, most: int | None = None) -> DataFrame:
    """query, word, jaccard, similarity, distance: words whose trigram multisets overlap enough.

    All pairs are counted in blocks (``trigrams``); no key or join group grows with the texts. ``most``:
    only those that may be among a query's first ``most``."""
    full = trigrams.search(queries, words, least, least_similarity, most)
    return full.withColumn("distance", F.floor((F.lit(1.0) - F.col("jaccard")) * 10).cast("int")).where("distance <> 0").select("query", "word", "jaccard", "similarity", "distance")
