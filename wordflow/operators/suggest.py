"""The suggestion composite: four strategies and the frequency slate, merged and ranked."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from . import candidates as C
from .lexicon import tier_bonus

#: Most rows of a strategy, and the gates of edit candidates.
MOST, KEEP, CONFIDENCE, SIMILARITY = 10, 3, 0.75, 0.70
#: Sources in their order.
SOURCES = ("symspell", "edit_distance", "phonetic", "keyboard_proximity", "ngram")
COLUMNS = ("query", "word", "distance", "confidence", "source", "length", "ngram_score")


def ranked_set(found: DataFrame, limit: int, *, source_matters: bool = False) -> DataFrame:
    """Sort, keep the first of each lower-case word, cut at ``limit``; adds ``rank``.

    Order: combined score, distance, difference in length, n-gram score, lower-case word;
    then the word itself and the source, which makes it total.
    """
    score = D.combined_score(F.col("distance"), F.col("confidence"))
    source = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    order = [F.desc("score"), F.asc("distance"), F.asc(F.abs(F.length("word") - F.col("length"))), F.desc("ngram_score"), F.asc(F.lower("word")), F.asc("word"), F.asc(source)]
    w = found.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    w = w.withColumn("again", F.row_number().over(Window.partitionBy("query", F.lower("word")).orderBy("place"))).where("again = 1")
    w = w.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("rank") <= limit)
    return w.select(*COLUMNS, "rank")


def edit_confidence(queries: DataFrame, words: DataFrame, ranks: DataFrame, alphabet: str = "", accepted: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Edit candidates with score and confidence: 1 at a query's best score, 0 at its worst."""
    pairs = C.edit_pairs(queries, words) if near is None else near
    if alphabet:
        pairs = pairs.union(C.edit_sweep(queries, accepted if accepted is not None else words, alphabet)).groupBy("query", "word").agg(F.min("distance").alias("distance"))
    low = ranks.select(F.col("word").alias("low"), F.col("rank").alias("frequency"))
    pairs = pairs.join(low, F.lower("word") == F.col("low"), "left")
    scored = pairs.withColumn("score", D.enhanced_score(F.col("query"), F.col("word"), F.col("distance"), tier_bonus(F.col("frequency"))))
    letters = r"^\p{IsAlphabetic}*$"
    scored = scored.where(~F.col("query").rlike(letters) | F.col("word").rlike(letters))
    first = F.row_number().over(Window.partitionBy("query", F.lower("word")).orderBy("score", "word"))
    scored = scored.withColumn("first", first).where("first = 1")
    q = Window.partitionBy("query")
    spread = F.max("score").over(q) - F.min("score").over(q)
    confidence = F.when(spread > 0, F.lit(1.0) - (F.col("score") - F.min("score").over(q)) / spread).otherwise(1.0)
    return scored.withColumn("confidence", confidence).withColumn("similarity", D.typo_similarity(F.col("query"), F.col("word"))).select("query", "word", "distance", "score", "confidence", "similarity")


def edit_strategy(*args, **how) -> DataFrame:
    """Three best always, others if confident and similar, ten at most."""
    found = edit_confidence(*args, **how)
    order = Window.partitionBy("query").orderBy("score", F.lower("word"), "word")
    found = found.withColumn("rn", F.row_number().over(order)).where((F.col("rn") <= KEEP) | ((F.col("confidence") >= CONFIDENCE) & (F.col("similarity") >= SIMILARITY)))
    found = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= MOST)
    return ranked_set(found.select("query", "word", "distance", "confidence", F.lit("edit_distance").alias("source"), F.length("query").alias("length"), F.col("similarity").alias("ngram_score")), MOST)


def phonetic_strategy(queries: DataFrame, words: DataFrame, near: DataFrame | None = None) -> DataFrame:
    found = C.phonetic_pairs(queries, words, near)
    return ranked_set(found.select("query", "word", F.lit(1).alias("distance"), F.lit(0.5).alias("confidence"), F.lit("phonetic").alias("source"), F.length("word").alias("length"), F.lit(0.0).alias("ngram_score")), MOST)


def _by_distance(found: DataFrame, source: str) -> DataFrame:
    return ranked_set(found.select("query", "word", "distance", (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("confidence"), F.lit(source).alias("source"), F.length("query").alias("length"), F.col("similarity").alias("ngram_score")), MOST)


def keyboard_strategy(queries: DataFrame, words: DataFrame, near: DataFrame | None = None) -> DataFrame:
    return _by_distance(C.keyboard_pairs(queries, words, near=near), "keyboard_proximity")


def ngram_strategy(queries: DataFrame, words: DataFrame) -> DataFrame:
    return _by_distance(C.ngram_pairs(queries, words, most=MOST), "ngram")


def suggest(queries: DataFrame, words: DataFrame, *, lexicon: DataFrame | None = None, accepted: DataFrame | None = None, alphabet: str = "", limit: int = 5) -> DataFrame:
    """query, rank, word, distance, confidence, source of each distinct query word.

    ``words``: the dictionary's list. ``accepted``: all forms it takes (by default the list);
    accepted and empty queries have no suggestions, vowel marks are dropped first. With a
    ``lexicon`` (word, rank) its slate leads and the strategies fill up in their order; without
    one all strategies' candidates are ranked together.
    """
    accepted = words if accepted is None else accepted
    q = queries.select(T.strip_vowel_marks(F.col("word")).alias("word")).where("word <> ''").distinct()
    q = q.join(accepted.select("word"), "word", "left_anti").persist(StorageLevel.DISK_ONLY)  # read by every strategy
    ranks = lexicon if lexicon is not None else words.select("word", F.lit(None).cast("int").alias("rank"))
    near = C.edit_pairs(q, words).persist(StorageLevel.DISK_ONLY)  # three strategies start from it; lineage stays
    pool = None
    for order, t in enumerate([edit_strategy(q, words, ranks, alphabet, accepted, near), phonetic_strategy(q, words, near), keyboard_strategy(q, words, near), ngram_strategy(q, words)], 1):
        t = t.withColumn("strategy", F.lit(order))
        pool = t if pool is None else pool.unionByName(t)
    if lexicon is None:
        return ranked_set(pool.drop("rank", "strategy"), limit).select("query", "rank", "word", "distance", "confidence", "source")
    lead = C.symspell_slate(q, lexicon, limit).select("query", "rank", "word", "distance", "confidence", F.lit("symspell").alias("source"), F.lit(0).alias("strategy"))
    merged = lead.unionByName(pool.select(*lead.columns))
    order = Window.partitionBy("query").orderBy("strategy", "rank")
    merged = merged.withColumn("again", F.row_number().over(Window.partitionBy("query", F.lower("word")).orderBy("strategy", "rank"))).where("again = 1")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "word", "distance", "confidence", "source")
