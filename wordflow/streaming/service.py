"""A checking service over tables of requests: check, suggest, semantic and detect, with typed events.

Requests: request_id, session, type, text (a word or a text), limit. ``respond`` is a batch
operator; ``serve`` runs it on every micro-batch of a stream, single requests before batches and
of a session's batches only the latest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lid, rerank
from ..operators.dictionary import Speller
from .spelling import route

COLUMNS = {"rank": "int", "word": "string", "confidence": "double", "source": "string", "code": "string"}


def misspelled(texts: DataFrame, speller: Speller, *keep: str, text_col: str = "text") -> DataFrame:
    """keep, word, place: words of two characters or more that are wrong as written and in lower
    case; of equal lower-case words of a row the first, at its place (from 0)."""
    each = texts.select(*keep, F.posexplode(T.words(F.col(text_col))).alias("place", "word")).where(F.length("word") >= 2)
    first = each.groupBy(*keep, F.lower("word").alias("low")).agg(F.min_by("word", "place").alias("word"), F.min("place").alias("place"))
    known = speller.accepted(first.select("word").union(first.select("low"))).withColumnRenamed("word", "known")
    for column in ("word", "low"):
        first = first.join(known, F.col(column) == F.col("known"), "left_anti")
    return first.select(*keep, "word", "place")


def boosted(suggestions: DataFrame, context: DataFrame, tier: DataFrame, *, most: float = 1.0) -> DataFrame:
    """``rerank.rerank`` with confidences of at most ``most``; words without a vector keep theirs."""
    return rerank.rerank(suggestions, context, tier).withColumn("confidence", F.least(F.col("confidence"), F.lit(most)))


def respond(requests: DataFrame, speller: Speller, tier: DataFrame | None = None, model: lid.LidModel | None = None) -> DataFrame:
    """One row an answer: request_id, type, rank, word, confidence, source, code.

    check: the misspelled words of the text, in order. suggest and suggest-batch: suggestions
    for the word. semantic: its nearest words in the tier. detect: the language's code. A request
    without an answer, of an unknown type, or without what it needs has one row of nulls."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()]
    limit = F.coalesce("limit", F.lit(5))

    def events(rows: DataFrame, **have) -> DataFrame:
        return rows.select("request_id", *[(have[c] if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])

    asked = requests.select("request_id", "type", F.coalesce("text", F.lit("")).alias("text"), limit.alias("limit"))
    wrong = misspelled(asked.where("type = 'check'"), speller, "request_id")
    order = F.row_number().over(rerank.Window.partitionBy("request_id").orderBy("place"))
    out = events(wrong.withColumn("n", order), rank=F.col("n"), word=F.col("word"))
    words = asked.where("type in ('suggest', 'suggest-batch')")
    found = speller.suggest(words, "text", 10).withColumnRenamed("query", "q")
    out = out.unionByName(events(words.join(found, (F.col("text") == F.col("q")) & (F.col("rank") <= F.col("limit"))), **{c: F.col(c) for c in ("rank", "word", "confidence", "source")}))
    if tier is not None:
        words = asked.where("type = 'semantic'")
        near = rerank.semantic_neighbors(words.select(F.col("text").alias("word")), tier, 10).withColumnRenamed("query", "q")
        out = out.unionByName(events(words.join(near, (F.col("text") == F.col("q")) & (F.col("rank") <= F.col("limit"))), rank=F.col("rank"), word=F.col("word"), confidence=F.col("score"), source=F.lit("semantic")))
    if model is not None:
        told = lid.detect(asked.where("type = 'detect'"), model, "request_id").withColumnRenamed("id", "request_id")
        out = out.unionByName(events(told, confidence=F.col("score"), code=F.col("code")))
    rest = asked.join(out.select(F.col("request_id").alias("answered")).distinct(), F.col("request_id") == F.col("answered"), "left_anti").select("request_id", *empty)
    return out.unionByName(rest).join(asked.select("request_id", "type"), "request_id").select("request_id", "type", *COLUMNS)


def serve(requests: DataFrame, write: Callable[[DataFrame, int], None], speller: Speller, tier: DataFrame | None = None, model: lid.LidModel | None = None):
    """A stream writer that answers each micro-batch of requests (with ``batch_id``) and hands the events to ``write``."""

    def answer(batch: DataFrame, number: int) -> None:
        write(respond(route(batch).drop("place"), speller, tier, model), number)

    return requests.writeStream.foreachBatch(answer)
