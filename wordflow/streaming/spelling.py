"""Spell checking of streams: stream-static joins and windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def misspelled_stream(texts: DataFrame, lexicon: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """Words of a (streaming) table that the static lexicon lacks; works on batches alike."""
    each = texts.select(*keep, F.explode(T.words(F.col(text_col))).alias("raw")).where(F.length("raw") >= 2).withColumn("word", F.lower("raw"))
    return each.join(lexicon.select(F.col("word").alias("known")), F.col("word") == F.col("known"), "left_anti").select(*keep, "word")


def windowed_counts(events: DataFrame, *, time_col: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = None, by: str = "event_type") -> DataFrame:
    """Events and their value by tumbling or sliding window; ``late`` sets a watermark."""
    rows = events.withWatermark(time_col, late) if late else events
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def session_counts(events: DataFrame, *, time_col: str = "ts", gap: str = "30 minutes", late: str | None = None, by: str = "user_id") -> DataFrame:
    """Events by session: a gap without any ends it."""
    rows = events.withWatermark(time_col, late) if late else events
    return rows.groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def route(requests: DataFrame) -> DataFrame:
    """Requests of one batch in the order of service: single ones before batches, and of a
    session's batches only the latest."""
    latest = F.max(F.when(F.col("type") == "suggest-batch", F.col("batch_id"))).over(Window.partitionBy("session"))
    rows = requests.withColumn("latest", latest).where((F.col("type") != "suggest-batch") | (F.col("batch_id") == F.col("latest")))
    priority: Column = (F.col("type") == "suggest-batch").cast("int")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(priority, "request_id"))).drop("latest")
