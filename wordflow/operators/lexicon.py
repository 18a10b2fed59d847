"""Token tables, ranked lexicons and misspelled words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Ranks up to which a word is very common, common, known, and their bonuses.
TIERS = ((50, 200), (200, 100), (1000, 50))
#: Characters that part the words of a count.
FRONT = 3


def tokens(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """One row a word: word as written, and the columns to keep."""
    return docs.select(*keep, F.explode(T.words(F.col(text_col))).alias("word"))


def counts(docs: DataFrame, *by: str, text_col: str = "text", least: int = 1) -> DataFrame:
    """Lower-case words of two characters or more with how often they occur."""
    t = tokens(docs, text_col, *by).select(*by, F.lower("word").alias("word")).where(F.length("word") >= 2)
    return t.groupBy(*by, "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lexicon(docs: DataFrame, *by: str, least: int = 3) -> DataFrame:
    """Words of at least ``least`` occurrences, with rank from 1 (count, then word), by group."""
    table = counts(docs, *by, least=least)
    if by:
        return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word")).cast("long"))
    return with_global_rank(table)


def with_global_rank(table: DataFrame) -> DataFrame:
    """rank over a whole table without moving it to one task.

    Words are ranked inside their count and their first FRONT characters, which order them;
    the number of words before such a group comes from a small table of the groups' sizes."""
    front = F.left("word", F.lit(FRONT)).alias("front")
    sizes = table.groupBy("n", front).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.desc("n"), "front").rowsBetween(Window.unboundedPreceding, -1))
    above = sizes.select("n", "front", F.coalesce(before, F.lit(0)).alias("above"))
    inner = F.row_number().over(Window.partitionBy("n", "front").orderBy("word"))
    ranked = table.select("word", "n", front).withColumn("inner", inner)
    return ranked.join(above, ["n", "front"]).select("word", "n", (F.col("above") + F.col("inner")).cast("long").alias("rank"))


def tier_bonus(rank) -> F.Column:
    """Bonus of a frequency rank; null ranks have none."""
    out = F.lit(0)
    for top, bonus in reversed(TIERS):
        out = F.when(rank <= top, bonus).otherwise(out)
    return out


def misspelled(docs: DataFrame, lexicon_: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """Distinct words whose lower-case form the lexicon lacks, by the columns to keep."""
    t = tokens(docs, text_col, *keep).where(F.length("word") >= 2).select(*keep, F.lower("word").alias("word")).distinct()
    return t.join(lexicon_.select("word"), "word", "left_anti").select(*keep, "word")
