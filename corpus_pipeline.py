"""The corpus pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame; all but the last return the columns of docs.
``run`` writes each stage's rows as Parquet to the shared folder and reads
them again for the next, so no stage computes its predecessors twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordflow.llm import langid, near_dedup, packing, storage, substring_dedup, toxicity
from wordflow.llm.queries import id_fold

#: Classifiers and hashing have no counterpart in SQL.
ORACLE_SQL = None


def _with_rest(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no name of docs can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("rest"))


def _unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` again."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.where(id_fold(5) != 0), labels)
    return _unpacked(toxicity.score(_with_rest(docs), model, carry=("text", "rest")).where("predicted = 0"), docs)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letter, or a posterior under one half."""
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.train(docs.where(id_fold(4) != 2), pieces)
    told = langid.predict(_with_rest(docs), model, carry=("text", "rest"))
    return _unpacked(told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= 0.5)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; rows without words stay."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go from the text; every row stays."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = substring_dedup.dedup(docs, keep_text=True, carry=others)
    text = F.col("kept_text").alias("text")
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.select(*[{"text": text, "n_chars": size}.get(c, F.col(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all that is left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_entries=500_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
