"""Hybrid typo retrieval: a character BiGRU encoder, an int8 index, and a cosine rescore."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks

#: Characters that the encoder sees, and the least size of a slate.
WINDOW, SLATE = 24, 20


def quantize_dynamic(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed 8-bit values, scale and zero point of each row, over a range that holds 0."""
    low, high = np.minimum(x.min(-1), 0), np.maximum(x.max(-1), 0)
    scale = ((high - low) / np.float32(255)).astype(np.float32)
    flat = scale == 0
    safe = np.where(flat, np.float32(1), scale)
    away = lambda v: np.trunc(v + np.copysign(0.5, v))  # noqa: E731  half away from zero
    zero = np.clip(away(-128 - away(low / safe)), -128, 127).astype(np.int32)
    q = np.clip(away(x / safe[..., None]) + zero[..., None], -128, 127).astype(np.int32)
    return np.where(flat[..., None], 0, q), safe, np.where(flat, 0, zero)


def quantize_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric int8 rows and their scales; zero rows stay zero."""
    scale = np.abs(x).max(1) / np.float32(127)
    safe = np.where(scale == 0, 1, scale)[:, None]
    v = x / safe
    return np.trunc(v + np.copysign(0.5, v)).clip(-127, 127).astype(np.int8), scale.astype(np.float32)


@dataclass
class Gru:
    """One direction: input and recurrent weights of the gates z, r, n, and both biases."""

    w: np.ndarray  # 3H x C
    r: np.ndarray  # 3H x H
    bw: np.ndarray
    br: np.ndarray

    def run(self, x: np.ndarray, backward: bool) -> np.ndarray:
        """States of a batch (words x steps x features), the reset gate after the recurrent product."""
        n, steps, _ = x.shape
        size = self.r.shape[1]
        h, out = np.zeros((n, size), np.float32), np.zeros((n, steps, size), np.float32)
        gates = x @ self.w.T + self.bw
        for t in reversed(range(steps)) if backward else range(steps):
            rec = h @ self.r.T + self.br
            z, r = (1 / (1 + np.exp(-(gates[:, t, a : a + size] + rec[:, a : a + size]))) for a in (0, size))
            new = np.tanh(gates[:, t, 2 * size :] + r * rec[:, 2 * size :])
            h = (1 - z) * new + z * h
            out[:, t] = h
        return out


@dataclass
class Encoder:
    """Character vectors, two GRUs, a quantised projection; unknown characters share the last row."""

    chars: dict[str, int]
    table: np.ndarray
    forward: Gru
    backward: Gru
    proj_q: np.ndarray
    proj_scale: float
    proj_zero: int
    bias: np.ndarray

    def embed(self, words: list[str]) -> np.ndarray:
        """Unit vectors; the recurrence runs over the whole padded window, the mean over the word."""
        ids = np.zeros((len(words), WINDOW), np.int64)
        size = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            found = [self.chars.get(c, len(self.table) - 1) for c in w[:WINDOW]]
            ids[i, : len(found)], size[i] = found, len(found)
        x = self.table[ids].astype(np.float32)
        both = np.concatenate([self.forward.run(x, False), self.backward.run(x, True)], axis=2)
        mask = np.arange(WINDOW) < size[:, None]
        pooled = (both * mask[:, :, None]).sum(1) / np.maximum(size, 1)[:, None].astype(np.float32)
        q, scale, zero = quantize_dynamic(pooled.astype(np.float32))
        out = ((q - zero[:, None]) @ (self.proj_q.astype(np.int32) - self.proj_zero)) * (scale * self.proj_scale)[:, None] + self.bias
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(words: DataFrame, encoder: Encoder) -> DataFrame:
    """word, vec of distinct non-empty words, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = encoder.embed(batch.column("word").to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(list(vec), pa.list_(pa.float32()))], ["word", "vec"])

    return words.select("word").where("word <> ''").distinct().mapInArrow(run, "word string, vec array<float>")


def index(vectors: DataFrame) -> DataFrame:
    """word, q (int8 row), scale of every vector."""
    return vectors.select("word", V.int8_quantize(F.col("vec")).alias("q"), V.int8_scale(F.col("vec")).alias("scale"))


def slate(queries: DataFrame, index_: DataFrame, k: int = SLATE) -> DataFrame:
    """query, rank, word, score: the ``max(20, k)`` largest quantised products, ties by word,
    never the query itself or its lower case. Queries that the index lacks have none (their slate is null)."""
    q = queries.select(F.col("word").alias("query")).distinct().join(index_.select(F.col("word").alias("query"), F.col("q").alias("qq"), F.col("scale").alias("qs")), "query")
    data = index_.select("word", F.col("q").alias("v"), F.col("scale").alias("s"))
    return blocks.search(q.select("query", F.col("qq").alias("v"), F.col("qs").alias("s")), data, max(SLATE, k), divide=False)


def rescore(slate_: DataFrame, tier: DataFrame, k: int = 5) -> DataFrame:
    """query, rank, word, score: the slate's words by cosine of the tier's vectors, ties in slate order."""
    a = tier.select(F.col("word").alias("query"), F.col("vec").alias("qv"))
    rows = slate_.withColumnRenamed("rank", "place").join(a, "query").join(tier.select("word", "vec"), "word").withColumn("score", V.cosine(F.col("qv"), F.col("vec")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "word", "score")
