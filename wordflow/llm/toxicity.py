"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets (2**BITS) of its words, their stems
(first bytes, for inflected forms), word pairs and pairs around one skipped word. The fit takes a bounded hash sample of the
labelled rows (``sample_rows`` a class), the intercept then takes back the classes' unequal
shares in it; L1 leaves few weights, which go to
the executors as two small arrays whose size the sample bounds, and scoring is
a scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memos, words

BITS = 20
SAMPLE_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.01
STEM_BYTES = (4, 5)


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets of all features of a text, with repeats."""
    tokens = (text or "").encode("utf-8").lower().translate(words.LETTERS).split()
    if not tokens:
        return np.empty(0, np.int64)
    h = words.HASHER.array(tokens)
    pairs = words.mix(h[:-1] * np.uint64(3) + h[1:])
    skips = words.mix(h[:-2] * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]
    stems = [words.mix(words.HASHER.array([t[:n] for t in tokens]) + np.uint64(n)) for n in STEM_BYTES]
    return (np.concatenate([h, pairs, skips, *stems]) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Nonzero weights by ascending bucket, and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    intercept: float
    bits: int = BITS

    def scorer(self):
        table = np.zeros(1 << self.bits, np.float32)
        table[self.at] = self.weight

        def score(text: str | None) -> float:
            found = buckets(text, self.bits)
            found = found[table[found] != 0]
            margin = self.intercept + float(table[np.unique(found)].sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

        return score


def fit(examples: list[tuple[np.ndarray, int]], *, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, bits: int = BITS) -> Model:
    """FTRL-proximal with a learning rate a coordinate; ``examples``: (distinct buckets, label)."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the intercept, free of L1
    for _ in range(epochs):
        for at, label in examples:
            at = np.append(at, size)
            zs, ns = z[at], n[at]
            root = np.sqrt(ns)
            shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
            shrunk[-1] = zs[-1]
            w = -shrunk / ((beta + root) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(ns + g * g) - root) / alpha * w
            n[at] += g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    keep = np.flatnonzero(w[:-1])
    return Model(keep, w[keep].astype(np.float32), float(-z[-1] / ((beta + np.sqrt(n[-1])) / alpha + l2)), bits)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most about ``sample_rows`` labelled rows of each class, drawn by a hash of the id.

    Only the drawn ids, bounded so, are broadcast to the documents; of an id's documents the one
    with the smallest hash teaches, by its whole text, of which only the buckets come back (at
    most 4 * 2**BITS bytes). Labels other than 0 and 1, null ids and unlabelled documents teach
    nothing; of several labels of one id the largest counts. Without any labelled row every
    score is 0.5. Where only part of a class is drawn, the intercept is corrected for it.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("labelled")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r.y: r.n for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([])
    cut = F.create_map(*[F.lit(v) for y_, n in sizes.items() for v in (y_, min(1 << 30, (sample_rows << 30) // n))])
    drawn = y.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 30)) < cut[F.col("y")])  # about 2 * sample_rows ids
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("labelled"))
    one = found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.claim("words")
        for batch in batches:
            steps = [np.diff(np.unique(buckets(t.as_py())), prepend=0) for t in batch.column("text")]
            wide = [bool(x.max(initial=0) >= 1 << 16) for x in steps]
            at = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(steps, wide)]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), pa.array(at, pa.binary()), pa.array(wide)], ["order", "y", "steps", "wide"])

    # steps between buckets, mostly of two bytes, and 32-bit buckets keep the driver's memory small
    rows = one.select("text", "y", F.xxhash64("id", F.lit(7)).alias("order")).mapInArrow(distinct, "order long, y int, steps binary, wide boolean").collect()
    rows.sort(key=lambda r: (r.order, bytes(r.steps)))
    model = fit([(np.cumsum(np.frombuffer(r.steps, "<u4" if r.wide else "<u2"), dtype=np.int32), r.y) for r in rows])
    if len(sizes) == 2:
        share = {y_: min(1.0, sample_rows / n) for y_, n in sizes.items()}
        model.intercept -= float(np.log(share[1] / share[0]))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), and the columns named in ``carry``.

    Null and empty texts score the intercept alone; texts of any length count whole. Ids pass through, null or repeated;
    other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string").alias("__text")
    source = docs.select(F.col(id_col).alias("doc_id"), text, *[c for c in carry if c != text_col])
    place = {c: "__text" if c == text_col else c for c in ("doc_id", *carry)}  # the text goes through once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.claim("words")
        of = model.scorer()
        for batch in batches:
            s = np.array([of(x.as_py()) for x in batch.column("__text")], np.float64)
            kept = ["doc_id", *carry]
            yield pa.RecordBatch.from_arrays([*(batch.column(place[c]) for c in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[place[c]]}" for c in ("doc_id", *carry)) + ", score double, predicted int")
