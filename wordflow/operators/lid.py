"""Language identification with a hierarchical-softmax model over hashed subwords."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .grammar import spread

#: The end-of-line token, and the multiplier of word n-gram hashes.
EOS, NGRAM_PRIME = "</s>", 116049371
#: Tokens whose rows a task remembers.
MEMO_TOKENS = 200_000
#: Rows added up at a time.
PIECE = 4096

_SPACE = re.compile("[ \t\n\r\f\v\0]+")


def fnv1a(data: bytes) -> int:
    """32-bit FNV-1a with sign-extended bytes."""
    h = 2166136261
    for b in data:
        h = (h ^ (b | 0xFFFFFF00 if b > 127 else b)) * 16777619 & 0xFFFFFFFF
    return h


def subwords(token: str, low: int, high: int) -> list[str]:
    """Character n-grams of the bracketed token; single brackets are none."""
    w = f"<{token}>"
    return [w[i : i + n] for i in range(len(w)) for n in range(1, high + 1) if i + n <= len(w) and n >= low and not (n == 1 and (i == 0 or i + n == len(w)))]


def routes(counts: list[int]) -> list[list[tuple[int, bool]]]:
    """(inner node, side) from each leaf to the root of the Huffman tree of counts in falling order.

    Two queues give the smallest two each time; of equals the inner node goes first.
    """
    leaves = deque((c, i) for i, c in reversed(list(enumerate(counts))))
    inner: deque[tuple[int, int]] = deque()
    above: dict[int, tuple[int, bool]] = {}
    for k in range(len(counts) - 1):
        two = []
        for _ in range(2):
            leaf_first = leaves and (not inner or leaves[0][0] < inner[0][0])
            two.append((leaves if leaf_first else inner).popleft())
        node = len(counts) + k
        above[two[0][1]], above[two[1][1]] = (node, False), (node, True)
        inner.append((two[0][0] + two[1][0], node))
    out = []
    for leaf in range(len(counts)):
        path, at = [], leaf
        while at in above:
            at, side = above[at]
            path.append((at - len(counts), side))
        out.append(path)
    return out


@dataclass
class LidModel:
    """Rows of words then of hashed n-grams (optionally pruned), and the label tree's weights."""

    words: dict[str, int]
    rows: np.ndarray
    tree: np.ndarray
    labels: list[str]
    counts: list[int]
    bucket: int
    low: int = 2
    high: int = 4
    word_ngrams: int = 1
    prune: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.counts) or self.rows.shape[1] != self.tree.shape[1]:
            raise ValueError("labels, counts and weights differ in size")
        if len(self.rows) != len(self.words) + (len(self.prune) or self.bucket):
            raise ValueError("rows are not one a word and one an n-gram")
        self.routes = routes(self.counts)
        self._single = self.rows.astype(np.float32, copy=False)

    def _hashed(self, h: int) -> list[int]:
        at = self.prune.get(h) if self.prune else h
        return [] if at is None else [len(self.words) + at]

    def token_rows(self, token: str) -> list[int]:
        """Rows of one token and of its n-grams; the end of the line has no n-grams."""
        out = [self.words[token]] if token in self.words else []
        for g in subwords(token, self.low, self.high) if token != EOS else ():
            out += self._hashed(fnv1a(g.encode()) % self.bucket)
        return out

    def features(self, text: str, memo: dict[str, list[int]] | None = None) -> list[int]:
        """Rows of a text's tokens and their n-grams, then of the end of the line, then of word n-grams."""
        tokens, out = [t for t in _SPACE.split(text) if t] + [EOS], []
        memo = {} if memo is None else memo
        for token in tokens:
            if token not in memo:
                memo[token] = self.token_rows(token)
            out += memo[token]
        hashes = [fnv1a(t.encode()) for t in tokens] if self.word_ngrams > 1 else []
        for i, h in enumerate(hashes):
            for nxt in hashes[i + 1 : i + self.word_ngrams]:
                h = (h * NGRAM_PRIME + nxt) & (2**64 - 1)
                out += self._hashed(h % self.bucket)
        return out

    def hidden(self, text: str, memo: dict[str, np.ndarray] | None = None) -> np.ndarray | None:
        """Mean of the features' rows, added one after the other, PIECE at a time."""
        if self.word_ngrams > 1:
            found = np.array(self.features(text), np.int64)
        else:
            memo = {} if memo is None else memo
            parts = []
            for token in [t for t in _SPACE.split(text) if t] + [EOS]:
                rows = memo.get(token)
                if rows is None:
                    rows = memo[token] = np.array(self.token_rows(token), np.int32)
                parts.append(rows)
            found = np.concatenate(parts)
        if not len(found):
            return None
        total = np.add.reduce(self._single[found[:PIECE]], axis=0)
        for a in range(PIECE, len(found), PIECE):
            total = np.add.reduce(np.concatenate([total[None], self._single[found[a : a + PIECE]]]), axis=0)
        return total * np.float32(1 / len(found))

    def detect_all(self, texts: list[str], memo: dict[str, np.ndarray] | None = None) -> list[tuple[str, float]]:
        """(label, probability) of each text; ties go to the first label, no feature gives no label."""
        hidden = [self.hidden(t, memo) for t in texts]
        known = [i for i, h in enumerate(hidden) if h is not None]
        out = [("", 0.0)] * len(texts)
        if not known or not self.labels:
            return out
        h = np.array([hidden[i] for i in known], np.float32)
        logit = np.stack([self.tree.astype(np.float32) @ x for x in h]).astype(np.float64)
        p = (1 / (1 + np.exp(-logit))).astype(np.float32)
        sides = (np.log((np.float32(1) - p).astype(np.float64) + 1e-5).astype(np.float32), np.log(p.astype(np.float64) + 1e-5).astype(np.float32))
        scores = np.zeros((len(known), len(self.labels)), np.float32)
        for k, route in enumerate(self.routes):  # sums in single precision, from the leaf to the root
            for node, side in route:
                scores[:, k] += sides[side][:, node]
        scores = np.exp(scores.astype(np.float64)).astype(np.float32)
        for i, row in zip(known, scores):
            best = int(row.argmax())
            out[i] = (self.labels[best], float(row[best]))
        return out

    def detect(self, text: str) -> tuple[str, float]:
        return self.detect_all([text])[0]


def token_features(texts: DataFrame, id_col: str, text_col: str = "text", *, low: int = 2, high: int = 4, bucket: int = 2_000_000) -> DataFrame:
    """id, token, gram, bucket of every n-gram of each distinct bracketed token of a text, as expressions."""
    tokens = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), T.LID_SPACE), lambda t: t != ""))
    each = texts.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token")).withColumn("w", F.concat(F.lit("<"), "token", F.lit(">")))
    grams = F.flatten(F.array(*[T.grams(F.col("w"), n) for n in range(max(low, 2), high + 1)]))
    if low < 2:  # single characters, but not the brackets
        grams = F.concat(T.chars(F.col("token")), grams)
    return each.select("id", "token", F.explode(grams).alias("gram")).withColumn("bucket", F.pmod(T.fnv1a(F.col("gram")), F.lit(bucket)))


def read_model(sidecar: str, rows: np.ndarray, tree: np.ndarray, bucket: int | None = None) -> LidModel:
    """A model from its JSON sidecar (labels, label_counts, words, pruneidx, args) and its weights.

    ``words`` is a list or a map to row numbers, ``pruneidx`` a map or pairs; args give bucket,
    minn, maxn and wordNgrams. Sizes and row numbers are checked."""
    import json

    data = json.loads(sidecar)
    args = data.get("args", {})
    words = data["words"]
    words = {w: i for i, w in enumerate(words)} if isinstance(words, list) else {str(w): int(i) for w, i in words.items()}
    prune = data.get("pruneidx") or {}
    prune = {int(a): int(b) for a, b in (prune.items() if isinstance(prune, dict) else prune)}
    if sorted(words.values()) != list(range(len(words))) or sorted(prune.values()) != list(range(len(prune))):
        raise ValueError("words or pruned n-grams don't number their rows from 0 on")
    if len(tree) != len(data["labels"]) and len(tree) != len(data["labels"]) - 1:
        raise ValueError("the tree has neither a row a label nor one an inner node")
    return LidModel(words, rows, tree, list(data["labels"]), list(data["label_counts"]), bucket or int(args.get("bucket", 2_000_000)), int(args.get("minn", 2)), int(args.get("maxn", 4)), int(args.get("wordNgrams", 1)), prune)


def detect(texts: DataFrame, model: LidModel, id_col: str, text_col: str = "text") -> DataFrame:
    """id, code, score; a null text counts as empty."""
    source = spread(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 100):
                found += model.detect_all([t or "" for t in batch.column("text")[a : a + 100].to_pylist()], memo)
                if len(memo) > MEMO_TOKENS:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c for c, _ in found], pa.string()), pa.array([s for _, s in found], pa.float32())], ["id", "code", "score"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, code string, score float")
