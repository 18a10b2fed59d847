"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, which
the forward algorithm computes; a text's is the product over its words. The
language with the largest likelihood wins, its posterior under equal priors is
the score.

Piece probabilities come from expectation-maximisation over a bounded hash
sample of whole labelled documents. Prediction is a scan without a shuffle:
each worker runs the vectorised forward algorithm once for a distinct word and
looks the result up after that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memos, words

UNDETERMINED = "und"
#: The fit takes so many whole documents a language, and as many of them as have so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 250, 4 << 20
EM_ROUNDS = 3
WORD_BYTES = 48  # longer words go through the forward algorithm one by one, in logarithms
MEMO_WORDS = 300_000
#: Probabilities are scaled by SCALE a byte so that products of many stay in range.
SCALE = 1000.0
#: A share of every language's mass follows the pooled pieces, and a floor holds for any byte.
POOLED, FLOOR = 0.01, 1e-7

_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(model_path: str) -> list[bytes]:
    """The pieces of a sentencepiece vocabulary, a word's start as a blank, and all single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            found.add(sp.id_to_piece(i).replace("▁", " ").lower().encode("utf-8"))
    return sorted(found)


def text_words(text: str | None) -> list[bytes]:
    """Lower-case words with a leading blank."""
    return [b" " + w for w in (text or "").lower().encode("utf-8").translate(words.LETTERS).split()]


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


class Lattice:
    """Finds all pieces in batches of words."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces])
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.lengths = sorted(set(self.size.tolist()))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & (2**64 - 1)
        return int(words.mix(np.array([h + len(piece) & (2**64 - 1)], np.uint64))[0])

    def edges(self, batch: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, pieces) by ascending end."""
        m, top = len(batch), max(map(len, batch))
        raw = np.zeros((top, m), np.uint64)
        lens = np.fromiter(map(len, batch), np.int64, m)
        flat = np.frombuffer(b"".join(batch), np.uint8)
        row = np.repeat(np.arange(m), lens)
        raw[np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), row] = flat.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((top + 1, m), np.uint64)
        for j in range(top):
            prefix[j + 1] = prefix[j] * _BASE + raw[j]
        power = {n: np.uint64(pow(int(_BASE), n, 1 << 64)) for n in self.lengths}
        for j in range(1, top + 1):
            live = np.flatnonzero(lens >= j)
            for n in self.lengths:
                if n > j:
                    break
                h = words.mix(prefix[j, live] - prefix[j - n, live] * power[n] + np.uint64(n))
                some = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
                h = h[some]
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                ok = self.sorted[at] == h
                piece = self.order[at[ok]]
                fits = self.size[piece] == n
                yield j, n, live[some[ok]][fits], piece[fits]


    def long_edges(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ends, lengths, pieces) of one long word by ascending end, and where each end's begin."""
        raw = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        ends, sizes, found = [], [], []
        for n in self.lengths:
            if n > len(raw):
                break
            h = np.zeros(len(raw) - n + 1, np.uint64)
            for i in range(n):
                h = h * _BASE + raw[i : len(raw) - n + 1 + i]
            h = words.mix(h + np.uint64(n))
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            piece = self.order[at]
            ok = np.flatnonzero((self.sorted[at] == h) & (self.size[piece] == n))
            ends.append(ok + n)
            sizes.append(np.full(len(ok), n))
            found.append(piece[ok])
        end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(found)
        order = np.argsort(end, kind="stable")
        end, size, piece = end[order], size[order], piece[order]
        return end, size, piece, np.searchsorted(end, np.arange(len(raw) + 2))


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    prob: np.ndarray  # pieces x languages

    def scorer(self) -> "Scorer":
        return Scorer(self)


def _forward(edges: list, prob: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """alpha[j, word, language], scaled by SCALE a byte."""
    alpha = np.zeros((int(lens.max()) + 1, len(lens), prob.shape[1]))
    alpha[0] = 1
    for j, n, rows, piece in edges:
        alpha[j, rows] += alpha[j - n, rows] * prob[piece] * SCALE**n
    return alpha


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(0)
    return top + np.log(np.exp(values - top).sum(0))


def _long_forward(edges: tuple, log_prob: np.ndarray, size: int) -> np.ndarray:
    """log alpha[j, language] of one word: linear in its length, safe at any length."""
    _, sizes, piece, at = edges
    alpha = np.zeros((size + 1, log_prob.shape[1]))
    for j in range(1, size + 1):
        x, y = at[j], at[j + 1]
        alpha[j] = _log_sum(alpha[j - sizes[x:y]] + log_prob[piece[x:y]])
    return alpha


def _long_expected(lattice: "Lattice", word: bytes, count: np.ndarray, prob: np.ndarray, expected: np.ndarray) -> None:
    """Add a long word's expected pieces, times its count in each language."""
    edges, log_prob = lattice.long_edges(word), np.log(prob)
    ends, sizes, piece, _ = edges
    alpha = _long_forward(edges, log_prob, len(word))
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    start = ends - sizes
    order = np.argsort(start, kind="stable")
    at = np.searchsorted(start[order], np.arange(len(word) + 1))
    for j in range(len(word) - 1, -1, -1):
        some = order[at[j] : at[j + 1]]
        if len(some):
            beta[j] = _log_sum(beta[ends[some]] + log_prob[piece[some]])
    np.add.at(expected, piece, np.exp(alpha[start] + log_prob[piece] + beta[ends] - alpha[-1]) * count)


class Scorer:
    """Log-likelihoods of texts, word results remembered."""

    def __init__(self, model: Model):
        self.lattice, self.prob, self.log_prob = Lattice(model.pieces), model.prob, np.log(model.prob)
        self.memo: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(model.langs)))

    def learn(self, need: list[bytes]) -> None:
        """Add the words' log-likelihoods, in batches of similar length."""
        need.sort(key=len)
        if len(self.memo) + len(need) > len(self.rows):
            self.rows = np.resize(self.rows, (2 * (len(self.memo) + len(need)), self.rows.shape[1]))
        for a in range(0, len(need), 20_000):
            batch = need[a : a + 20_000]
            lens = np.fromiter(map(len, batch), np.int64, len(batch))
            alpha = _forward(list(self.lattice.edges(batch)), self.prob, lens)
            end = alpha[lens, np.arange(len(batch))]
            at = len(self.memo)
            self.rows[at : at + len(batch)] = np.log(np.maximum(end, 1e-300)) - (lens * np.log(SCALE))[:, None]
            self.memo.update(zip(batch, range(at, at + len(batch))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihood of each text in each language."""
        split = [text_words(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        need = set()
        for w in split:
            need |= set(w).difference(self.memo)
        long = {w: self.long_word(w) for w in need if len(w) > WORD_BYTES}  # not remembered: they may be many bytes
        need.difference_update(long)
        if need:
            self.learn(list(need))
        get = self.memo.__getitem__
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, w in enumerate(split):
            if long and not long.keys().isdisjoint(w):
                out[i] = sum(long[x] for x in w if x in long)
                w = [x for x in w if x not in long]
            out[i] += self.rows[np.fromiter(map(get, w), np.int64, len(w))].sum(0)
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        return _long_forward(self.lattice.long_edges(word), self.log_prob, len(word))[-1]


def fit(samples: dict[str, Counter], pieces: list[bytes], *, rounds: int = EM_ROUNDS) -> Model:
    """Piece probabilities by EM over word counts of each language; languages in text order."""
    langs = sorted(samples)
    vocab = sorted(set().union(*samples.values()), key=lambda w: (len(w), w)) if samples else []
    count = np.array([[samples[x][w] for x in langs] for w in vocab], float).reshape(len(vocab), len(langs))
    prob = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    lattice = Lattice(pieces)
    batches = []
    usual = next((i for i, w in enumerate(vocab) if len(w) > WORD_BYTES), len(vocab))
    for a in range(0, usual, 20_000):
        part = vocab[a : min(a + 20_000, usual)]
        batches.append((list(lattice.edges(part)), np.array([len(w) for w in part]), count[a : a + len(part)]))
    for _ in range(rounds if vocab else 0):
        expected = np.zeros_like(prob)
        for edges, lens, c in batches:
            alpha = _forward(edges, prob, lens)
            cols = np.arange(len(lens))
            beta = np.zeros_like(alpha)
            beta[lens, cols] = c / np.maximum(alpha[lens, cols], 1e-300)
            for j, n, rows, piece in reversed(edges):
                flow = beta[j, rows] * prob[piece] * SCALE**n
                beta[j - n, rows] += flow
                flow = flow * alpha[j - n, rows]
                for k in range(len(langs)):
                    expected[:, k] += np.bincount(piece, flow[:, k], len(pieces))
        for w, c in zip(vocab[usual:], count[usual:]):
            _long_expected(lattice, w, c, prob, expected)
        pooled = expected.sum(1, keepdims=True)
        own = expected / np.maximum(expected.sum(0), 1e-300)
        prob = (1 - POOLED) * own + POOLED * pooled / max(pooled.sum(), 1e-300) + FLOOR
        prob /= prob.sum(0)
    return Model(langs, pieces, prob)


def train(docs: DataFrame, pieces: list[bytes], *, sample_docs: int = SAMPLE_DOCS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fit on about ``sample_docs`` whole documents a language, drawn by a hash of id and text.

    Equal rows count once. Of a language's drawn documents, in the order of the hash, those are
    taken that together have at most SAMPLE_BYTES; so a document longer than that teaches
    nothing. Rows with a null language or text teach nothing either. Without any row there is no
    language, and every prediction is ``und``.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("mark")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    samples: dict[str, Counter] = {x: Counter() for x in sizes}
    if sizes:
        cut = F.create_map(*[F.lit(v) for x, n in sizes.items() for v in (x, min(1 << 30, (sample_docs << 30) // n))])
        drawn = rows.where(F.pmod("mark", F.lit(1 << 30)) < cut[F.col("lang")])
        held: Counter = Counter()
        taken = []
        for r in sorted(drawn.groupBy("lang", "mark").agg(F.first(F.octet_length("text")).alias("size")).collect(), key=lambda r: r.mark):
            if held[r.lang] + r.size <= SAMPLE_BYTES:
                held[r.lang] += r.size
                taken.append(r.mark)
        for r in drawn.where(F.col("mark").isin(taken)).groupBy("lang", "mark").agg(F.first("text").alias("text")).collect() if taken else ():
            samples[r.lang].update(text_words(r.text))
    return fit(samples, pieces)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (posterior, 0 to 1), and the columns named in ``carry``.

    ``und`` with score 0 where the text is null or has no letter, or no language was
    learned; ties go to the language that is first in text order. Words and texts of any length
    are scored whole. Ids pass through, null
    or repeated; other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string").alias("__text")
    source = docs.select(F.col(id_col).alias("doc_id"), text, *[c for c in carry if c != text_col])
    place = {c: "__text" if c == text_col else c for c in ("doc_id", *carry)}  # the text goes through once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.claim("langid")
        scorer = model.scorer()
        for batch in batches:
            langs, scores = [], []
            for a in range(0, batch.num_rows, 1000):
                texts = batch.column("__text")[a : a + 1000].to_pylist()
                if model.langs:
                    like = scorer.score(texts)
                    best = like.argmax(1)
                    post = 1 / np.exp(like - like.max(1, keepdims=True)).sum(1)
                for i, t in enumerate(texts):
                    known = bool(model.langs) and has_letter(t)
                    langs.append(model.langs[best[i]] if known else UNDETERMINED)
                    scores.append(float(post[i]) if known else 0.0)
            kept = ["doc_id", *carry]
            yield pa.RecordBatch.from_arrays([*(batch.column(place[c]) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[place[c]]}" for c in ("doc_id", *carry)) + ", lang_pred string, score double")
