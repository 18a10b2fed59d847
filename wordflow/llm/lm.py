"""Trigram language-model scoring of a whole corpus with an Elias-Fano trie.

The model mixes counts, with c after b after a:

    P(c|a,b) = (n(a,b,c) + w(b) n(b,c) + BETA P(c)) / (n(a,b) + w(b) n(b) + BETA)

which sums to one over c, because every word has a follower (the end of a text
is a token). w(b) is RARE_WEIGHT, or HEAVY_WEIGHT / n(b) for words of more than
one in HEAVY tokens. P(c) discounts absolutely and leaves the rest to one class of unknown
words. Numerator and denominator need counts around one word each, so the log
probability of a text is a sum of parts that shards of words know by themselves.

1. Words are counted; the frequent ones come back. A word, pair or triple that would fill a
   good part of a shard is hot: one more scan counts the pairs of hot words, if there are hot
   words, and one the triples of hot pairs, if there are any.
2. Every document's n-grams go to the shard of the predicted word once; the shard builds its
   trie from the training n-grams and scores all documents' n-grams by it; partial sums go
   back to the documents' block, for the texts that have n-grams there.
A frequent word's n-grams are dealt by the word before too, a hot pair's by the word before
that; hot triples, whose counts all are known, are scored where they stand. So no n-gram
fills a shard. Equal texts of a block are sent once. The number of shards follows
the bytes of the table; a shard is scored in slices of its words.

Words are told apart by 64-bit hashes. The contexts of one word in one shard are told apart
by 32 bits: of m contexts about m * m / 2**33 collide (one in 8,600 of a million).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memos, storage, words
from .ngram_trie import Trie

#: A word of more than one in HEAVY tokens has a weight of its own. Words of more than one in
#: max(HEAVY, HOT * shards) tokens are dealt by pairs; pairs and triples of more than one in
#: HOT * shards are hot. Of each at most MOST_HEAVY can be.
HEAVY, HOT, MOST_HEAVY = 2000, 4, 200_000
HEAVY_WEIGHT, RARE_WEIGHT, BETA = 20.0, 0.05, 2.0
#: A block of documents: text bytes, and at most so many texts (their places are 16-bit numbers).
BLOCK_BYTES, BLOCK_TEXTS = 10 << 20, 60_000
#: Text bytes a shard is made for; its n-grams take about three times that.
SHARD_BYTES = 8 << 20
#: Entries of a shard that a task works on at once, at some 200 bytes each.
SLICE = 250_000

END = np.uint64(0x656E645F6F665F74)
START = np.uint32(0x73746172)

_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("part", pa.int8()), *[(x, pa.binary()) for x in "abcdefgh"]])
_DDL = "shard int, block long, part byte, " + ", ".join(f"{x} binary" for x in "abcdefgh")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(*r, *[None] * (len(_SCHEMA) - len(r))) for r in rows]
    cols = list(zip(*rows)) if rows else [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer() or b"", kind) for x in table.column(name)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(ids, training flags, texts), about BLOCK_BYTES at a time."""
    memos.claim("lm")
    ids, train, texts, held = [], [], [], 0
    for batch in batches:
        for d, t, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(d)
            train.append(bool(t))
            texts.append(text or "")
            held += len(texts[-1]) + 50
            if held >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                yield ids, train, texts
                ids, train, texts, held = [], [], [], 0
    if ids:
        yield ids, train, texts


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, texts in _blocks(batches):
            mine = [t for t, y in zip(texts, train) if y]
            if not mine:
                continue
            found, n = np.unique(words.text_hashes(mine)[0], return_counts=True)
            found, n = np.append(found, END), np.append(n, len(mine))
            to = (words.mix(found) % np.uint64(shards)).astype(np.int64)
            yield _batch([(s, 0, 0, found[to == s], n[to == s].astype("<u4")) for s in np.unique(to).tolist()])

    return run


def _sum_words(table: pa.Table) -> pa.Table:
    """Totals of a shard (a: tokens, distinct, once, twice), and its words by count (b, c), the MOST_HEAVY largest."""
    keys = np.concatenate(_column(table, "a", "<u8"))
    n = np.concatenate(_column(table, "b", "<u4"))
    order = np.argsort(keys)
    at = _runs(keys[order])
    keys, n = keys[order][at], np.add.reduceat(n[order].astype(np.int64), at)
    some = (n * MOST_HEAVY > n.sum()) | (keys == END)
    totals = np.array([n.sum(), len(n), (n == 1).sum(), (n == 2).sum()], "<i8")
    return pa.Table.from_batches([_batch([(0, 0, 0, totals, keys[some], n[some])])])


class Weights:
    """Everything of the model but the n-gram counts: totals, and frequent n-grams with their counts."""

    def __init__(self, totals: np.ndarray, heavy: np.ndarray, heavy_n: np.ndarray, texts: int):
        self.n, self.v, once, twice = (int(x) for x in totals)
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.heavy, self.heavy_n, self.texts, self.share = heavy, heavy_n, texts, HEAVY
        fp = (heavy >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(fp)
        fp, n = fp[order], heavy_n[order]
        at = _runs(fp)
        self.heavy_fp, self.heavy_fp_n = fp[at], np.maximum.reduceat(n, at) if len(at) else n
        self.pair, self.pair_n = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.triple, self.triple_score = np.empty(0, np.uint64), np.empty(0)

    def is_heavy(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.heavy, word)

    def unigram(self, n: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(n))
        return np.where(n > 0, n - self.discount, self.discount * self.v) / self.n

    def weight_of(self, fingerprint: np.ndarray) -> np.ndarray:
        """w(b): by the fingerprint alone, so that both sides of a fraction agree."""
        at, ok = _find(self.heavy_fp, fingerprint)
        out = np.full(len(fingerprint), RARE_WEIGHT)
        ok[ok] = self.heavy_fp_n[at[ok]] * self.share > self.n
        out[ok] = HEAVY_WEIGHT / self.heavy_fp_n[at[ok]]
        return out

    def parts(self, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of numerator over the denominator of what follows, for triples with all counts known."""
        single = BETA * self.unigram(n1)
        after = n2 + self.weight_of((word >> np.uint64(32)).astype(np.uint32)) * n1 + BETA
        full = n3 + self.weight_of(before) * n2 + single
        return np.log10(full) - np.where(word == END, 0, np.log10(after))

    def start_log(self) -> float:
        w = float(self.weight_of(np.array([START]))[0])
        return math.log10(self.texts + w * self.texts + BETA)


def _pair_key(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    return words.mix(c + b)


def _triple_key(c: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    return words.mix(_pair_key(c, b) + a)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Predicted words, words before them, words before those, and how many tokens each text has."""
    h, n = words.text_hashes(texts)
    sizes = n + 1
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(h) + len(n), bool)
    inner[last] = False
    c = np.full(len(inner), END)
    c[inner] = h
    b = np.empty(len(c), np.uint32)
    b[1:] = c[:-1] >> np.uint64(32)
    b[last - n] = START
    a = np.empty(len(c), np.uint32)
    a[1:] = b[:-1]
    a[last - n] = START
    return c, b, a, sizes


def _count_hot(parts: int, weights: Weights, hot: np.ndarray, order: int):
    """Training counts of pairs of hot words (order 2), or of triples of two hot pairs (3).

    a: keys, b: counts, and for triples c: predicted words, d: words before, e: words before those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, texts in _blocks(batches):
            mine = [t for t, y in zip(texts, train) if y]
            if not mine:
                continue
            c, b, a, _ = _grams(mine)
            some = _find(hot, c)[1]
            some[1:] &= some[:-1] | (b[1:] == START)  # the word before, unless the text starts
            if order == 3:
                pair = np.zeros(len(c), bool)
                pair[some] = _find(weights.pair, _pair_key(c[some], b[some]))[1]
                some = pair.copy()
                some[1:] &= pair[:-1] | (b[1:] == START)
            key = (_pair_key(c[some], b[some]) if order == 2 else _triple_key(c[some], b[some], a[some])).astype(np.uint64)
            found, at, n = np.unique(key, return_index=True, return_counts=True)
            to = (found % np.uint64(parts)).astype(np.int64)
            more = () if order == 2 else (c[some][at], b[some][at], a[some][at])
            yield _batch([(s, 0, 0, found[to == s], n[to == s].astype("<u4"), *(x[to == s] for x in more)) for s in np.unique(to).tolist()])

    return run


def _sum_frequent(least: int):
    """Keys of more than ``least`` occurrences in all."""

    def run(table: pa.Table) -> pa.Table:
        columns = [np.concatenate(_column(table, n, t)) for n, t in zip("abcde", ("<u8", "<u4", "<u8", "<u4", "<u4"))]
        order = np.argsort(columns[0])
        at = _runs(columns[0][order])
        n = np.add.reduceat(columns[1][order].astype(np.int64), at)
        first = order[at][n > least]
        more = [x[first] for x in columns[2:]] if len(columns[2]) else [None] * 3
        return pa.Table.from_batches([_batch([(0, 0, 0, columns[0][first], n[n > least], *more)])])

    return run


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _send(shards: int, weights: Weights):
    """Every block's n-grams, by shard, and a record of its documents.

    Part 0: a: predicted words, b: entries of each, c: words before, d: words before those,
    e: text, as a place in g, f: times in the text, g: texts that have entries here, h: training
    rows of each. Part 1: a: ids, b: null ids, c: training, d: text of each document, e: tokens
    of each text, f: number of records with scores to come back. Part 2: see ``_score_shard``.
    """

    place_of = storage.even_keys(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, train, texts in _blocks(batches):
            place: dict[str, int] = {}
            ref = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
            copies = np.bincount(ref, np.array(train, float), len(place)).astype(np.uint32)
            c, b, a, n_tokens = _grams(list(place))
            owner = np.repeat(np.arange(len(place), dtype=np.uint32), n_tokens)
            block = xxhash.xxh64_intdigest("\0".join(map(str, ids)) + "\1" + "\0".join(texts)) >> 1
            sent = 0
            key = _triple_key(c, b, a)
            at, known = _find(weights.triple, key)
            if known.any():  # every count is known: no shard is asked
                score, base = weights.triple_score[at[known]], weights.triple_base[at[known]]
                who, o = np.unique(owner[known], return_inverse=True)
                yield _batch([(int(place_of[block % shards]), block, 2, who.astype("<u2"), np.bincount(o).astype("<u4"), np.bincount(o, base), np.bincount(o, score))])
                sent += 1
                c, b, a, owner, key = c[~known], b[~known], a[~known], owner[~known], key[~known]
            # equal n-grams of a text become one entry
            key += owner
            order = np.argsort(key)
            at = _runs(key[order])
            times = np.diff(np.append(at, len(key))).astype("<u4")
            o = order[at]
            c, b, a, owner = c[o], b[o], a[o], owner[o]
            to, heavy = words.mix(c), np.flatnonzero(weights.is_heavy(c)[1])
            to[heavy] = pair = _pair_key(c[heavy], b[heavy])
            hot = _find(weights.pair, pair)[1]
            to[heavy[hot]] = words.mix(pair[hot] + a[heavy[hot]])
            to %= np.uint64(shards)
            bits = np.uint64(64 - max(1, shards - 1).bit_length())
            o = np.argsort(to << bits | c >> (np.uint64(64) - bits))
            c, b, a, owner, times, to = c[o], b[o], a[o], owner[o], times[o], to[o]
            edges = np.searchsorted(to, np.arange(shards + 1, dtype=np.uint64))
            for s in range(shards):
                x, y = int(edges[s]), int(edges[s + 1])
                if x == y:
                    continue
                cs = c[x:y]
                starts = _runs(cs)
                who, mine = np.unique(owner[x:y], return_inverse=True)
                yield _batch([(int(place_of[s]), block, 0, cs[starts], np.diff(np.append(starts, len(cs))).astype("<u4"), b[x:y], a[x:y], mine.astype("<u2"), times[x:y], who.astype("<u2"), copies[who])])
                sent += 1
            null = np.array([i is None for i in ids], np.uint8)
            yield _batch([(int(place_of[block % shards]), block, 1, np.array([i or 0 for i in ids], "<i8"), null, np.array(train, np.uint8), ref.astype("<u4"), n_tokens.astype("<u4"), np.array([sent], "<u4"))])

    return run


def _score_shard(weights: Weights):
    """Build the shard's trie from training n-grams and score all n-grams by it.

    Part 2, of each text with entries here: a: the text, b: known tokens, c: sums of
    log10(count + 0.5), d: sums of the model. A shard is worked on in slices of its words."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        out = table.filter(pa.array(part != 0)).to_batches()
        grams = np.flatnonzero(part == 0).tolist()
        if not grams:
            return pa.Table.from_batches(out, _SCHEMA)
        kinds = ("<u8", "<u4", "<u4", "<u4", "<u2", "<u4", "<u2", "<u4")
        records = [tuple(np.frombuffer(table.column(n)[i].as_buffer(), t) for n, t in zip("abcdefgh", kinds)) for i in grams]
        blocks = [table.column("block")[i].as_py() for i in grams]
        sums = [np.zeros((3, len(r[6]))) for r in records]
        slices = -(-sum(len(r[2]) for r in records) // SLICE)
        for i in range(slices):
            _score_slice(weights, records, sums, i * (1 << 64) // slices, (i + 1) * (1 << 64) // slices)
        rows = [(block % (1 << 31), block, 2, r[6], t[0].astype("<u4"), t[1], _narrow(t[2])) for block, r, t in zip(blocks, records, sums)]
        return pa.Table.from_batches([*out, _batch(rows)], _SCHEMA)

    return run


def _narrow(sums: np.ndarray) -> np.ndarray:
    """Single precision where that is off by less than 1e-5."""
    return sums.astype("<f4") if np.abs(sums).max(initial=0) < 128 else sums


def _score_slice(weights: Weights, records: list[tuple], sums: list[np.ndarray], low: int, high: int) -> None:
    """Add the known tokens and both scores of the words from ``low`` to below ``high`` to each record's texts."""
    cut = []
    for keys, reps, *_ in records:
        x, y = np.searchsorted(keys, np.uint64(low)), len(keys) if high >> 64 else np.searchsorted(keys, np.uint64(high))
        ends = np.concatenate([[0], np.cumsum(reps, dtype=np.int64)])
        cut.append((x, y, int(ends[x]), int(ends[y])))
    c = np.concatenate([np.repeat(r[0][x:y], r[1][x:y]) for r, (x, y, _, _) in zip(records, cut)])
    if not len(c):
        return
    b, a, text, times = (np.concatenate([r[k][p:q] for r, (_, _, p, q) in zip(records, cut)]) for k in (2, 3, 4, 5))
    train = np.concatenate([r[7][r[4][p:q]] * r[5][p:q].astype(np.float64) for r, (_, _, p, q) in zip(records, cut)])

    def level(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, index of each entry, training count of each key)."""
        order = np.argsort(key)
        s = key[order]
        at = _runs(s)
        back = np.empty(len(key), np.int64)
        back[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(s))))
        return s[at], back, np.add.reduceat(train[order], at)

    word, i1, n1 = level(c)
    at, heavy = weights.is_heavy(word)
    n1[heavy] = weights.heavy_n[at[heavy]]
    pair, i2, n2 = level(i1.astype(np.uint64) << np.uint64(32) | b)
    triple, i3, n3 = level(i2.astype(np.uint64) << np.uint64(32) | a)
    up2, b2 = (pair >> np.uint64(32)).astype(np.int64), pair.astype(np.uint32)
    at, heavy = _find(weights.pair, _pair_key(word[up2], b2))
    n2[heavy] = weights.pair_n[at[heavy]]
    up3, a3 = (triple >> np.uint64(32)).astype(np.int64), triple.astype(np.uint32)

    # weights of all trie nodes: numerators after backing off to each level, denominators of what follows
    single = BETA * weights.unigram(n1)
    own = weights.weight_of((word >> np.uint64(32)).astype(np.uint32))
    after1 = own * n1 + BETA
    double = weights.weight_of(b2) * n2 + single[up2]
    after2 = n2 + after1[up2]
    full = n3 + double[up3]
    k1, k2, k3 = n1 > 0, n2 > 0, n3 > 0
    new1, new2 = np.cumsum(k1) - 1, np.cumsum(k2) - 1
    trie = Trie.build(
        word[k1], [new1[up2[k2]], new2[up3[k3]]], [b2[k2], a3[k3]],
        [np.log10(single[k1]), np.log10(double[k2]), np.log10(full[k3])], [np.log10(after1[k1]), np.log10(after2[k2])],
    )

    # queries: every distinct n-gram, known or not
    r = trie.root(word)[up2]
    d = trie.child(1, r, b2)
    e = trie.child(2, d[up3], a3)
    num2 = np.full(len(pair), math.log10(BETA * float(weights.unigram(np.zeros(1))[0])))
    den2 = np.full(len(pair), math.log10(BETA))
    num2[r >= 0], den2[r >= 0] = trie.weight(0, r[r >= 0]), trie.next(0, r[r >= 0])
    num2[d >= 0], den2[d >= 0] = trie.weight(1, d[d >= 0]), trie.next(1, d[d >= 0])
    den2[word[up2] == END] = 0
    score3 = num2[up3]
    score3[e >= 0] = trie.weight(2, e[e >= 0])
    score3 -= den2[up3]

    base, known = np.log10(n1 + 0.5)[i1] * times, (n1 > 0)[i1] * times
    score = score3[i3] * times
    x = 0
    for total, (_, _, p, q) in zip(sums, cut):
        y = x + q - p
        for k, v in enumerate((known, base, score)):
            total[k] += np.bincount(text[x:y], v[x:y], total.shape[1])
        x = y


_OUT = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score_sum", pa.float64())])


def _gather(table: pa.Table) -> pa.Table:
    """Sum a block's partial scores and give them to its documents."""
    part = table.column("part").to_numpy()
    head = table.filter(pa.array(part == 1))
    table = table.filter(pa.array(part == 2))
    ids, null, train, ref, sizes, sent = (_column(head, n, t)[0] for n, t in zip("abcdef", ("<i8", "u1", "u1", "<u4", "<u4", "<u4")))
    if table.num_rows != int(sent[0]) * head.num_rows:
        raise RuntimeError("a block of documents lacks scores: the input changed between attempts")
    known, base, score = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes))
    scores = [np.frombuffer(z.as_buffer(), "<f4" if len(z.as_buffer()) == 2 * len(w.as_buffer()) else "<f8") for w, z in zip(table.column("a"), table.column("d"))]
    for who, k, x, y in zip(*(_column(table, n, kind) for n, kind in zip("abc", ("<u2", "<u4", "<f8"))), scores):
        known[who] += k
        base[who] += x
        score[who] += y
    if head.num_rows > 1:  # blocks that are equal to the last row share their sums
        known, base, score = known / head.num_rows, base / head.num_rows, score / head.num_rows
    one = [pa.array(ids, mask=null.astype(bool)), pa.array(train.astype(bool)), pa.array(sizes[ref].astype(np.int64)), pa.array(known[ref].astype(np.int64)), pa.array(base[ref]), pa.array(score[ref])]
    return pa.concat_tables([pa.Table.from_arrays(one, schema=_OUT)] * head.num_rows)


def _frequent(spark, counted: DataFrame, columns: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The records' columns end to end, sorted by the first."""
    rows = counted.select(*columns).collect()
    found = [np.concatenate([np.frombuffer(r[i] or b"", t) for r in rows] or [np.empty(0, t)]) for i, t in enumerate(kinds)]
    order = np.argsort(found[0])
    return [x[order] if len(x) else x for x in found]


def score(docs: DataFrame, train_when, *, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Train on the rows where ``train_when`` (a Column) holds, score all rows.

    Returns doc_id, training, n_tokens (words and the end), n_known, train_tokens,
    base_score (log10 of the add-half unigram model) and score (log10 of the trigram model).
    Words are runs without ASCII white space after A-Z are lower-cased. A null text is empty:
    the end alone. Texts of any length are scored whole; one text's n-grams must fit a worker,
    at about 100 bytes a word. A null ``train_when`` counts as false. Ids pass through, null or
    repeated; other columns are ignored; an empty table gives an empty result, and without
    training rows every token is unknown.
    """
    spark = docs.sparkSession
    parts = storage.shuffle_parts(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train_when, F.lit(False)).alias("training"), F.col(text_col).cast("string").alias("text"))
    size, texts = source.agg(F.sum(F.octet_length("text")), F.count_if("training")).first()
    shards = shards or max(1, -(-(size or 0) // shard_bytes))
    parts = max(parts, shards)
    counted = storage.checkpoint(source.mapInArrow(_count_words(parts), _DDL).repartition(parts, "shard").groupBy("shard").applyInArrow(_sum_words, _DDL))
    totals = np.zeros(4, np.int64)
    for r in counted.select("a").collect():
        totals += np.frombuffer(r.a, "<i8")
    least = int(totals[0]) // min(MOST_HEAVY, max(HEAVY, HOT * shards))
    hot_n = int(totals[0]) // min(MOST_HEAVY, HOT * shards)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(_column(batch, "b", "<u8"), _column(batch, "c", "<i8")):
                some = (n > least) | (k == END)
                yield pa.RecordBatch.from_arrays([pa.array(k[some].view(np.int64)), pa.array(n[some])], ["word", "n"])

    heavy = sorted((r.word % (1 << 64), r.n) for r in counted.mapInArrow(frequent, "word long, n long").collect())
    weights = Weights(totals, np.array([w for w, _ in heavy], np.uint64), np.array([n for _, n in heavy], np.int64), texts)

    hot = weights.heavy[weights.heavy_n > hot_n]

    def recount(order: int) -> DataFrame:
        return source.mapInArrow(_count_hot(parts, weights, hot, order), _DDL).groupBy("shard").applyInArrow(_sum_frequent(hot_n), _DDL)

    if len(hot):
        weights.pair, weights.pair_n = _frequent(spark, recount(2), "ab", ("<u8", "<i8"))
    if len(weights.pair):
        weights.triple, n3, word, before, _ = _frequent(spark, recount(3), "abcde", ("<u8", "<i8", "<u8", "<u4", "<u4"))
        n1, n2 = weights.heavy_n[weights.is_heavy(word)[0]], weights.pair_n[_find(weights.pair, _pair_key(word, before))[0]]
        weights.triple_score, weights.triple_base = weights.parts(n1, n2, n3, word, before), np.log10(n1 + 0.5)
    sent = source.mapInArrow(_send(shards, weights), _DDL).repartition(shards, "shard")
    scored = sent.groupBy("shard").applyInArrow(_score_shard(weights), _DDL)
    rows = scored.repartition(parts, "block").groupBy("block").applyInArrow(_gather, "doc_id long, training boolean, n_tokens long, n_known long, base_sum double, score_sum double")
    unit = math.log10(weights.n + 0.5 * (weights.v + 1))
    return rows.select(
        "doc_id", "training", "n_tokens", "n_known", F.lit(weights.n).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("score_sum") - F.lit(weights.start_log())).alias("score"),
    )
