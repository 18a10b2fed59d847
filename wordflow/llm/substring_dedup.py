"""Exact removal of long repeated word sequences by De Bruijn compaction.

The graph's edges are k-mers of words, the ones that a minimizer scheme picks:
every window of ``WINDOW`` words picks the smallest hash among its PICKS
k-mers, so equal windows pick equal edges, and neighbouring edges of a
document overlap.

1. The edges of all documents meet by hash. An edge that stands in two
   documents is repeated; it does not branch to a side if all its occurrences
   have the same neighbour at the same distance there.
2. A join brings this back to the documents. Paths of repeated, nonbranching
   edges compact: wherever one of their edges occurs, the whole path does. A
   window inside such a path occurs exactly where its picked edge does, so the
   edge's first document decides it.
3. Windows at branches are verified by themselves: their hashes meet with their
   source documents, and a second join brings the verdicts back.

Documents are dealt into blocks by hash once; both joins reuse that exchange.
Each block sends one entry per distinct edge or window, however often it
stands there, so a passage that a third of the documents share is no hot key.
Words and runs are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memos, storage, words

WINDOW = 50
K = 26
PICKS = WINDOW - K + 1
#: Text bytes a block aims at; a task holds one block with about 25 times that in arrays.
BLOCK_BYTES = 5 << 20

_NO_ID = np.iinfo(np.int64).max  # a null doc_id comes after all others
_NONE = np.uint64(2**64 - 1)


@dataclass
class Block:
    """All documents of a block as one array of word hashes."""

    order: np.ndarray  # rows in a fixed order
    tokens: list[list[bytes]]
    doc: np.ndarray  # id of each document
    first: np.ndarray  # where each document's words begin, and the end


def _open(table: pa.Table) -> Block:
    ids = [(_NO_ID if x is None else x) for x in table.column("doc_id").to_pylist()]
    texts = [(x or "").encode("utf-8") for x in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    tokens = [texts[i].split() for i in order]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return Block(np.array(order, np.int64), tokens, np.array([ids[i] for i in order], np.int64), np.concatenate([[0], np.cumsum(sizes)]))


class Graph:
    """Windows and picked edges of one block."""

    def __init__(self, block: Block, window: int, k: int):
        picks = window - k + 1
        hashes = np.concatenate([words.HASHER.array(t) for t in block.tokens] or [np.empty(0, np.uint64)])
        n = len(hashes)
        sizes = np.diff(block.first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        left = block.first[1:][owner] - np.arange(n) if n else np.empty(0, np.int64)  # words to the document's end
        self.starts = np.flatnonzero(left >= window)  # of windows
        self.ids = block.doc
        self.hashes = hashes
        if not len(self.starts):
            self.at = np.empty(0, np.int64)
            self.edge = np.empty(0, np.uint64)
            return
        kmer = words.run_hashes(hashes, k)
        kmer[kmer == _NONE] -= np.uint64(1)
        kmer[left[: len(kmer)] < k] = _NONE
        low = words.sliding(kmer, picks, np.minimum)  # smallest edge of the window at each place
        real = np.zeros(len(low), bool)
        real[self.starts] = True
        # an edge is picked if some real window around it has it as its smallest
        padded = np.concatenate([np.zeros(picks - 1, np.uint64), np.where(real, low, 0), np.zeros(picks - 1, np.uint64)])
        top = words.sliding(padded, picks, np.maximum)[: len(kmer)]
        self.at = np.flatnonzero(top == kmer[: len(top)])
        self.edge = kmer[self.at]
        self.owner = owner[self.at]
        # each window's picked edge: the first of equals at or after its start
        nearest = np.searchsorted(self.at, self.starts)
        want = low[self.starts]
        pick = nearest.copy()
        todo = np.arange(len(pick))
        while len(todo := todo[self.edge[pick[todo]] != want[todo]]):
            pick[todo] += 1
        self.pick = pick

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the spans to the previous and the next edge; 0 where a document's path ends."""
        to_next = np.zeros(len(self.at), np.uint64)
        to_prev = np.zeros(len(self.at), np.uint64)
        if len(self.at) > 1:
            same = self.owner[1:] == self.owner[:-1]
            gap = np.diff(self.at).astype(np.uint64)
            label = words.mix(words.mix(self.edge[:-1] + gap) + self.edge[1:])
            label[label == 0] = 1
            to_next[:-1] = np.where(same, label, 0)
            to_prev[1:] = np.where(same, label, 0)
        return to_prev, to_next

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.edge, return_inverse=True)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, group of each sorted entry) of equal keys."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _one(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value that all of a group share, else 0."""
    v = values[order]
    low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    return np.where(low == high, low, 0)


_RECORD = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("part", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
_RECORD_DDL = "shard int, block int, part byte, a binary, b binary, c binary, d binary, e binary"


def _records(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(_RECORD)
    return pa.Table.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], f.type) for c, f in zip(cols, _RECORD)], schema=_RECORD)


def _column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", kind) for x in table.column(name)]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int | None = None, keep_text: bool = False, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove every word that a window of ``window`` words covers whose words also start in a
    document with a smaller id. Windows are judged on the input.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a blank),
    with ``keep_text`` also ``kept_text`` (the text itself where nothing was removed), and
    the columns named in ``carry``. Words are runs without ASCII white space. A null text has
    none. A null id comes after all others and is never a smaller one; rows that share an id
    don't count as each other's source. Texts of any length are judged whole; one text must fit
    a worker, at about 25 times its bytes. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    k = k or max(1, (window + 2) // 2)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(storage.shuffle_parts(spark), -(-size // block_bytes))
    shards = storage.shuffle_parts(spark)
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        """One record a shard: distinct edges, least and largest document, labels of both sides."""
        memos.claim("words")
        graph = Graph(_open(table), window, k)
        if not len(graph.at):
            return _records([])
        order, starts, _ = _grouped(graph.edge)
        edge, ids = graph.edge[order][starts], graph.ids[graph.owner[order]]
        low, high = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
        prev, after = (_one(x, order, starts) for x in graph.neighbours())
        to = (edge % np.uint64(shards)).astype(np.int64)
        return _records([(s, key[0].as_py(), 0, *(x[to == s] for x in (edge, low, high, prev, after))) for s in np.unique(to).tolist()])

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        """Per block's edge, in its order: first document, and bits repeated, left and right unbranched."""
        parts = _column(table, "a", "<u8")
        low, high, prev, after = (np.concatenate(_column(table, n, t)) for n, t in (("b", "<i8"), ("c", "<i8"), ("d", "<u8"), ("e", "<u8")))
        order, starts, group = _grouped(np.concatenate(parts))
        first = np.minimum.reduceat(low[order], starts)
        repeated = first < np.maximum.reduceat(high[order], starts)
        bits = repeated.astype(np.uint8) | (_one(prev, order, starts) != 0).astype(np.uint8) << 1 | (_one(after, order, starts) != 0).astype(np.uint8) << 2
        back = np.empty(len(order), np.int64)
        back[order] = group
        rows, at = [], 0
        for block, part in zip(table.column("block").to_pylist(), parts):
            g = back[at : at + len(part)]
            at += len(part)
            seen = repeated[g]
            rows.append((key[0].as_py(), block, 0, np.where(seen, bits[g], 0).astype(np.uint8), first[g][seen], None, None, None))
        return _records(rows)

    def compact(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        """Decide windows inside compacted paths; send the others on."""
        block = key[0].as_py()
        graph = Graph(_open(table), window, k)
        if not len(graph.at):
            return _records([])
        edge, inverse = graph.distinct()
        to = (edge % np.uint64(shards)).astype(np.int64)
        bits, first = np.zeros(len(edge), np.uint8), np.full(len(edge), _NO_ID)
        for s, a, b in zip(found.column("shard").to_pylist(), _column(found, "a", "u1"), _column(found, "b", "<i8")):
            mine = np.flatnonzero(to == s)
            bits[mine] = a
            first[mine[a & 1 == 1]] = b
        bits, first = bits[inverse], first[inverse]
        index = np.arange(len(graph.at))
        from_ = graph.at[np.maximum.accumulate(np.where(bits & 2, 0, index))]
        last = len(index) - 1 - np.maximum.accumulate(np.where(bits[::-1] & 4, 0, index))[::-1]
        upto = graph.at[last] + k
        pick = graph.pick
        repeated = bits[pick] & 1 == 1
        inside = (from_[pick] <= graph.starts) & (upto[pick] >= graph.starts + window)
        mine = graph.ids[graph.owner[pick]]
        gone = graph.starts[repeated & inside & (first[pick] < mine)]
        rows = [(block % shards, block, 1, gone.astype("<u4"), None, None, None, None)] if len(gone) else []
        open_ = np.flatnonzero(repeated & ~inside)
        if len(open_):
            at = graph.starts[open_]
            runs = words.run_hashes(graph.hashes, window)[at]
            to = (runs % np.uint64(shards)).astype(np.int64)
            for s in np.unique(to).tolist():
                some = np.flatnonzero(to == s)
                some = some[np.argsort(runs[some], kind="stable")]
                run, start = np.unique(runs[some], return_index=True)
                ids = mine[open_[some]]
                least = np.minimum.reduceat(ids, start)
                # a: distinct windows, b: least document, c: entries of each, d: place and e: document of each entry
                rows.append((s, block, 2, run, least, np.diff(np.append(start, len(some))).astype("<u4"), at[some].astype("<u4"), ids))
        return _records(rows)

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        """Windows whose words also start in a document with a smaller id, by place."""
        kind = table.column("part").to_numpy()
        known = table.filter(pa.array(kind == 1))  # decided before, on the way back to their block
        rows = [(key[0].as_py(), block.as_py(), 1, gone.as_py(), None, None, None, None) for block, gone in zip(known.column("block"), known.column("a"))]
        table = table.filter(pa.array(kind == 2))
        if table.num_rows:
            parts, blocks_ = _column(table, "a", "<u8"), table.column("block").to_pylist()
            least, counts, place, ids = (_column(table, n, t) for n, t in (("b", "<i8"), ("c", "<u4"), ("d", "<u4"), ("e", "<i8")))
            order, starts, group = _grouped(np.concatenate(parts))
            first = np.minimum.reduceat(np.concatenate(least)[order], starts)
            back = np.empty(len(order), np.int64)
            back[order] = group
            at = 0
            for i in range(len(parts)):
                mine = first[back[at : at + len(parts[i])]]
                at += len(parts[i])
                gone = place[i][np.repeat(mine, counts[i]) < ids[i]]
                if len(gone):
                    rows.append((key[0].as_py(), blocks_[i], 1, gone, None, None, None, None))
        return _records(rows)

    kinds = dict(source.dtypes)
    ddl = ["doc_id long", "n_words long", "n_removed long", "kept_sha256 string"] + ["kept_text string"] * keep_text + [f"carry_{i} {kinds[f'carry_{i}']}" for i in range(len(carry))]

    def cut(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        """Drop the covered words of each document."""
        block = _open(table)
        total = int(block.first[-1])
        edge = np.zeros(total + 1, np.int64)
        for part in _column(found, "a", "<u4"):
            np.add.at(edge, part, 1)
            np.add.at(edge, part.astype(np.int64) + window, -1)
        gone = np.cumsum(edge)[:total] > 0
        texts = table.column("text")
        n_removed, sha, kept_text = [], [], []
        for row, tokens, a, b in zip(block.order.tolist(), block.tokens, block.first[:-1].tolist(), block.first[1:].tolist()):
            mask = gone[a:b]
            lost = int(mask.sum())
            left = [t for t, g in zip(tokens, mask.tolist()) if not g] if lost else tokens
            data = b" ".join(left)
            n_removed.append(lost)
            sha.append(hashlib.sha256(data).hexdigest())
            if keep_text:
                kept_text.append(data.decode("utf-8") if lost else texts[row].as_py())
        rows = pa.array(block.order)
        out = [table.column("doc_id").take(rows), pa.array(np.diff(block.first)), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        if keep_text:
            out.append(pa.array(kept_text, pa.string()))
        out += [table.column(f"carry_{i}").take(rows) for i in range(len(carry))]
        return pa.Table.from_arrays(out, [d.split(" ")[0] for d in ddl])

    def back(records: DataFrame):
        return records.repartition(blocks, "block").groupBy("block")

    edges = dealt.groupBy("block").applyInArrow(send, _RECORD_DDL)
    judged = edges.groupBy("shard").applyInArrow(judge, _RECORD_DDL)
    asked = dealt.groupBy("block").cogroup(back(judged)).applyInArrow(compact, _RECORD_DDL)
    verdicts = asked.groupBy("shard").applyInArrow(verify, _RECORD_DDL)
    out = dealt.groupBy("block").cogroup(back(verdicts)).applyInArrow(cut, ", ".join(ddl))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text, *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
