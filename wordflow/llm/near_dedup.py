"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

1. A document's set of word shingles is hashed once; its SKETCH smallest hashes
   are its sketch (all of it, for small sets). Equal sets become one node, so
   groups of exact copies have gone before anything is compared.
2. Inverted lists of retained values: the values meet by hash and their
   frequencies come back. Two sets at the threshold share at least half of a
   sketch (theta * n values of small, whole sets), so they share one of the
   rarest values of each, and only that prefix is listed. Boilerplate that
   many documents share is frequent and stays out of the prefixes.
3. Nodes that share a listed value are compared by the estimate of their union
   sketch: of the SKETCH smallest values of both, the share that both hold. Only
   pairs that reach ESTIMATE join a family, so a shared value alone joins nothing.
   Lists of more than CHUNK nodes are compared in pairs of chunks.
4. Families are compared in pairs of bounded chunks, each a task of its own:
   sketch overlaps from inverted lists as a filter, exact Jaccard on the full
   sets. A chunk pair gives at most a spanning forest of its links, never all pairs.
5. Components of the links, named by their smallest document.

Shingles are told apart by 64-bit hashes, in estimates by 32 bits, which can only
raise them. A link at the threshold (80 %) is lost if fewer than 32 of the 64 smallest
values of a union are shared: binomially 2e-8, less for closer texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memos, storage, words
from .components import components
from .skew import join_keyed

SHINGLE = 5
SIMILARITY = 80  # percent
SKETCH = 64
#: A pair goes on to the exact test if its estimate reaches this share.
ESTIMATE = 0.5
CHUNK = 1200  # nodes of a family a side of a task
CELLS = 24 << 20  # of a dense block

#: Nodes a block; lists of at most so many nodes are compared pair by pair, longer ones by matrices.
BLOCK_NODES, SHORT = 100_000, 32
_PAD = np.uint32(2**32 - 1)

_REC = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *[(x, pa.binary()) for x in "abcde"]])
_REC_DDL = "shard int, block int, " + ", ".join(f"{x} binary" for x in "abcde")
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return words.shingle_hashes(words.HASHER.array((text or "").encode("utf-8").lower().split()), size)


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def least_overlap(n: int, sketch: int, percent: int) -> int:
    """How many sketch values a set of ``n`` shares with any set that it links to."""
    return -(-percent * n // 100) if 100 * n <= percent * sketch else sketch // 2


def _records(rows: list[tuple]) -> pa.Table:
    rows = [(*r, *[None] * (len(_REC) - len(r))) for r in rows]
    cols = list(zip(*rows)) if rows else [[]] * len(_REC)
    return pa.Table.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], f.type) for c, f in zip(cols, _REC)], schema=_REC)


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root) of everything that the pairs join."""
    parent: dict[int, int] = {}
    for a, b in pairs:
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := _find(parent, x)) != x]


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by inverted lists of what both sides hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    if not len(shared):
        return out
    lr, rr = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])

    def placed(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        ok = shared[at] == v
        return at[ok], r[ok]

    (lc, lr), (rc, rr) = placed(lv, lr), placed(rv, rr)
    width = max(1, CELLS // (len(left) + len(right)))
    for x in range(0, len(shared), width):
        m = min(width, len(shared) - x)
        a, b = np.zeros((len(left), m), np.float32), np.zeros((len(right), m), np.float32)
        some = (lc >= x) & (lc < x + m)
        a[lr[some], lc[some] - x] = 1
        some = (rc >= x) & (rc < x + m)
        b[rr[some], rc[some] - x] = 1
        out += a @ b.T
    return out


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of each pair's union sketch that both hold; rows are sketches of 32-bit values, padded at the end."""
    width = left.shape[1]
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)  # the second of two equal values
    place = np.arange(1, 2 * width) - np.cumsum(again, axis=1)  # among the union's different values
    shared = (again & (place < width)).sum(1)
    union = (both != _PAD).sum(1) - again.sum(1)
    return shared / np.maximum(np.minimum(union, width), 1)


class _Families:
    """Union-find over the nodes of a shard, joined by what their sketches say."""

    def __init__(self, size: np.ndarray, sketches: np.ndarray, percent: int):
        self.size, self.sketches, self.percent = size, sketches, percent
        self.parent = np.arange(len(size))

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def join(self, x: np.ndarray, y: np.ndarray, step: int = 50_000) -> None:
        """Join those of the pairs whose sizes and estimate allow a link."""
        n, m = self.size[x], self.size[y]
        near = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        x, y = x[near], y[near]
        for i in range(0, len(x), step):
            ok = estimates(self.sketches[x[i : i + step]], self.sketches[y[i : i + step]]) >= ESTIMATE
            for a, b in zip(x[i : i + step][ok].tolist(), y[i : i + step][ok].tolist()):
                a, b = self.find(a), self.find(b)
                self.parent[max(a, b)] = min(a, b)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def long_list(self, nodes: np.ndarray) -> None:
        """All pairs of a long list that no earlier pair has joined: one leader first, then the rest by matrices."""
        root = self.roots()[nodes]
        free = nodes[root != root[0]]
        self.join(np.full(len(free), nodes[0]), free)
        root = self.roots()[nodes]
        found, back, n = np.unique(root, return_inverse=True, return_counts=True)
        if len(found) == 1:
            return
        rest = nodes[back != n.argmax()]  # each pair across components has an end outside the largest
        values = [s[s != _PAD] for s in self.sketches[nodes]]
        place = np.flatnonzero(back != n.argmax())
        for i in range(0, len(rest), 256):
            shared = overlaps([values[j] for j in place[i : i + 256]], values)
            x, y = np.nonzero(shared >= ESTIMATE * np.minimum(self.sketches.shape[1], np.maximum(self.size[rest[i : i + 256]][:, None], self.size[nodes][None, :])))
            x, y = rest[i : i + 256][x], nodes[y]
            root = self.roots()
            other = root[x] != root[y]
            self.join(x[other], y[other])


def sketch_families(key: np.ndarray, owner: np.ndarray, size: np.ndarray, sketches: np.ndarray, percent: int = SIMILARITY) -> np.ndarray:
    """Root of each node: nodes that share a key join if their sizes and union sketches allow a link."""
    found = _Families(size, sketches, percent)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(key)))
    short = np.repeat(length <= SHORT, length)
    for lag in range(1, min(SHORT, int(length.max(initial=1)))):
        x, y = owner[:-lag], owner[lag:]
        same = (key[lag:] == key[:-lag]) & short[lag:] & (x != y)
        x, y = x[same], y[same]
        root = found.roots()
        apart = root[x] != root[y]
        pair = np.unique(x[apart].astype(np.int64) * len(size) + y[apart])
        found.join(pair // len(size), pair % len(size))
    for i in np.flatnonzero(length > SHORT).tolist():
        found.long_list(np.unique(owner[start[i] : start[i] + length[i]]))
    return found.roots()


def link_chunks(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, sketch: int = SKETCH, percent: int = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning forest of the links between two chunks (``side`` 0 and 1), or within one."""
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    size = np.array([len(s) for s in sets], np.int64)
    a, b = [sets[i][:sketch] for i in left], [sets[i][:sketch] for i in right]
    n, m = size[left][:, None], size[right][None, :]
    near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    if same:
        near &= left[:, None] < right[None, :]
    # Of the union's `sketch` smallest, at least overlap - (values beyond them) are shared;
    # overlap / sketch bounds the estimate from above, so nothing at the filter is lost.
    bound = overlaps(a, b) / np.minimum(sketch, np.maximum(n, m))
    at, to = np.nonzero(near & (bound >= ESTIMATE))
    if not len(at):
        return []
    if len(at) < 4 * (len(left) + len(right)):
        common = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in zip(at.tolist(), to.tolist())])
    else:
        rows, cols = np.unique(at), np.unique(to)
        full = overlaps([sets[left[i]] for i in rows], [sets[right[j]] for j in cols])
        common = full[np.searchsorted(rows, at), np.searchsorted(cols, to)].astype(np.int64)
    union = size[left[at]] + size[right[to]] - common
    ok = 100 * common >= percent * union
    return _forest(zip(nodes[left[at[ok]]].tolist(), nodes[right[to[ok]]].tolist()))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns stay.

    The row with the smallest id stays (null last), of repeated ids the one with the smallest
    hash of its text. Rows are told by id and text; of rows that share both, one stays.
    """
    judged = storage.written(near_duplicates(docs, id_col=id_col, text_col=text_col, mark=True, **how), "near-dedup")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    # several rows of a group are marked kept where they share the smallest id, or all have none
    several = judged.where("kept and root is not null").groupBy("root").agg(F.min(row).alias("one"), F.max(row).alias("other")).where("one <> other").select(F.col("root").alias("r_"), "one")
    losers = judged.where("kept").join(several, F.col("root") == F.col("r_")).where(row != F.col("one"))
    gone = judged.where("not kept").select("doc_id", "mark").union(losers.select("doc_id", "mark")).toDF("__id", "__mark").distinct()
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark")), "left_anti")
    repeated = judged.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return left.dropDuplicates([id_col, text_col]) if repeated else left


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY, sketch: int = SKETCH, chunk: int = CHUNK, mark: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows link if 100 * intersection >= percent * union of their shingle sets (A-Z lower-cased;
    all words as one shingle where there are fewer than ``shingle``). component_id is the
    smallest id reachable; kept holds where it is the row's own. ``mark`` adds a hash of the text
    and the group's root, which is null where a row has no equal or near set. A null or wordless text has
    an empty set and links with nothing. A null id never names a component that has another;
    rows that share an id are judged each on its own. Texts of any length are taken whole; one
    text's shingles must fit a worker, at some 40 bytes a word. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("mark"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.claim("words")
        for batch in batches:
            n, node, low = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), shingle)
                n.append(len(found))
                node.append(node_of(found) if len(found) else None)
                low.append(found[:sketch].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.binary())], ["doc_id", "mark", "n_shingles", "node", "sketch"])

    rows = storage.written(source.mapInArrow(sketches, "doc_id long, mark long, n_shingles long, node long, sketch binary"), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))

    total = rows.count()
    shards = blocks = max(storage.shuffle_parts(spark), -(-total // BLOCK_NODES))
    dealt = nodes.select("node", "n", "sketch", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")

    def values(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Nodes in order, their sketch values end to end, and how many each has."""
        order = np.argsort(table.column("node").to_numpy())
        table = table.take(pa.array(order))
        parts = [np.frombuffer(x.as_py(), "<u8") for x in table.column("sketch")]
        return table.column("node").to_numpy(), np.concatenate(parts), [len(p) for p in parts]

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, v, _ = values(table)
        v = np.unique(v, return_counts=True)
        to = (words.mix(v[0]) % np.uint64(shards)).astype(np.int64)
        return _records([(s, key[0].as_py(), v[0][to == s], v[1][to == s].astype("<u4")) for s in np.unique(to).tolist()])

    def count(table: pa.Table) -> pa.Table:
        """Frequencies of each block's values, in its order."""
        parts = [np.frombuffer(x.as_py(), "<u8") for x in table.column("a")]
        n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("b")])
        _, back = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(back, n)[back].astype("<u4")
        out, at = [], 0
        for block, shard, part in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), parts):
            out.append((shard, block, n[at : at + len(part)], None))
            at += len(part)
        return _records(out)

    def prefixes(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        """List every node under those of its rarest values that it may share.

        a: keys of lists, b: their nodes, as places in c; c: nodes, d: sizes of their sets, e: sketches."""
        key_of_block = key[0]
        if not table.num_rows:
            return _records([])
        node, v, lengths = values(table)
        n = table.take(pa.array(np.argsort(table.column("node").to_numpy()))).column("n").to_numpy()
        some, back = np.unique(v, return_inverse=True)
        freq = np.zeros(len(some), np.uint32)
        to = (words.mix(some) % np.uint64(shards)).astype(np.int64)
        for s, x in zip(found.column("shard").to_pylist(), found.column("a")):
            freq[to == s] = np.frombuffer(x.as_py(), "<u4")
        f = freq[back]
        owner = np.repeat(np.arange(len(node)), lengths)
        order = np.lexsort((v, f, owner))
        rank = np.arange(len(v)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = np.array([m - least_overlap(int(x), sketch, percent) + 1 for m, x in zip(lengths, n)])
        order = order[(rank < keep[owner]) & (f[order] > 1)]
        narrow = np.full((len(node), sketch), _PAD, np.uint32)
        narrow[owner, np.arange(len(v)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.minimum(v >> np.uint64(32), _PAD - 1)
        # a value of many nodes has a list for each pair of chunks of them
        v, f, who = v[order], f[order], owner[order]
        chunks = -(-f.astype(np.int64) // chunk)
        own = (words.mix(node.view(np.uint64)[who] + np.uint64(9)) % chunks.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(v)), chunks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
        key, who = words.mix(v[at] + words.mix((low * chunk + high).astype(np.uint64))), who[at]
        to = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, who, to = key[order], who[order], to[order]
        edges = np.searchsorted(to, np.arange(shards + 1))
        out = []
        for s in np.unique(to).tolist():
            x, y = int(edges[s]), int(edges[s + 1])
            some, mine = np.unique(who[x:y], return_inverse=True)
            out.append((s, key_of_block.as_py(), key[x:y], mine.astype("<u4"), node[some], n[some].astype("<i8"), narrow[some]))
        return _records(out)

    def families(table: pa.Table) -> pa.Table:
        """Spanning forest of nodes whose union sketches allow a link."""
        columns = [[np.frombuffer(x.as_py(), t) for x in table.column(c)] for c, t in zip("abcde", ("<u8", "<u4", "<i8", "<i8", "<u4"))]
        before = np.cumsum([0, *map(len, columns[2])])
        owner = np.concatenate([o + b for o, b in zip(columns[1], before[:-1])])
        node, size, narrow = np.concatenate(columns[2]), np.concatenate(columns[3]), np.concatenate(columns[4]).reshape(-1, sketch)
        root = sketch_families(np.concatenate(columns[0]), owner.astype(np.int64), size, narrow, percent)
        some = np.flatnonzero(root != np.arange(len(root)))
        return _edges(list(zip(node[some].tolist(), node[root[some]].tolist())))

    back = dealt.groupBy("block").applyInArrow(send, _REC_DDL).groupBy("shard").applyInArrow(count, _REC_DDL)
    listed = dealt.groupBy("block").cogroup(back.repartition(blocks, "block").groupBy("block")).applyInArrow(prefixes, _REC_DDL)
    member = storage.checkpoint(components(listed.groupBy("shard").applyInArrow(families, "a long, b long")))

    parts = member.groupBy("root").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"), F.count("*").alias("size"))
    placed = join_keyed(member, parts, "root", "size", total).select("node", "root", "chunks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int").alias("own"))
    sought = placed.join(nodes.select("node", "first_id"), "node").select(F.col("node").alias("sought"), F.col("first_id").alias("id"), "root", "chunks", "own")
    texts = source.drop("mark").join(sought.select("id").distinct(), source.doc_id.eqNullSafe(F.col("id")), "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            found = [s for s in found if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    sets = texts.mapInArrow(full, "node long, shingles binary").join(sought, F.col("node") == F.col("sought"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tasks = sets.select("node", "shingles", "root", "chunks", "own", other).select(
        "node", "shingles", "root", (F.col("chunks") > 1).alias("multi"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"),
    )

    def link(table: pa.Table) -> pa.Table:
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)  # rows that share id and text
        table = table.take(pa.array(at))
        found = _edges(link_chunks(node, [np.frombuffer(x.as_py(), "<u8") for x in table.column("shingles")], table.column("side").to_numpy(), table.column("x")[0] == table.column("y")[0], sketch, percent))
        return found.append_column("multi", pa.array([table.column("multi")[0].as_py()] * found.num_rows, pa.bool_()))

    # a family of one chunk has its components already; those of several are joined
    edges = storage.checkpoint(tasks.groupBy("root", "x", "y").applyInArrow(link, "a long, b long, multi boolean"))
    whole = edges.where("not multi").select(F.col("a").alias("node"), F.col("b").alias("root"))
    linked = components(edges.where("multi").select("a", "b")).unionByName(whole.union(whole.select("root", "root").distinct()))
    named = nodes.select("node", "first_id", "copies").join(linked.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").where("copies > 1 or root is not null")
    least = named.where("root is not null").groupBy(F.col("root").alias("r_")).agg(F.min("first_id").alias("least"))
    named = named.join(least, F.col("root") == F.col("r_"), "left").select("node", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("least", "first_id").alias("named"))
    out = join_keyed(rows.select("doc_id", "mark", "n_shingles", "node"), named, "node", "copies", total, "left")
    group = F.coalesce("named", "doc_id")
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"), *["mark", "root"] * mark)
