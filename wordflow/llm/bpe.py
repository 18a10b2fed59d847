"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes falls on a fixed pattern,
so equal passages of different documents fall into equal chunks however they
are shifted. A chunk's inside is encoded once and reused by every later
document of the worker that holds the same chunk. Cuts ignore token borders;
the join of two chunks is repaired by re-encoding the text around it, growing
to both sides until it ends in blanks, where the vocabulary never has a token
across and both sides' ids are sure to agree.

Reuse is scoped to a worker process with a byte-bounded cache: sharing
encoded chunks over the whole cluster would shuffle several times the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memos, tokens

WINDOW = 8
CHUNK_BITS = 9  # about 512 bytes a chunk
CACHE_BYTES = 80 << 20
_POWERS = np.array([pow(0x9E3779B1, k, 1 << 32) for k in range(WINDOW)], np.uint32)


def cut_points(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Content-defined cuts of UTF-8 bytes, never inside a character."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= 1 << bits:
        return [0, len(data)]
    h = raw[WINDOW - 1 :] * _POWERS[0]
    for k in range(1, WINDOW):
        h += raw[WINDOW - 1 - k : len(raw) - k] * _POWERS[k]
    h *= np.uint32(0x85EBCA6B)
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + WINDOW
    cuts = [0]
    for i in at.tolist():
        while i < len(data) and data[i] & 0xC0 == 0x80:
            i += 1
        if cuts[-1] < i < len(data):
            cuts.append(i)
    return [*cuts, len(data)]


class ChunkEncoder:
    """Ids and decoded text of whole texts, chunk by chunk."""

    def __init__(self, spec: str):
        self.words = tokens.SegmentEncoder(spec, False)
        vocab = self.words.tokenizer.get_vocab(with_added_tokens=True)
        self.table = np.empty(max(vocab.values(), default=-1) + 1, object)
        self.table[:] = ""
        for token, i in vocab.items():
            self.table[i] = token
        self.cache: dict[bytes, tuple[str, bytes, str] | str] = {}
        self.held = 0

    def decode(self, ids: bytes) -> str:
        """The vocabularies in use have no decoder: tokens joined by blanks."""
        return " ".join(self.table[np.frombuffer(ids, "<u4")].tolist())

    def _chunk(self, data: bytes) -> tuple[str, bytes, str] | str:
        """(text before the first blank, ids of what lies between, text after the last blank);
        the text itself where there is no blank."""
        hit = self.cache.get(data)
        if hit is None:
            words = data.decode().split(" ")
            hit = (words[0], b"".join(self.words.lookup(words[1:-1])), words[-1]) if len(words) > 1 else words[0]
            size = 200 + 2 * len(data) + (len(hit[1]) if len(words) > 1 else 0)
            if size < CACHE_BYTES // 64:
                if self.held + size > CACHE_BYTES:
                    self.cache.clear()
                    self.held = 0
                self.cache[data] = hit
                self.held += size
        return hit

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32."""
        data = text.encode("utf-8")
        cuts = cut_points(data)
        parts: list[bytes] = []
        around = ""  # the text around the join at hand, back to the last blank
        for a, b in zip(cuts, cuts[1:]):
            hit = self._chunk(data[a:b])
            if isinstance(hit, str):  # no blank yet: the join's window grows over the next chunk
                around += hit
                continue
            parts += self.words.lookup([around + hit[0]])
            parts.append(hit[1])
            around = hit[2]
        parts += self.words.lookup([around])
        return b"".join(parts)


_loaded: dict[int, ChunkEncoder] = {}
memos.register("bpe", _loaded.clear)


def _encoder(spec: str) -> ChunkEncoder:
    memos.claim("bpe")
    if hash(spec) not in _loaded:
        _loaded.clear()
        _loaded[hash(spec)] = ChunkEncoder(spec)
    return _loaded[hash(spec)]


def encode_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    on request ``ids`` (array<int>) and ``decoded``.

    The vocabulary must drop white space in pre-tokenising (word-end BPE). Ids equal the
    library's with add_special_tokens=False, decoded text its decode() with
    skip_special_tokens=False. Null text counts as empty: no tokens. Null and repeated
    doc_ids pass through row by row; other columns are ignored; an empty table gives none.
    """
    spec = tokens.read_spec(tokenizer_path)
    extra = ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for text in batch.column(1):
                got = encoder.encode(text.as_py() or "")
                said = encoder.decode(got)
                n.append(len(got) // 4)
                ids_sha.append(sha(got).hexdigest())
                text_sha.append(sha(said.encode("utf-8")).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(got, "<i4"))
                if keep_text:
                    decoded.append(said)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                out.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def decode_ids(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the text of each row's ids; null ids give an empty text."""
    spec = tokens.read_spec(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            said = [encoder.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "decoded"])

    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, decoded string")
