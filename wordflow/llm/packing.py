"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two:
as many of ``max_len`` as fit, then the binary digits of the rest, longest
first. Pieces of equal length share a bucket, every piece is a sequence of its
own, so no sequence crosses documents and none needs padding.

The plan has no shuffle: tokenising and cutting run in the scan's tasks, and
``write_buckets`` lays the buckets out as partition folders without one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

END_ID = 1
MAX_LEN = 2048
MEMO_ENTRIES = 1_200_000

_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("bucket", pa.int32()),
]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def binary_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Descending powers of two that sum to ``n``, none above ``max_len``."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID, keep_ids: bool = False, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    bucket (log2 of length), sequence_id, offset, and ``ids`` if ``keep_ids``.

    A null or empty text is the end token alone: one piece of length 1. A null
    doc_id stays null. Rows that repeat a doc_id are packed each on its own.
    Any other column is ignored. An empty table gives no rows. ``sequence_id``
    is unique over the result; it numbers pieces by scan partition, so it is
    stable as long as the input's partitions are.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    spec = tokens.read_spec(tokenizer_path)
    end = int(end_id).to_bytes(4, "little")
    top = max_len

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder_for(spec, True, memo_entries)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            doc, start, length, crc, total, bucket = cols
            ids: list[np.ndarray] = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                buf = encoder.encode(text.as_py() or "") + end
                view, n, at = memoryview(buf), len(buf) // 4, 0
                for size in binary_lengths(n, top):
                    part = view[4 * at : 4 * (at + size)]
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    doc.append(d)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    bucket.append(size.bit_length() - 1)
                    at += size
            order = np.argsort(np.array(bucket, np.int8), kind="stable")  # equal lengths side by side
            out = [pa.array(c, t).take(pa.array(order)) for c, (_, t) in zip(cols, _FIELDS)]
            if keep_ids:
                out.append(pa.array([ids[i] for i in order], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [n for n, _ in _FIELDS] + ["ids"] * keep_ids)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = source.mapInArrow(cut, _DDL + ", ids array<int>" * keep_ids)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder a bucket, for readers that draw batches of one length."""
    pieces.write.partitionBy("bucket").parquet(path)
