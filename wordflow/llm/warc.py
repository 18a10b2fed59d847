"""Dictionary-compressed WARC archives (.warc.zst).

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the
Zstandard dictionary, then every record as a frame of its own, compressed with
that dictionary. Between records stands an empty skippable frame, which
decoders pass over; its eight bytes are also the row separator of Spark's text
writer, so the archives are written by Spark itself, to any store that it can
write, with its commit protocol (a lost executor's files are never half seen).

Records: ``response`` holds an HTTP response with the payload; a payload of at
least ``min_revisit_bytes`` that several pages share is stored once, with the
largest page_id, and the others are ``revisit`` records that refer to it and
hold HTTP headers only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import skew, storage

DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame: magic 0x184D2A50 and length 0, little-endian.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
LEVEL = 3
MIN_REVISIT_BYTES = 1000
#: The dictionary is trained on a hash sample of about SAMPLE_RECORDS records,
#: SAMPLE_BYTES of each: it shapes the compression, never the content.
SAMPLE_RECORDS = 1024
SAMPLE_BYTES = 16 << 10
DICT_BYTES = 64 << 10
#: Payload bytes that an archive is made for.
ARCHIVE_BYTES = 256 << 20

_CRLF = b"\r\n"
_PAGE, _NO_PAGE = 0x7AB1_C0DE_0000_8000, 0x7AB1_C0DE_0000_8001


def record_id(page_id: int | None) -> str:
    """A custom (version 8) UUID that carries the page's id."""
    high, low = (_NO_PAGE, 0) if page_id is None else (_PAGE, page_id & (2**64 - 1))
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(rid: str) -> int | None:
    value = uuid.UUID(rid[len("<urn:uuid:") : -1]).int
    low = value & (2**64 - 1)
    return None if value >> 64 == _NO_PAGE else low - (1 << 64) * (low >> 63)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """One WARC record; ``refers_to``: the response's page in a 1-tuple, for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(url.splitlines()))
    if refers_to:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to[0])}")
    return "\r\n".join(head).encode("utf-8") + _CRLF * 2 + block + _CRLF * 2


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload bytes, SHA-1 hex, type, page referred to, payload or None)."""
    head, _, rest = data.partition(_CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(_CRLF * 2)
    size = int(dict(x.split(b": ", 1) for x in http.split(_CRLF)[1:])[b"Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, page = fields["WARC-Type"], page_of(fields["WARC-Record-ID"])
    if kind == "revisit":
        return page, size, digest, kind, page_of(fields["WARC-Refers-To"]), None
    if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"record of page {page}: payload and digest differ")
    return page, size, digest, kind, None, body


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; raw content where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or build_record(0, "http://example.com/", b"", None)


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one at a time."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError("no leading dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    view, at, step = memoryview(archive), 8 + size, 16 << 10
    while at < len(view):
        magic, size = struct.unpack_from("<II", archive, at)
        if magic >> 4 == 0x184D2A5:
            at += 8 + size
            continue
        one, out = unpacker.decompressobj(), []
        while not one.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("truncated record")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, parts: int | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of ``pages`` to archives ``part-*`` under ``path``.

    Null html is an empty payload, a null URL leaves its header out. A null page_id is
    below every other. Rows that repeat the largest page_id of a payload are all responses.
    Payloads of any length are written whole; one record must fit a worker. Other columns are
    ignored; an empty table gives archives without records or none.

    Equal payloads meet by digest in a partial aggregate, which carries no payloads. Pages below
    ``min_revisit_bytes`` and those of hot digests (of which there are few, so they are broadcast)
    are written where they are read; only the others move, to meet their digest's response.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("body"))
    wanted = rows.withColumn("sha", F.when(F.length("body") >= min_revisit_bytes, F.unhex(F.sha1("body"))))
    groups = wanted.where("sha is not null").groupBy("sha").agg(F.max("page").alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("shared"), "kept", "n")
    total, size = rows.agg(F.count("*"), F.sum(F.length("body"))).first()
    mark = F.xxhash64("page", "url", F.xxhash64("body"))
    drawn = rows if total <= SAMPLE_RECORDS else rows.where(F.pmod(mark, F.lit(1 << 30)) < (SAMPLE_RECORDS << 30) // total)
    picked = drawn.groupBy(mark.alias("mark")).agg(F.first("page").alias("page"), F.first("url").alias("url"), F.first(F.substring("body", 1, SAMPLE_BYTES)).alias("body")).orderBy("mark").collect()
    dictionary = train_dictionary([build_record(r.page, r.url, bytes(r.body), None) for r in picked])
    lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        first = [lead]
        for batch in batches:
            out = first
            for page, url, body, kept, grouped in zip(*(c for c in batch.columns)):
                page, kept = page.as_py(), kept.as_py()
                refers = (kept,) if grouped.as_py() and kept is not None and page != kept else None
                out.append(packer.compress(build_record(page, url.as_py(), body.as_py(), refers)))
            first = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    columns = ("page", "url", "body", "kept", F.col("shared").isNotNull().alias("grouped"))
    limit = max(skew.LEAST, total // skew.SHARE)
    marked = wanted.join(F.broadcast(groups.where(F.col("n") > limit).drop("n")), F.col("sha") == F.col("shared"), "left")
    still = marked.where("sha is null or shared is not null").select(*columns)
    moving = marked.where("sha is not null and shared is null").drop("kept", "shared")
    number = max(storage.shuffle_parts(spark), -(-(size or 0) // archive_bytes))
    met = moving.repartition(number, "sha").join(groups.where(F.col("n") <= limit).drop("n"), F.col("sha") == F.col("shared"), "left").select(*columns)
    everything = still.unionByName(met)
    if parts:
        everything = everything.repartition(parts)
    packed = everything.mapInArrow(compress, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).text(path)
    _rename(spark, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Give the committed files the archives' usual ending; one metadata call a file.

    Readers take both names, so archives are whole wherever this stops."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(path, name[: -len(".txt")] + ".warc.zst"))


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to and,
    if ``keep_payload``, the payload (null in revisits). Responses are held against their
    digest; a difference raises."""
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + keep_payload]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + keep_payload]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for data in frames(archive.as_py()):
                    rows.append(parse_record(data)[: len(names)])
                    held += len(data) if keep_payload else 100
                    if held > 16 << 20:
                        yield _batch(rows, types, names)
                        rows, held = [], 0
                yield _batch(rows, types, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(unpack, ddl)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)
