"""Packed artifacts: sectioned packs, int8 matrices, request frames and resource registries."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magics, section names by tag, and the order of sections.
PACK, MATRIX, WIRE = b"KPK1", b"KTM1", b"KOSH"
#: The registry format is told by the end of its spec name.
SPEC_END = ".resources/v1"


class ArtifactError(ValueError):
    """An artifact whose bytes break its format."""


def write_pack(sections: list[tuple[int, bytes]]) -> bytes:
    """count, then for each section: length, tag, payload, SHA-256 of the payload."""
    out = [PACK, struct.pack("<I", len(sections))]
    for tag, payload in sections:
        out += [struct.pack("<IB", len(payload), tag), payload, hashlib.sha256(payload).digest()]
    return b"".join(out)


def read_pack(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, payload) of each section; tags ascend, digests hold, nothing follows."""
    if data[:4] != PACK or len(data) < 8:
        raise ArtifactError("not a pack")
    (count,), at, out = struct.unpack_from("<I", data, 4), 8, []
    for _ in range(count):
        if at + 5 > len(data):
            raise ArtifactError("truncated section")
        size, tag = struct.unpack_from("<IB", data, at)
        payload, digest = data[at + 5 : at + 5 + size], data[at + 5 + size : at + 37 + size]
        if len(payload) != size or len(digest) != 32:
            raise ArtifactError("truncated section")
        if hashlib.sha256(payload).digest() != digest:
            raise ArtifactError(f"section {tag}: digest differs")
        if out and tag <= out[-1][0]:
            raise ArtifactError("sections out of order")
        out.append((tag, payload))
        at += 37 + size
    if at != len(data):
        raise ArtifactError("bytes after the last section")
    return out


def read_packs(files: DataFrame) -> DataFrame:
    """path, tag, payload, digest of every section of ``binaryFile`` rows."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                tags, payloads = zip(*read_pack(content)) if read_pack(content) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(tags), pa.string()), pa.array(tags, pa.int32()), pa.array(payloads, pa.binary())], ["path", "tag", "payload"])

    return files.select("path", "content").mapInArrow(run, "path string, tag int, payload binary").withColumn("digest", F.sha2("payload", 256))


def write_matrix(rows: np.ndarray, scales: np.ndarray) -> bytes:
    """Version, count and width, the int8 rows, their float32 scales."""
    return MATRIX + struct.pack("<III", 1, *rows.shape) + rows.astype("i1").tobytes() + scales.astype("<f4").tobytes()


def read_matrix(data: bytes, words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    if data[:4] != MATRIX or len(data) < 16:
        raise ArtifactError("not a matrix")
    version, n, dims = struct.unpack_from("<III", data, 4)
    if version != 1 or len(data) != 16 + n * dims + 4 * n:
        raise ArtifactError("matrix size differs from its head")
    if words is not None and words != n:
        raise ArtifactError("matrix and vocabulary differ in size")
    return np.frombuffer(data, "i1", n * dims, 16).reshape(n, dims), np.frombuffer(data, "<f4", n, 16 + n * dims)


def encode_request(kind: int, language: str, words: list[str], limit: int = 0) -> bytes:
    """A check (0) or suggest (1) request: version, kind, strings with their lengths, limit."""
    text = lambda s: struct.pack("<I", len(b := s.encode())) + b
    return WIRE + bytes([1, kind]) + text(language) + struct.pack("<I", len(words)) + b"".join(map(text, words)) + struct.pack("<I", limit)


def decode_request(data: bytes) -> tuple[int, str, list[str], int]:
    if data[:5] != WIRE + b"\1":
        raise ArtifactError("not a request of this version")
    at = 6

    def number() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ArtifactError("truncated request")
        at += 4
        return struct.unpack_from("<I", data, at - 4)[0]

    def text() -> str:
        nonlocal at
        n = number()
        if at + n > len(data):
            raise ArtifactError("truncated request")
        at += n
        return data[at - n : at].decode()

    out = data[5], text(), [text() for _ in range(number())], number()
    if at != len(data):
        raise ArtifactError("bytes after the request")
    return out


#: Sources by their code in responses.
SOURCE_CODES = ("symspell", "edit_distance", "phonetic", "keyboard_proximity", "ngram", "semantic")


def encode_response(kind: int, results: list) -> bytes:
    """Answers to a check (0): a list of booleans; to a suggest (1): a list of (word, distance, confidence, source)."""
    out = [WIRE, bytes([1, kind]), struct.pack("<I", len(results))]
    for r in results:
        if kind == 0:
            out.append(bytes([bool(r)]))
        else:
            word = r[0].encode()
            out += [struct.pack("<I", len(word)), word, struct.pack("<BdB", min(r[1], 255), r[2], SOURCE_CODES.index(r[3]))]
    return b"".join(out)


def decode_response(data: bytes) -> tuple[int, list]:
    if data[:5] != WIRE + b"\1" or len(data) < 10 or data[5] not in (0, 1):
        raise ArtifactError("not a response of this version")
    kind, (n,), at, out = data[5], struct.unpack_from("<I", data, 6), 10, []
    try:
        for _ in range(n):
            if kind == 0:
                out.append(data[at] != 0)
                at += 1
            else:
                (size,) = struct.unpack_from("<I", data, at)
                word = data[at + 4 : at + 4 + size].decode()
                distance, confidence, source = struct.unpack_from("<BdB", data, at + 4 + size)
                out.append((word, distance, confidence, SOURCE_CODES[source]))
                at += 14 + size
    except (IndexError, struct.error) as e:
        raise ArtifactError("truncated response") from e
    if at != len(data):
        raise ArtifactError("bytes after the response")
    return kind, out


def read_matrices(files: DataFrame) -> DataFrame:
    """path, row, q, scale of every row of the int8 matrices in ``binaryFile`` rows."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                q, scale = read_matrix(content)
                for a in range(0, len(q), 4096):
                    some = q[a : a + 4096]
                    cols = [pa.array([path] * len(some), pa.string()), pa.array(np.arange(a, a + len(some)), pa.int64())]
                    cols += [pa.FixedSizeListArray.from_arrays(pa.array(some.reshape(-1).astype(np.int32)), some.shape[1]).cast(pa.list_(pa.int32())), pa.array(scale[a : a + 4096], pa.float32())]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "row", "q", "scale"])

    return files.select("path", "content").mapInArrow(run, "path string, row long, q array<int>, scale float")


def check_tier(tier: DataFrame, dims: int) -> DataFrame:
    """A tier (word, row_id, vec), raising at run time on a row whose vector has another length or whose
    number is negative; null words and vectors count as broken too."""
    ok = F.col("word").isNotNull() & (F.col("row_id") >= 0) & (F.size("vec") == dims)
    return tier.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("broken row of a tier: "), F.coalesce("word", F.lit("null")))).isNull())


def check_buckets(buckets: DataFrame, bucket_count: int) -> DataFrame:
    """A bucket table (bucket_id, vec), raising at run time on ids out of range or standing twice."""
    repeated = buckets.groupBy("bucket_id").agg(F.count("*").alias("n"), F.first("vec").alias("vec"))
    ok = (F.col("n") == 1) & (F.col("bucket_id") >= 0) & (F.col("bucket_id") < bucket_count)
    return repeated.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("bucket ids repeat or are out of range")).isNull()).select("bucket_id", "vec")


def resolve_one(text: str, language: str, tier: str) -> dict:
    """The resource of a language and tier; its id must be ``language-tier`` and its fields say the same."""
    found = parse_registry(text).get(f"{language}-{tier}")
    if found is None:
        raise ArtifactError(f"no resource {language}-{tier}")
    named = found["tier"]["name"] if isinstance(found.get("tier"), dict) else found.get("tier")
    if found.get("language") != language or named != tier:
        raise ArtifactError(f"resource {language}-{tier} says {found.get('language')}-{named}")
    return found


def cached(folder: str, resource: dict, fetch) -> bytes:
    """A resource's bytes: from the folder while their digest holds, else by ``fetch(url)`` from the
    resource's url, then its mirror; verified before they are put in place (driver only)."""
    import os

    want = resource["sha256"].lower()
    path = os.path.join(folder, want)
    if os.path.exists(path):
        with open(path, "rb") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() == want:
            return data
    for url in filter(None, (resource.get("url"), resource.get("mirror"))):
        try:
            data = fetch(url)
        except OSError:
            continue
        if hashlib.sha256(data).hexdigest() == want:
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)
            return data
    raise ArtifactError("no source gives the resource's bytes")


def parse_registry(text: str) -> dict[str, dict]:
    """Resources of a registry by id; the spec's name is checked."""
    data = json.loads(text)
    if not str(data.get("spec", "")).endswith(SPEC_END):
        raise ArtifactError("unknown registry spec")
    return data.get("resources", {})


def resolve(registries: DataFrame, json_col: str = "registry") -> DataFrame:
    """id, language, tier, sha256, url of every resource of registry JSON rows."""
    body = F.from_json(F.col(json_col), "spec string, resources map<string, struct<language: string, tier: string, sha256: string, url: string>>")
    each = registries.select(body.alias("r")).where(F.col("r.spec").endswith(SPEC_END)).select(F.explode("r.resources").alias("id", "x"))
    return each.select("id", "x.language", "x.tier", F.lower("x.sha256").alias("sha256"), "x.url")
