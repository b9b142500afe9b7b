"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

A text's UTF-8 bytes, padded with 0 to a positive multiple of 64, are the samples of an 8-bit grey PNG of one line.
Each task appends the pictures it has not stored yet to tar shards of bounded size in the shared folder, named by
the SHA-256 of their payload; rows carry digest, shard, offset and length.  Compaction keeps one place for each
digest; a picture stored by two tasks stays in the other shard unreferenced.  Metadata come from a range read of the
first 33 bytes, features from the stored bytes read back.  Shards of failed attempts are never referenced.

Defined results: a null text is empty (one row of 64 zeros); equal texts have equal values; repeated rows repeat; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import attach, scratch_path, table, written

WIDTH = 64
SHARD_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEAD = 33  # signature and the whole IHDR chunk


def _open(folder: str):
    """(file system, path) of a folder given as a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def payload(data: bytes) -> bytes:
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    return data.ljust(size, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    head = struct.pack(">IIBBBBB", len(samples), 1, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(b"\0" + samples, 6)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", first[16:25])


def decode_png(data: bytes) -> bytes:
    width, height, _ = png_header(data[:_HEAD])
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a stored chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar shards and says where each one's bytes lie."""

    def __init__(self, folder: str, most: int = SHARD_BYTES):
        self.fs, self.path = _open(folder)
        self.most, self.out, self.name, self.at = most, None, "", 0

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        name, begin = self.name, self.at + 512
        self.at = begin + len(data) + (-len(data) % 512)
        if self.at >= self.most:
            self.close()
        return name, begin

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, digest (32 bytes), shard, offset, length, in a table of its own; the payloads are in `folder`."""
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, known = ShardWriter(folder, shard_bytes), {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                body = payload(data)
                digest = hashlib.sha256(body).digest()
                if digest not in known:
                    if len(known) > 200_000:
                        known.clear()
                    png = encode_png(body)
                    known[digest] = (*to.add(digest.hex(), png), len(png))
                rows.append((len(data), digest, *known[digest]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        to.close()

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return written(picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long"), "media-rows")


def index(rows: DataFrame) -> DataFrame:
    """One place for each digest, with the count of its rows."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count(F.lit(1)).alias("group_size")).select("digest", "at.*", "group_size")


def _by_shard(places: DataFrame) -> DataFrame:
    return places.select("digest", "shard", "offset", "length", "group_size").repartition("shard").sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], folder: str, head_only: bool) -> Iterator[list[tuple[bytes, bytes, bytes, int]]]:
    """(digest, header, the whole or nothing, rows of the digest), by range reads."""
    fs, path = _open(folder)
    name, file = None, None
    for batch in batches:
        out = []
        for digest, shard, offset, length, rows in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if shard != name:
                name, file = shard, fs.open_input_file(f"{path}/{shard}")
            head = file.read_at(_HEAD, offset)
            out.append((digest, head, b"" if head_only else head + file.read_at(length - _HEAD, offset + _HEAD), rows))
            if len(out) >= 500:
                yield out
                out = []
        if out:
            yield out


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits, by header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _ranges(batches, folder, True):
            heads = [png_header(x) for _, x, _, _ in some]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([d for d, *_ in some], pa.binary()), **{n: pa.array([h[k] for h in heads], pa.int64()) for k, n in enumerate(("width", "height", "bits"))}})

    return _by_shard(places).mapInArrow(run, "digest binary, width long, height long, bits long")


def features(places: DataFrame, folder: str) -> DataFrame:
    """digest and what the stored bytes, read back whole, say; with the rows of each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _ranges(batches, folder, False):
            rows = []
            for digest, _, data, n in some:
                body = decode_png(data)
                x = np.frombuffer(body, np.uint8)
                rows.append((digest, len(body), hashlib.sha256(body).digest(), zlib.crc32(body[-WIDTH:]), len(data), hashlib.sha256(data).digest(), n, f"png:sum={int(x.sum(dtype=np.int64))};max={int(x.max())};zero={int((x == 0).sum())};high={int((x > 127).sum())}"))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string())
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "group_size", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _by_shard(places).mapInArrow(run, "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, group_size long, feature string")


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes; digest, shard, offset, length of the stored picture; width, height, bits from its header; what its bytes say."""
    folder = folder or scratch_path(docs.sparkSession, "media-shards")
    rows = store(docs, folder, shard_bytes=shard_bytes)
    places = written(index(rows), "media-index")
    full = written(features(places, folder), "media-features")
    known = places.join(metadata(places, folder), "digest").join(full.drop("group_size"), "digest")
    out = attach(rows.drop("shard", "offset", "length"), written(known, "media-known"), "digest", "group_size", rows.count())
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")})


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height", "bits")
