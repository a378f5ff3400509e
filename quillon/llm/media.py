"""Media columns: content-addressed payloads in tar shards, referred to by digest, offset and length.

``store`` writes payloads as 8-bit grey PNG images into tar files in the shared folder and returns
references. ``metadata`` fills columns from a range read of the header bytes alone. ``read_back``
reads whole members, verifies them and computes features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_parts, workspace

#: Samples in a row of the image; payloads are padded to whole rows.
ROW = 576
PAD = 255
#: A tar shard is closed at this size.
SHARD_BYTES = 64 << 20
#: Stored bytes that one task reads back, and those of one read.
PIECE_BYTES, READ_BYTES = 64 << 20, 8 << 20
PNG_SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
#: Signature, chunk length and type, and the 13 bytes of the header chunk.
PNG_HEADER_BYTES = 29

REFERENCE = "doc_id bigint, n_bytes bigint, media_sha256 string, shard string, offset bigint, length bigint"


def pad(raw: bytes) -> bytes:
    """``raw`` and as many bytes 255 as make a positive multiple of ROW."""
    return raw + bytes([PAD]) * ((-len(raw)) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image, ROW samples wide, of the payload. The same payload gives the same bytes."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    header = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + b"".join(
        (_chunk(b"IHDR", header), _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)), _chunk(b"IEND", b""))
    )


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first PNG_HEADER_BYTES bytes."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(image: bytes) -> bytes:
    """The samples of an image that ``encode_png`` made; checks every chunk's CRC."""
    width, height, depth = png_header(image)
    at, packed = 8, b""
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("unexpected PNG layout")
    return lines[:, 1:].tobytes()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Shards:
    """Writes one task's members to tar files; each distinct member once a shard."""

    def __init__(self, folder: str, shard_bytes: int):
        self.folder, self.limit, self.at, self.closed = folder, shard_bytes, None, 0

    def add(self, digest: str, image: bytes) -> tuple[str, int, int]:
        if self.at is None or self.at[1].tell() > self.limit:
            self.close()
            uri = f"{self.folder}/shard-{uuid.uuid4().hex}.tar"
            files, path = _open(uri)
            files.create_dir(path.rsplit("/", 1)[0], recursive=True)
            raw = files.open_output_stream(path)
            self.at = (uri, raw, {})
        uri, raw, members = self.at
        if digest not in members:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            raw.write(info.tobuf(tarfile.USTAR_FORMAT))
            members[digest] = raw.tell()
            raw.write(image + bytes(-len(image) % tarfile.BLOCKSIZE))
        return uri, members[digest], len(image)

    def close(self) -> None:
        if self.at:
            self.at[1].write(bytes(2 * tarfile.BLOCKSIZE))
            self.at[1].close()
            self.at, self.closed = None, self.closed + 1


def _writer(folder: str, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, closed = _Shards(folder, shard_bytes), 0
        rows: list[tuple] = []

        def complete(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        # references leave the task only when their shard is complete
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                image = encode_png(pad(raw))
                digest = hashlib.sha256(image).hexdigest()
                place = shards.add(digest, image)
                if shards.closed > closed:
                    yield from complete(rows)
                    rows, closed = [], shards.closed
                rows.append((doc_id, len(raw), digest, *place))
        shards.close()
        yield from complete(rows)

    return write


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write each document's padded UTF-8 text as an image; returns one reference per row of ``docs``.

    Null texts count as empty and an empty text is stored as one row of padding. Equal payloads have
    the same digest and bytes; a task stores them once per shard. Shard names are never reused, so a
    task that runs again leaves at most an unreferenced shard behind. An empty table gives no shard.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    references = narrow.mapInArrow(_writer(f"{folder}/shards", shard_bytes), REFERENCE)
    return materialize(references, f"{folder}/references")


class _Ranges:
    """Range reads; the last shard stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            files, path = _open(uri)
            self.uri, self.file = uri, files.open_input_file(path)
        return self.file.read_at(length, offset)

    def members(self, rows: list[dict]) -> Iterator[tuple[dict, bytes]]:
        """Each reference with its member; neighbours in a shard are read at once, up to READ_BYTES."""
        i = 0
        while i < len(rows):
            first, j = rows[i], i + 1
            end = first["offset"] + first["length"]
            while j < len(rows) and rows[j]["shard"] == first["shard"] and first["offset"] <= rows[j]["offset"] <= end + 2 * tarfile.BLOCKSIZE:
                upto = max(end, rows[j]["offset"] + rows[j]["length"])
                if upto - first["offset"] > READ_BYTES:
                    break
                end, j = upto, j + 1
            block = self.read(first["shard"], first["offset"], end - first["offset"])
            for r in rows[i:j]:
                at = r["offset"] - first["offset"]
                yield r, block[at : at + r["length"]]
            i = j


def by_place(references: DataFrame) -> DataFrame:
    """``references`` dealt and sorted by where their payloads are stored, so that reads follow each other
    and as many tasks take part as the stored bytes need, however small the references are."""
    size = references.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(shuffle_parts(references.sparkSession), -(-size // PIECE_BYTES))
    return references.repartition(n, "shard", F.floor(F.col("offset") / PIECE_BYTES)).sortWithinPartitions("shard", "offset")


def metadata(references: DataFrame) -> DataFrame:
    """``references`` with width, height and bit_depth, read from the members' headers only."""
    schema = f"{REFERENCE}, width int, height int, bit_depth int"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges()
        for batch in batches:
            heads = [
                png_header(ranges.read(s, o, PNG_HEADER_BYTES))
                for s, o in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True)
            ]
            out = {c: batch[c] for c in batch.schema.names}
            for i, name in enumerate(("width", "height", "bit_depth")):
                out[name] = pa.array([h[i] for h in heads], pa.int32())
            yield pa.RecordBatch.from_pydict(out)

    return references.mapInArrow(fill, schema)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy (bits) and mean absolute step of the samples, six decimals each."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0  # no negative zero
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"mean={samples.mean():.6f};std={samples.std():.6f};entropy={entropy:.6f};step={step:.6f}"


def read_back(references: DataFrame) -> DataFrame:
    """Reads every member whole: payload length and digests, CRC of its last 32 bytes, media length
    and digest, and ``feature``. Fails on a member that differs from its digest. Members that follow
    each other in a shard, as ``by_place`` puts them, are read together. An empty table gives no rows.
    """
    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint,"
        " media_sha256 string, feature string, width int, height int, bit_depth int"
    )
    names = [part.split()[0] for part in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, last = _Ranges(), ("", None)
        for batch in batches:
            rows = []
            for r, image in ranges.members(batch.to_pylist()):
                if last[0] != r["media_sha256"]:
                    if hashlib.sha256(image).hexdigest() != r["media_sha256"]:
                        raise ValueError(f"{r['shard']} at {r['offset']}: content differs from its digest")
                    payload = decode_png(image)
                    last = (
                        r["media_sha256"],
                        {
                            "payload_bytes": len(payload),
                            "payload_sha256": hashlib.sha256(payload).hexdigest(),
                            "tail_crc32": zlib.crc32(payload[-32:]),
                            "media_bytes": len(image),
                            "media_sha256": r["media_sha256"],
                            "feature": feature(np.frombuffer(payload, np.uint8)),
                        },
                    )
                rows.append(last[1] | {k: r[k] for k in ("doc_id", "n_bytes", "width", "height", "bit_depth")})
            types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
            types |= {n: pa.int32() for n in ("width", "height", "bit_depth")}
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([x[n] for x in rows], types.get(n, pa.string())) for n in names}
            )

    return references.mapInArrow(read, schema)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_back(metadata(by_place(store(docs, workspace(spark, "media")))))
