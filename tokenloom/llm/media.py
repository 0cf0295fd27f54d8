"""Media columns: archives of images, and a data source that reads their members by byte ranges.

Texts' bytes are stored as lossless 8-bit grey images in ZIP archives in the folder that driver and
executors share. The data source plans partitions as byte ranges over the archives of a folder;
each reads the archive's directory, then the members whose offset lies in its range, streams their
bytes in Arrow batches and retries each member by itself at its offset.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_folder

UNIT = 576
PAD = b"\xff"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 128 << 20, 16 << 20, 4 << 20, 3
MEMBERS = "archive string, offset long, name string, content binary, error string"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def padded(utf8: bytes) -> bytes:
    return utf8 + PAD * (UNIT - len(utf8) if not utf8 else -len(utf8) % UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A PNG of 8-bit grey samples, ``UNIT`` to a row, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> bytes:
    """The samples of such a PNG, chunk checksums verified."""
    at, data, size = 8, [], (0, 0)
    while at < len(image):
        n = struct.unpack_from(">I", image, at)[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("checksum of an image chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return raw[:, 1:].tobytes()


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Stores every text as a member <n>_<id>.png; returns the folder, with a table of its archives.

    Each attempt of a task writes archives under names of its own, and only those that a
    finished task has reported are in the table, so retries and lost executors leave no doubles.
    """
    folder = shared_folder(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out = archive = None
        name, n, k = "", 0, 0

        def finish() -> pa.RecordBatch:
            archive.close()
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "members": [n], "bytes": [size]})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    name, n = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                archive.writestr(f"{k:010d}_{doc_id}.png", to_image(padded(text.as_py() or b"")))
                n, k = n + 1, k + 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield finish()
                    archive = None
        if archive is not None:
            yield finish()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    texts.mapInArrow(store, "archive string, members long, bytes long").write.parquet(f"{folder}/archives.parquet")
    return folder


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class _RangeReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[ByteRange]:
        fs, root = filesystem(self.folder)
        found = pa.dataset.dataset(f"{root}/archives.parquet", filesystem=fs, format="parquet").to_table()
        sizes = zip(found["archive"].to_pylist(), found["bytes"].to_pylist(), strict=True)
        return [ByteRange(a, s, s + RANGE_BYTES) for a, size in sizes for s in range(0, size, RANGE_BYTES)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = filesystem(self.folder)
        path = f"{root}/{partition.archive}"
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            members = sorted((m for m in archive.infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)
        rows, size = [], 0
        source = fs.open_input_file(path)
        for m in members:
            content = error = None
            for _ in range(ATTEMPTS):
                try:
                    content, error = _member(source, m), None
                    break
                except (OSError, ValueError) as x:
                    error = f"{type(x).__name__}: {x}"
                    source = fs.open_input_file(path)
            rows.append((partition.archive, m.header_offset, m.filename, content, error))
            size += len(content or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "name", "content", "error"])


def _member(source: pa.NativeFile, m: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, read at its offset and checked against the directory."""
    source.seek(m.header_offset)
    head = source.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"no member at {m.header_offset}")
    source.seek(m.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    content = source.read(m.file_size)
    if len(content) != m.file_size or zlib.crc32(content) != m.CRC:
        raise ValueError(f"checksum of the member at {m.header_offset}")
    return content


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members").option("path", folder)``: one row per member.

    A member that fails ``ATTEMPTS`` times has a null content and its error; others are not touched by it."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options["path"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").option("path", folder).load()


def _feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and rate of crossings of the middle, of 8-bit samples."""
    share = np.bincount(samples, minlength=256) / len(samples)
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(0.0, float(share @ levels**2) - mean * mean)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    return f"mean={mean:.4f};dev={deviation:.4f};bits={entropy:.4f};cross={crossings / len(samples):.6f}"


def media_features(members: DataFrame) -> DataFrame:
    """Decodes members and describes payload and stored form; a failed member keeps nulls but its id."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number = name.partition("_")[2].removesuffix(".png")
                doc_id = None if number == "None" else int(number)
                image = content.as_py()
                if image is None:
                    rows.append((doc_id, *[None] * 7))
                    continue
                payload = from_image(image)
                rows.append(
                    (doc_id, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), _feature(np.frombuffer(payload, np.uint8)))
                )
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string() if x.endswith("sha256") or x == "feature" else pa.int64() for x in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    return members.select("name", "content").mapInArrow(describe, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as images, reads the archives back by byte ranges and describes each.

    UTF-8 never holds byte 255, so the padding is told from the text. A null text is empty and has one
    unit of padding. Repeated rows are members each; a null id stays null; an empty table gives no
    rows. Other columns are not carried. The archives stay in the shared folder."""
    return media_features(read_archives(docs.sparkSession, write_archives(docs, id_col, text_col)))
