"""Operator 8, media columns: a Spark data source over directories of media archives.

Archives are ZIP files of PNG images, members stored as they are, in one directory for each task that wrote some. The source
plans byte-range partitions over the directories, from a table of their sizes (a row for each task, no list of archives): a range
counts through a directory's archives in the order of their names. A partition lists its own directory, takes the members that
begin in its range, and streams them through Arrow in bounded batches. A listing or a member that cannot be read is tried again by
itself, a member from its offset; what was read before stays.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch, shared_dir, small

WIDTH, PAD, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 576, b"\xff", 16 << 20, 4 << 20, 4 << 20, 3
#: Ranges get longer with the corpus, so that there are no more than about this many beside one for each directory.
PARTITIONS = 20_000
_MAGIC = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, offset long, name string, n_bytes long, payload binary, media_bytes long, media_sha256 string"


def padded(raw: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of the width."""
    return raw + PAD * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(raw: bytes) -> bytes:
    """An 8-bit grey PNG, one sample for each padded byte, with the length of ``raw`` in a text chunk."""
    rows = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # the filter of every line is 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0" + str(len(raw)).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[int, bytes]:
    """(length without padding, samples) of such a PNG; a damaged one raises ValueError."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, size, lines = 8, 0, b""
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + data)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"tEXt":
            size = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            lines += data
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(lines), np.uint8).reshape(-1, WIDTH + 1)
    return size, rows[:, 1:].tobytes()


def write_archives(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(directory, archive, members, bytes): each text as a member of an archive below ``folder`` (any place pyarrow.fs can write).

    A member's name is its number and the id, quoted; a null id is empty. The result lists what counts: archives of task
    attempts that were lost are not in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, at, held, pack, members = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", 0, None, None, 0
        store.create_dir(f"{root}/{part}", recursive=True)

        def flush() -> pa.RecordBatch:
            nonlocal at, held, pack, members
            pack.close()
            with store.open_output_stream(f"{root}/{part}/{at:06d}.zip") as out:
                out.write(held.getbuffer())
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{at:06d}.zip"]), pa.array([members]), pa.array([held.getbuffer().nbytes])], names=["directory", "archive", "members", "bytes"])
            at, held, pack, members = at + 1, None, None, 0
            return row

        for b in small(batches):
            for name, raw in zip(b.column("name").to_pylist(), b.column("raw").to_pylist(), strict=True):
                if pack is None:
                    held = io.BytesIO()
                    pack = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                pack.writestr(zipfile.ZipInfo(f"{members}-{'' if name is None else '=' + urllib.parse.quote(name, safe='')}"), encode(raw))
                members += 1
                if held.tell() >= archive_bytes:
                    yield flush()
        if pack is not None:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("string").alias("name"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    return rows.mapInArrow(run, "directory string, archive string, members long, bytes long")


class Range(InputPartition):
    """The members that begin in [start, end) of a directory's archives, one behind the other."""

    def __init__(self, directory: str, start: int, end: int):
        self.directory, self.start, self.end = directory, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.directories = options.get("directories")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def _archives(self, store: fs.FileSystem, folder: str) -> list[tuple[str, int]]:
        """(name, size) of a directory's archives, by name."""
        return sorted((i.base_name, i.size) for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file and i.base_name.endswith(".zip"))

    def _sizes(self) -> list[tuple[str, int]]:
        if self.directories:
            import pyarrow.dataset as ds

            store, path = fs.FileSystem.from_uri(self.directories)
            got = ds.dataset(path, filesystem=store, format="parquet").to_table(["directory", "bytes"])
            return sorted(zip(got.column("directory").to_pylist(), got.column("bytes").to_pylist(), strict=True))
        store, root = fs.FileSystem.from_uri(self.folder)
        below = [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not i.is_file]
        return [(d, sum(n for _, n in self._archives(store, f"{root}/{d}".rstrip("/")))) for d in ["", *sorted(below)]]

    def partitions(self) -> list[Range]:
        sizes = self._sizes()
        step = max(self.range_bytes, -(-sum(n for _, n in sizes) // PARTITIONS))
        return [Range(d, s, min(n, s + step)) for d, n in sizes for s in range(0, n, step)] or [Range("", 0, 0)]

    def _again(self, f):
        """What ``f`` gives, at one of the tries."""
        for k in range(self.tries):
            try:
                return f()
            except (OSError, ValueError, struct.error, zlib.error, zipfile.BadZipFile):
                if k + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**k)

    def _member(self, store: fs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
        """A member's bytes, from its own offset."""
        with store.open_input_file(path) as f:
            head = f.read_at(30, info.header_offset)
            names = struct.unpack("<HH", head[26:30])
            media = f.read_at(info.file_size, info.header_offset + 30 + sum(names))
        if head[:4] != b"PK\x03\x04" or zlib.crc32(media) != info.CRC:
            raise ValueError(f"{path}: {info.filename} at {info.header_offset} is damaged")
        return media

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(",")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

        store, root = fs.FileSystem.from_uri(self.folder)
        folder, base = f"{root}/{partition.directory}".rstrip("/"), 0

        def members(path: str) -> list[zipfile.ZipInfo]:
            with store.open_input_file(path) as f:
                return zipfile.ZipFile(f).infolist()

        for name, length in self._again(lambda: self._archives(store, folder)) if partition.end else ():
            path, low, base = f"{folder}/{name}", base, base + length
            if low >= partition.end or base <= partition.start:
                continue
            for m in self._again(lambda path=path: members(path)):
                if partition.start <= low + m.header_offset < partition.end:
                    media, (n, payload) = self._again(lambda path=path, m=m: (x := self._member(store, path, m), decode(x)))
                    rows.append((f"{partition.directory}/{name}".lstrip("/"), m.header_offset, m.filename, n, payload, len(media), hashlib.sha256(media).hexdigest()))
                    size += len(payload) + len(media)
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        yield batch()


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options: directories (a table of directory and bytes), range_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(archive, offset, name, n_bytes, payload, media_bytes, media_sha256) of every member."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def features(payload: bytes) -> str:
    """Lines, mean, deviation, and the share of samples that differ from the one before."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    return f"rows={n // WIDTH};mean={s / n:.4f};deviation={max(0.0, (q - s * s / n) / n) ** 0.5:.4f};edges={int(np.count_nonzero(x[1:] != x[:-1])) / n:.4f}"


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from what is read back.

    Null and empty texts are one line of padding. Equal texts have equal values. Repeated rows and null ids get a row each.
    An empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "media")
    kind = docs.schema[doc_id].dataType
    listed = scratch(write_archives(docs, folder, doc_id, text, archive_bytes), "media-archives")
    sizes = scratch(listed.groupBy("directory").agg(F.sum("bytes").alias("bytes")), "media-directories")
    found = read_archives(spark, folder, directories=sizes.inputFiles()[0].rpartition("/")[0], range_bytes=range_bytes)
    quoted = F.regexp_extract("name", "=(.*)$", 1)
    own = F.when(F.col("name").contains("="), F.url_decode(quoted)).cast(kind)
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("payload").to_pylist()
            more = [pa.array([len(x) for x in p], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in p], pa.string()), pa.array([zlib.crc32(x[-32:]) for x in p], pa.int64()), pa.array([features(x) for x in p], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + more, names=[*kept, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    kept = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    rows = found.select(own.alias("doc_id"), "n_bytes", "media_bytes", "media_sha256", "payload")
    out = rows.mapInArrow(look, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]) + ", " + schema)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_archive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
