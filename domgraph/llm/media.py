"""Media columns: payloads stored as PNG members of ZIP archives, read back by a Spark data source of byte ranges.

Writing. `media_archive` is a Python data source. Each task streams Arrow batches into archives of its own, uncompressed ZIPs
of at most about `archive_bytes`, and the commit writes a manifest of the archives that count; a retried or speculative task's
leftovers are never in it.

Reading. The driver plans from the manifest alone: each archive is cut into byte ranges of about `range_bytes`. A task reads the
archive's central directory from its end and takes the members whose headers start in its range, one by one by offset. A
directory or member that can't be read is tried again from its own offset, on a fresh handle, `retries` times; then it
fails the task or, with on_error=mark, becomes a row with its error (a directory's has offset -1), while its neighbours are not read
again. The manifest has one entry an archive and the driver one a range, some 100 bytes for each 64 MB.

A payload is the text's UTF-8 bytes followed by bytes 32 up to a positive multiple of 192. It is stored as an 8-bit greyscale PNG
192 samples wide, which is lossless; a tEXt chunk holds the number of bytes before padding, so a member depends on its text
alone.

Defined results: a null or empty text is 192 bytes 32 with n_bytes 0; a null doc_id has an empty name in the archive; repeated
rows are members each; a very long text is packed and described piece by piece; an empty table has a manifest without archives.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from domgraph.llm import scratch

WIDTH = 192
#: The PNG signature and the ZIP records' signatures.
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END_64, _LOCATOR_64 = b"PK\x06\x06", b"PK\x06\x07"
_MANIFEST = "_manifest.json"
_PIECE = 1 << 20
_ROWS = 1 << 12
_BATCH_BYTES = 8 << 20


def pad(data: bytes) -> bytes:
    """The payload of a text's bytes."""
    return data + b" " * ((-len(data)) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    """The payload as an 8-bit greyscale image, rows of WIDTH samples without filtering."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    squeeze, parts = zlib.compressobj(level), []
    # Some rows at a time, so that a very long text is copied only once, as what it packs to.
    for k in range(0, len(rows), _ROWS):
        part = rows[k : k + _ROWS]
        filtered = np.zeros((len(part), WIDTH + 1), np.uint8)
        filtered[:, 1:] = part
        parts.append(squeeze.compress(filtered))
    packed = b"".join([*parts, squeeze.flush()])
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    pieces = [_chunk(b"IDAT", packed[k : k + _PIECE]) for k in range(0, len(packed), _PIECE)]
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + b"".join(pieces) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Payload and n_bytes of an image that to_png made; ValueError if any chunk is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, n_bytes, shape = 8, [], -1, (0, 0)
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    return rows[:, 1:].tobytes(), n_bytes


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveFile:
    """Writes members to one ZIP archive, uncompressed, with 64-bit sizes only where needed."""

    def __init__(self, stream):
        self.stream, self.at, self.directory, self.members = stream, 0, [], 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: bytes, data: bytes) -> None:
        crc, offset = zlib.crc32(data), self.at
        large = offset >= 0xFFFFFFFF
        extra = struct.pack("<HHQ", 1, 8, offset) if large else b""
        if len(data) >= 0xFFFFFFFF:
            raise ValueError("a member is limited to 4 GB")
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(name), 0) + name)
        self._put(data)
        head = struct.pack(
            "<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, len(data), len(data), len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if large else offset
        )
        self.directory.append(_CENTRAL + head + name + extra)
        self.members += 1

    def close(self) -> None:
        start = self.at
        for entry in self.directory:
            self._put(entry)
        size, n = self.at - start, self.members
        if n >= 0xFFFF or start >= 0xFFFFFFFF:
            at = self.at
            self._put(_END_64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(_LOCATOR_64 + struct.pack("<IQI", 0, at, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))
        self.stream.close()


def read_directory(file, size: int) -> list[tuple[int, str, int, int]]:
    """(offset, name, size, crc) of all members, from the end of an archive."""
    tail_at = max(0, size - 128)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("not a ZIP archive")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    wide = tail.rfind(_END_64, 0, end)
    if wide >= 0 and tail.rfind(_LOCATOR_64, 0, end) >= 0:
        n, length, start = struct.unpack_from("<QQQ", tail, wide + 32)
    file.seek(start)
    data, at, found = file.read(length), 0, []
    for _ in range(n):
        crc, packed, _, names, extras, comments = struct.unpack_from("<IIIHHH", data, at + 16)
        (offset,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + names].decode()
        if offset == 0xFFFFFFFF:
            (offset,) = struct.unpack_from("<Q", data, at + 46 + names + 4)
        found.append((offset, name, packed, crc))
        at += 46 + names + extras + comments
    return found


def read_member(file, offset: int, size: int, crc: int) -> bytes:
    """A member's bytes, found by its offset and checked."""
    file.seek(offset)
    head = file.read(30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no member at {offset}")
    names, extras = struct.unpack_from("<HH", head, 26)
    file.seek(offset + 30 + names + extras)
    data = file.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"the member at {offset} is damaged")
    return data


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int, level: int):
        self.path, self.archive_bytes, self.level = path, archive_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        archive, name = None, ""

        def close() -> None:
            archive.close()
            done.append((name, archive.at, archive.members))

        for batch in iterator:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.zip"
                    archive = ArchiveFile(system.open_output_stream(f"{root}/{name}"))
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                key = "" if doc_id.as_py() is None else str(doc_id.as_py())
                archive.add(f"{key}.png".encode(), to_png(pad(data), len(data), self.level))
                if archive.at >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        archives = sorted(a for m in messages if m is not None for a in m.archives)
        with system.open_output_stream(f"{root}/{_MANIFEST}") as f:
            f.write(json.dumps({"archives": archives}).encode())

    def abort(self, messages: list) -> None:
        system, root = _open(self.path)
        for m in messages:
            for name, _, _ in m.archives if m is not None else ():
                system.delete_file(f"{root}/{name}")


@dataclass
class _Range(InputPartition):
    archive: str
    size: int
    start: int
    end: int


class _Handle:
    """An open file that can be closed and opened again."""

    def __init__(self, system: fs.FileSystem, where: str):
        self.system, self.where, self.opened = system, where, None

    def file(self):
        if self.opened is None:
            self.opened = self.system.open_input_file(self.where)
        return self.opened

    def close(self) -> None:
        if self.opened is not None:
            self.opened.close()
        self.opened = None


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, retries: int, mark: bool):
        self.path, self.range_bytes, self.retries, self.mark = path, range_bytes, retries, mark

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        with system.open_input_stream(f"{root}/{_MANIFEST}") as f:
            archives = json.loads(f.read())["archives"]
        cuts = [_Range(n, s, a, min(s, a + self.range_bytes)) for n, s, _ in archives for a in range(0, s, self.range_bytes)]
        return cuts or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, root = _open(self.path)
        where = f"{root}/{partition.archive}"
        held = _Handle(system, where)
        rows: list[tuple] = []
        size_held = 0
        try:
            entries, error = self._tried(held, lambda file: read_directory(file, partition.size), f"{partition.archive}, directory")
            if error and partition.start == 0:
                yield self._batch([(None, None, partition.archive, -1, error)])
            for offset, name, size, crc in entries or ():
                if not partition.start <= offset < partition.end:
                    continue
                media, error = self._tried(held, lambda file, at=(offset, size, crc): read_member(file, *at), f"{partition.archive}@{offset}")
                key = name.removesuffix(".png")
                rows.append((int(key) if key else None, media, partition.archive, offset, error))
                size_held += size
                if size_held >= _BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size_held = [], 0
        finally:
            held.close()
        if rows:
            yield self._batch(rows)

    def _tried(self, held: _Handle, read: Callable, what: str) -> tuple:
        """What read gives and no error, or nothing and the error of the last of all tries, each after the first on a fresh handle."""
        for _ in range(self.retries + 1):
            try:
                return read(held.file()), None
            except (OSError, ValueError, struct.error) as x:
                error = f"{what}: {x}"
                held.close()
        if not self.mark:
            raise ValueError(error)
        return None, error

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string())
        columns = [pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "media", "archive", "offset", "error"])


class MediaArchive(DataSource):
    """Options: path, archive_bytes, level (writing); range_bytes, retries, on_error (fail or mark; reading)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id bigint, media binary, archive string, offset bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("range_bytes", 64 << 20)), int(o.get("retries", 2)), o.get("on_error") == "mark")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return _Writer(o["path"], int(o.get("archive_bytes", 128 << 20)), int(o.get("level", 6)))


def write_media(docs: DataFrame, path: str, **options) -> None:
    """Store the texts of docs (doc_id, text) as media archives under path."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    with scratch.small_batches(docs.sparkSession):
        rows.write.format("media_archive").options(**options).mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, media, archive, offset, error of all members under path."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def feature(payload: bytes) -> str:
    """Mean and spread of the samples, their crossings of the mean, and the shares of 16 bands of values."""
    x = np.frombuffer(payload, np.uint8)
    counts, n, crossings, before = np.zeros(256, np.int64), len(x), 0, None
    for k in range(0, n, _PIECE):
        counts += np.bincount(x[k : k + _PIECE], minlength=256)
    values = np.arange(256)
    total, squares = int((values * counts).sum()), int((values * values * counts).sum())
    for k in range(0, n, _PIECE):
        # A sample is above the mean if it is above its whole part.
        above = x[k : k + _PIECE] > total // n
        crossings += int(np.count_nonzero(above[1:] != above[:-1])) + (before is not None and bool(above[0]) != before)
        before = bool(above[-1])
    bands = counts.reshape(16, 16).sum(axis=1) * 1000 // n
    spread = max(0, squares * n - total * total) ** 0.5 / n
    return f"mean={total / n:.4f};spread={spread:.4f};crossings={crossings};bands=" + ".".join(map(str, bands.tolist()))


_FEATURES = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
)


def _features() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for media in batch.column(1):
                media = media.as_py()
                payload, n_bytes = from_png(media)
                rows.append(
                    (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                )
            columns = [pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return run


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of media (doc_id, media) that were read without error."""
    return media.select("doc_id", "media").mapInArrow(_features(), f"doc_id bigint, {_FEATURES}")


def store_and_describe(docs: DataFrame) -> DataFrame:
    """Write the media archives to the shared scratch folder, read them back and describe them."""
    path = scratch.new_path(docs.sparkSession, "media")
    write_media(docs, path)
    return media_features(read_media(docs.sparkSession, path))
