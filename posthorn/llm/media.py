"""Media columns: payloads in archives, written and read through a Spark data source.

``store`` turns texts into greyscale images (PNG, 64 samples of 8 bits a row, lossless) and
writes them as members of archives; ``load`` reads archive directories back. Both go through
one Python data source:

* Writing: every task writes archives of its own (ZIP, members stored as they are) and an index
  beside each (Arrow, a batch for about INDEX_BYTES of archive: key, length, offset, sizes and CRC
  of its members); it reports their names and the byte ranges of the batches, and the driver's commit
  lists those of the tasks that succeeded in ``_MANIFEST.json``. What lost or repeated attempts
  leave behind is in no manifest.
* Planning: an archive is cut into byte ranges along its index batches; a partition owns the members
  whose headers begin in its range, so a directory of few large archives still feeds many tasks, and
  planning reads the manifest only.
* Reading: a partition reads its own batches of the index, reads each member by its own
  offset, checks its CRC and streams them in Arrow batches of bounded size. A read that fails
  is tried again for that member (or index) alone, on a fresh handle; a member that keeps failing becomes
  a row with an ``error`` and no media, and the rest of the archive is read on.

Paths are URIs of any file system that pyarrow opens (local or mounted folders, HDFS, S3, GCS).

A null text is an empty one; an empty payload is padded to 64 zero bytes. A null key stays null, and a
key may be of any length.
Repeated rows are separate members. An empty table gives an archive directory without members.
Other columns are not stored.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from posthorn.llm.arrow import slices, utf8
from posthorn.plans.scratch import new_path

FORMAT = "media_archive"
WIDTH = 64
LEVEL = 1
#: Bytes after which a task begins another archive, bytes of a planned range, and of archive for each batch of its index.
ARCHIVE_BYTES, SPLIT_BYTES, INDEX_BYTES = 256 << 20, 16 << 20, 4 << 20
#: Bytes of media in a batch.
BATCH_BYTES = 8 << 20
TRIES, WAIT_S = 4, 0.1
_MANIFEST = "_MANIFEST.json"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SCHEMA = "key string, n_bytes long, media binary, archive string, offset long, error string"
_ARROW = pa.schema(
    [("key", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("error", pa.string())]
)
#: A member in an archive's index. Keys may be of any length.
_INDEX = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("header_offset", pa.int64()), ("file_size", pa.int64()), ("CRC", pa.int64()), ("filename", pa.string())])


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A greyscale PNG of 8-bit samples, WIDTH a row."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a row begins with its filter, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(rows, LEVEL)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + (1 << 24)]) for i in range(0, len(packed), 1 << 24)]
    return b"".join([_SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def decode_image(media: bytes) -> np.ndarray:
    """The samples (rows, WIDTH) of an image that ``encode_image`` made."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != binascii.crc32(kind + body):
            raise ValueError(f"{kind!r} is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image of the expected width")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return rows[:, 1:]


@dataclass
class _Written(WriterCommitMessage):
    archives: list


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Member:
    """A row of an index."""

    key: str | None
    n_bytes: int
    header_offset: int
    file_size: int
    CRC: int
    filename: str


class _Archive:
    """An archive that is being written, with its index."""

    def __init__(self, fs: pafs.FileSystem, root: str, index_bytes: int) -> None:
        self.fs, self.root, self.index_bytes = fs, root, index_bytes
        self.name = f"part-{uuid.uuid4().hex}.zip"
        self.stream = fs.open_output_stream(f"{root}/{self.name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.index_stream = fs.open_output_stream(f"{root}/{self.name}.index")
        self.index = pa.ipc.new_file(self.index_stream, _INDEX)
        self.rows: list[tuple] = []
        self.ranges: list[int] = []  # where the members of each index batch begin

    def add(self, key: str | None, n: int, media: bytes) -> None:
        member = zipfile.ZipInfo(f"{len(self.zip.filelist):08d}.png")
        self.zip.writestr(member, media)
        self.rows.append((key, n, member.header_offset, member.file_size, member.CRC, member.filename))
        if self.stream.tell() >= self.rows[0][2] + self.index_bytes:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.ranges.append(self.rows[0][2])
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _INDEX.types, strict=True)], schema=_INDEX))
            self.rows = []

    def close(self) -> list:
        """What the manifest says of this archive: name, size and where the members of each index batch begin."""
        self.flush()
        for x in (self.zip, self.stream, self.index, self.index_stream):
            x.close()
        return [self.name, self.fs.get_file_info(f"{self.root}/{self.name}").size, self.ranges]


class _Writer(DataSourceArrowWriter):
    """Archives of ``key`` (string), ``n_bytes`` (long) and ``media`` (binary)."""

    def __init__(self, uri: str, overwrite: bool, archive_bytes: int, index_bytes: int) -> None:
        self.uri, self.overwrite, self.archive_bytes, self.index_bytes = uri, overwrite, archive_bytes, index_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.uri)
        fs.create_dir(root, recursive=True)
        done: list = []
        archive: _Archive | None = None
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "n_bytes", "media")]
            for i in range(batch.num_rows):
                archive = archive or _Archive(fs, root, self.index_bytes)
                archive.add(*(c[i].as_py() for c in columns))
                if archive.stream.tell() >= self.archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        return _Written(done)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.uri)
        fs.create_dir(root, recursive=True)
        where = f"{root}/{_MANIFEST}"
        old = []
        if not self.overwrite and fs.get_file_info(where).type == pafs.FileType.File:
            old = json.loads(fs.open_input_stream(where).readall())
        with fs.open_output_stream(where) as f:
            f.write(json.dumps(old + [a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _open(self.uri)
        for name, *_ in (a for m in messages if m for a in m.archives):
            fs.delete_file(f"{root}/{name}")
            fs.delete_file(f"{root}/{name}.index")


@dataclass
class ByteRange(InputPartition):
    """The members of an archive whose headers begin at ``first`` or later and before ``last``: those of ``batches`` of its index."""

    name: str
    first: int
    last: int
    batches: tuple[int, ...] = ()


def read_index(fs: pafs.FileSystem, path: str, batches: tuple[int, ...], tries: int = TRIES, wait: float = WAIT_S) -> list[Member]:
    """The members in some batches of an archive's index, in the order of the archive."""
    for n in range(tries):
        try:
            with fs.open_input_file(f"{path}.index") as f:
                index = pa.ipc.open_file(f)
                return [Member(**x) for b in batches for x in index.get_batch(b).to_pylist()]
        except Exception:  # whatever the store raises, it is tried again
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
    return []


def read_member(handle, fs: pafs.FileSystem, path: str, member: Member | zipfile.ZipInfo, tries: int = TRIES, wait: float = WAIT_S):
    """(handle, media, error) of one member, read by its offset; ``handle`` is the one to go on with."""
    error = ""
    for n in range(tries):
        try:
            if handle is None:
                handle = fs.open_input_file(path)
            size = 30 + len(member.filename.encode()) + 64 + member.file_size  # 64: room for extra fields
            raw = handle.read_at(size, member.header_offset)
            if raw[:4] != b"PK\x03\x04":
                raise ValueError("no member begins here")
            begin = 30 + sum(struct.unpack_from("<HH", raw, 26))
            if len(raw) < begin + member.file_size:
                raw = handle.read_at(begin + member.file_size, member.header_offset)
            media = raw[begin : begin + member.file_size]
            if len(media) != member.file_size or zlib.crc32(media) != member.CRC:
                raise ValueError("the member is damaged")
            return handle, media, None
        except Exception as e:  # whatever the store raises, this member is tried again
            error = f"{type(e).__name__}: {e}"
            handle = None
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None, None, error


class _Reader(DataSourceReader):
    def __init__(self, uri: str, split_bytes: int, batch_bytes: int) -> None:
        self.uri, self.split_bytes, self.batch_bytes = uri, split_bytes, batch_bytes

    def partitions(self) -> list[ByteRange]:
        fs, root = _open(self.uri)
        archives = json.loads(fs.open_input_stream(f"{root}/{_MANIFEST}").readall())
        ranges: list[ByteRange] = []
        for name, size, starts in archives:
            own: list[int] = []
            for b, end in enumerate([*starts[1:], size]):
                own.append(b)
                if end - starts[own[0]] >= self.split_bytes or b + 1 == len(starts):
                    ranges.append(ByteRange(name, starts[own[0]], end, tuple(own)))
                    own = []
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _open(self.uri)
        path = f"{root}/{partition.name}"
        handle = None  # opened, and opened again, by the read of a member
        members = read_index(fs, path, partition.batches)
        rows: list[tuple] = []
        held = 0
        for m in members:
            handle, media, error = read_member(handle, fs, path, m)
            rows.append((m.key, m.n_bytes, media, partition.name, m.header_offset, error))
            held += len(media or b"")
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(uri)`` and ``df.write.format("media_archive").save(uri)``.

    Options: ``archive_bytes`` and ``index_bytes`` (writing), ``split_bytes`` and ``batch_bytes`` (reading).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), int(self.options.get("batch_bytes", BATCH_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, *(int(self.options.get(k, v)) for k, v in (("archive_bytes", ARCHIVE_BYTES), ("index_bytes", INDEX_BYTES))))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = utf8(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode_image(pad(t)) for t in texts], pa.binary())],
            ["key", "n_bytes", "media"],
        )


def store(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text", **options) -> None:
    """Write the texts of ``docs`` as images into archives below ``uri``."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    picked = docs.select(docs[key].cast("string").alias("key"), docs[text].cast("string").alias("text"))
    media = picked.mapInArrow(_encode, "key string, n_bytes long, media binary")
    media.write.format(FORMAT).options(**options).mode("append").save(uri)


def load(spark: SparkSession, uri: str, **options) -> DataFrame:
    """The members of the archives below ``uri``: key, n_bytes, media, archive, offset, error."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format(FORMAT).options(**options).load(uri)


def describe(samples: np.ndarray) -> str:
    """mean, deviation and horizontal change of the samples, and which columns are brighter than the mean.

    Computed from integers, so equal samples give equal texts everywhere.
    """
    n = samples.size
    seen = np.bincount(samples.ravel(), minlength=256)
    total = int(seen @ np.arange(256))
    square = int(seen @ np.arange(256) ** 2)
    change = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum(dtype=np.int64))
    column = samples.sum(axis=0, dtype=np.int64)
    bits = int("".join("1" if c * WIDTH > total else "0" for c in column.tolist()), 2)
    return f"mean={total * 1000 // n},var={(square * n - total * total) // (n * n)},change={change * 1000 // n},columns={bits:016x}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for media in batch.column(2).to_pylist():
            samples = decode_image(media)
            payload = samples.tobytes()
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples),
            ))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def features(members: DataFrame) -> DataFrame:
    """Digests and the feature of each member's payload; a member that could not be read ends the query."""
    whole = F.when(F.col("error").isNull(), F.col("media")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("media member"), "archive", "offset", "error")).cast("binary")
    )
    return members.select("key", "n_bytes", whole.alias("media")).mapInArrow(
        _features,
        "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the texts of ``docs`` in the shared folder, read them back and describe them."""
    spark = docs.sparkSession
    uri = new_path(spark, "media")
    store(docs, uri, key, text)
    found = features(load(spark, uri))
    return found.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *found.columns[1:])
