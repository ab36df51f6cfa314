"""Media columns: archives of members in the shared folder, read by a Spark data source.

Archives are tar files; beside each lies an index of its members' offsets. A file is written under a
temporary name and renamed when complete, with the task attempt's own mark in its name. A manifest, a
table beside the archives, lists those of the attempts that succeeded; no others are ever read, so a
task that runs again, over rows in whatever order, leaves nothing behind that counts. The data source
``media_archive`` plans partitions as byte ranges over the archives of the manifest: a member belongs
to the range its header begins in, and an index must hold as many members as the manifest says.
A reader streams members in Arrow batches of bounded size. A member that can't be read is tried
again by its own offset, through a newly opened file; the rest of the range isn't read again.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred.llm.common import session_of, table, text_or_empty, work_dir

#: Payloads are padded to a multiple of so many bytes: the width of the stored image.
UNIT = 64
#: Bytes of archives that a partition reads.
RANGE_BYTES = 32 << 20
#: An archive is closed at this size.
ROLL_BYTES = 128 << 20
#: A batch holds members up to about so many bytes of payload.
BATCH_BYTES = 4 << 20
#: Attempts to read one member.
TRIES = 4
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = "archive string, bytes long, members long"
INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])
READ = "doc_id long, n_bytes long, archive string, offset long, media binary"


def payload_of(text: str) -> tuple[int, bytes]:
    """The number of bytes, and these filled up with zeros to a positive multiple of the unit."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, ``UNIT`` samples wide, without filters."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; anything else raises ValueError."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, held, shape = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            held.append(data)
        at += 12 + n
    if not shape or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    rows = np.frombuffer(zlib.decompress(b"".join(held)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def check_png(media: bytes) -> None:
    """Raises ValueError or struct.error unless all chunks are there with their checksums; nothing is decompressed."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + n
    if kind != b"IEND":
        raise ValueError("no end")


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and the share of equal neighbours of the samples, in thousandths."""
    data = np.frombuffer(payload, np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / len(data)
    mean = float(counts @ np.arange(256)) / len(data)
    spread = max(0.0, float(counts @ np.arange(256) ** 2) / len(data) - mean**2) ** 0.5
    numbers = (mean, spread, max(0.0, float(-(share * np.log2(share)).sum())), int(np.count_nonzero(data[1:] == data[:-1])) / max(1, len(data) - 1))
    return ",".join(f"{name}={round(1000 * x)}" for name, x in zip(("mean", "spread", "entropy", "flat"), numbers, strict=True))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class Archive:
    """A tar file and its index, both under temporary names until ``close``."""

    def __init__(self, folder: str, stem: str) -> None:
        self.store, root = opened(folder)
        self.final, self.temporary = f"{root}/{stem}.tar", f"{root}/.{stem}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.at, self.rows = 0, []

    def add(self, name: str, key: int | None, n: int, media: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(media)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head)
        self.out.write(media)
        self.out.write(bytes(-len(media) % 512))
        self.rows.append((key, n, self.at, len(media)))
        self.at += len(head) + len(media) + -len(media) % 512

    def close(self) -> tuple[str, int, int]:
        self.out.write(bytes(1024))
        self.out.close()
        rows = pa.table([pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), INDEX.types, strict=True)], schema=INDEX)
        pq.write_table(rows, f"{self.temporary}.idx", filesystem=self.store)
        self.store.move(f"{self.temporary}.idx", f"{self.final}.idx")
        self.store.move(self.temporary, self.final)  # last: an archive that is listed has its index
        return os.path.basename(self.final), self.at, len(self.rows)


class Incomplete(RuntimeError):
    """The archives hold another number of members than the table has rows."""


def write_archives(docs: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store every row's text as a member of an archive below the folder, without a shuffle, and the manifest of the archives.

    The folder may be used already: its manifest is replaced, and archives that aren't in it are
    ignored. Raises ``Incomplete`` unless there are as many members as rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, now, done, mark = TaskContext.get().partitionId(), 0, None, [], uuid.uuid4().hex[:12]
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = now or Archive(folder, f"part-{part:06d}-{len(done):05d}-{mark}")
                size, payload = payload_of(value.as_py())
                now.add(f"{n:09d}.png", key, size, to_png(payload))
                n += 1
                if now.at >= roll_bytes:
                    done, now = [*done, now.close()], None
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_pydict({"archive": pa.array([x[0] for x in done], pa.string()), "bytes": pa.array([x[1] for x in done], pa.int64()), "members": pa.array([x[2] for x in done], pa.int64())})

    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    stored = session_of(docs).read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    if stored != (wanted := docs.select(id_col).count()):
        raise Incomplete(f"{stored} members of {wanted} rows")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int, members: int) -> None:
        self.archive, self.start, self.end, self.members = archive, start, end, members


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", 0.2))

    def partitions(self) -> list[InputPartition]:
        """The manifest only is read here; no archive is opened."""
        store, root = opened(self.folder)
        files = [x.path for x in store.get_file_info(fs.FileSelector(f"{root}/manifest")) if x.base_name.endswith(".parquet")]
        rows = [r for path in files for r in pq.read_table(path, filesystem=store).to_pylist()]
        found = sorted((r["archive"], r["bytes"], r["members"]) for r in rows)
        return [ByteRange(name, at, min(at + self.range_bytes, size), n) for name, size, n in found for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0, 0)]

    def member(self, store: fs.FileSystem, path: str, held: list, offset: int, size: int) -> bytes:
        """The member whose header begins there. ``held`` keeps the open file; it's opened anew after a failure."""
        for left in range(self.tries - 1, -1, -1):
            try:
                if not held:
                    held.append(store.open_input_file(path))
                held[0].seek(offset)
                data = held[0].read(512 + size)
                head = tarfile.TarInfo.frombuf(data[:512], "utf-8", "surrogateescape")
                if len(data) != 512 + size or head.size != size:
                    raise OSError(f"short read at {offset}")
                check_png(data[512:])
                return data[512:]
            except (OSError, ValueError, struct.error, zlib.error, tarfile.HeaderError):
                if held:
                    held.pop().close()
                if not left:
                    raise
                time.sleep(self.wait)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = opened(self.folder)
        path = f"{root}/{partition.archive}"
        if (n := pq.read_metadata(f"{path}.idx", filesystem=store).num_rows) != partition.members:
            raise Incomplete(f"{partition.archive}: {n} members of {partition.members}")
        index = pq.read_table(f"{path}.idx", filesystem=store, filters=[("offset", ">=", partition.start), ("offset", "<", partition.end)])
        held, out, size = [], [], 0
        names, types = [x.split()[0] for x in READ.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for key, n, offset, length in zip(*(index.column(c).to_pylist() for c in INDEX.names), strict=True):
            out.append((key, n, partition.archive, offset, self.member(store, path, held, offset, length)))
            size += n
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangebytes, tries, wait."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give, decoded again: the columns of ``FEATURES``."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stored = value.as_py()
                payload = from_png(stored)
                out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            if out:
                kinds = {"long": pa.int64(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*out, strict=True), FEATURES.split(", "), strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(see, FEATURES)


def media_features(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the documents' archives, read them back and return a row for each document.

    A null text counts as empty, and an empty payload is one unit of zeros. Null ids and repeated
    rows are members of their own; equal texts give equal values. Other columns are ignored; no rows
    give no rows. A text of any length is one member; it is held by one task, a few times over. A
    member that stays unreadable raises: rows are never left out.
    """
    spark = session_of(docs)
    folder = folder or work_dir(spark, "media")
    write_archives(docs, folder)
    spark.dataSource.register(MediaArchives)
    return features(spark.read.format("media_archive").load(folder))


def op5_media(spark, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
