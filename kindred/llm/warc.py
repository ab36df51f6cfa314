"""A deterministic sharded WARC writer, and a reader by byte ranges.

Pages are placed by ranges of page_id (bounds depend on the rows only; an id that many rows have is
spread by their digests), sorted, and each range is written by one task into files that roll at a
compressed size and begin with a warcinfo record. A file is written under a temporary
name and renamed when complete; a manifest, a table in the shared folder, lists the finished files,
and readers open no others. A task that runs again writes the same bytes under the same names.

Equal payloads: the first of them is found by an aggregation over digests, and only the revisits
(not the html) meet it again. Those few rows travel with the pages, sorted just before the page they
concern, so that the html is shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize, partitions_of, ranges, session_of, table, work_dir

#: Payloads of fewer bytes are always stored.
LEAST = 100
#: A file is closed when its compressed records reach this size.
ROLL_BYTES = 32 << 20
#: The records' date, fixed so that archives are the same in every run.
DATE = "2020-01-01T00:00:00Z"
#: Groups of equal payloads above this share of the rows are joined by broadcast; there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, bytes long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, file string, offset long, length long"


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, refers_to, refers_url of each page whose payload a page with a smaller id has."""
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = pages.where(F.col("size") >= least).groupBy("digest", "size").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = materialize(groups.select("digest", "size", "n", F.col("first.page_id").alias("first"), F.col("first.url").alias("refers_url")), "warc-groups")
    most = max(1, int(pages.count() * HOT_SHARE))
    hot, cold = groups.where(F.col("n") > most), groups.where(F.col("n") <= most)
    rows = pages.where(F.col("size") >= least)
    by_hot = rows.join(F.broadcast(hot), ["digest", "size"])
    rest = rows.join(F.broadcast(hot.select("digest", "size")), ["digest", "size"], "left_anti")
    found = by_hot.unionByName(rest.join(cold, ["digest", "size"]))
    return found.where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))).select("page_id", "digest", F.col("first").alias("refers_to"), "refers_url").distinct()


def head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def one_line(url: str | None) -> str:
    """A URL as a header can hold it; percent signs are escaped so that it can be read back."""
    return "".join(c if " " < c != "%" and c not in "\x7f\x85  " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url) if url is not None else "-"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None, nth: int = 0) -> bytes:
    """One response or revisit record, as bytes; ids follow from the content, and from ``nth`` for rows that are equal."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    if refers_to is None:
        block += payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, url, digest, nth)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("X-Page-ID", "-" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url, digest, 0)), ("WARC-Refers-To-Target-URI", one_line(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return head(fields) + block + b"\r\n\r\n"


def file_record(name: str) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"software: kindred\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    return head([*fields, ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member without a time stamp, so that equal records give equal bytes."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class Roll:
    """Files of one range, each under a temporary name until it is whole."""

    def __init__(self, folder: str, stem: str, limit: int) -> None:
        self.store, self.folder = opened(folder)
        self.stem, self.limit, self.n, self.out, self.done = stem, limit, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.folder}/.{self.stem}-{self.n:05d}.{uuid.uuid4().hex}.open"
            self.out, self.records = self.store.open_output_stream(self.temporary, compression=None), 0
            first = gzip_member(file_record(self.name()))
            self.out.write(first)
            self.bytes = len(first)
        self.out.write(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1
        if self.bytes >= self.limit:
            self.close()

    def name(self) -> str:
        return f"{self.stem}-{self.n:05d}.warc.gz"

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = self.name()
        self.store.move(self.temporary, f"{self.folder}/{name}")
        self.done.append((name, self.bytes, self.records))
        self.n, self.out = self.n + 1, None


def writer(folder: str, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls: Roll | None = None
        part, mark, last, nth, done = None, None, None, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                pid, page_id, digest, kind, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                if pid != part:
                    if rolls:
                        rolls.close()
                        done += rolls.done
                    rolls, part = Roll(folder, f"part-{pid:06d}", limit), pid
                if kind == 0:
                    mark = (page_id, digest, refers_to, batch.column(5)[i].as_py())
                    continue
                url, html = batch.column(5)[i].as_py(), batch.column(6)[i].as_py()
                first = mark[2:] if mark and mark[:2] == (page_id, digest) else (None, None)
                nth = nth + 1 if last == (page_id, url, digest) else 0
                last = (page_id, url, digest)
                rolls.add(gzip_member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, *first, nth)))
        if rolls:
            rolls.close()
            done += rolls.done
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in done], "bytes": [x[1] for x in done], "records": [x[2] for x in done]}, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return write


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for every page below the folder; returns the manifest (file, bytes, records).

    page_id long, url, html; other columns are ignored. A null html is an empty payload. Pages with
    a null id come first and are always the later ones in a group. Of repeated rows with the
    smallest id each is a response. A page of any length is one record, held by one task. No pages
    give an empty manifest.
    """
    spark = session_of(pages)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    slim = materialize(rows.select("page_id", "url", "digest", F.col("size").cast("long").alias("size")), "warc-digests")
    cut = ranges(slim.select("page_id"), "page_id", partitions_of(spark), nulls_first=True)
    pid = cut.pid(F.col("page_id"), F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / F.lit(16.0**13))
    marks = revisits(slim, least).select(pid.alias("pid"), "page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.col("refers_url").alias("url"), F.lit(None).cast("string").alias("html"))
    full = rows.select(pid.alias("pid"), "page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    dealt = marks.unionByName(full).repartitionById(cut.count, F.col("pid").cast("int")).sortWithinPartitions("pid", "page_id", "digest", "kind", "url")
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    dealt.mapInArrow(writer(folder, roll_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class BadRecord(ValueError):
    """A record whose digests or lengths don't hold."""


def members(stream, size: int) -> Iterator[tuple[int, int, bytes]]:
    """offset, compressed length and content of each gzip member, read in blocks."""
    at, start, buffer, parts = 0, 0, b"", []
    unpack = zlib.decompressobj(31)
    while True:
        if not buffer:
            buffer = stream.read(1 << 20)
            if not buffer:
                break
            at += len(buffer)
        parts.append(unpack.decompress(buffer))
        if unpack.eof:
            buffer = unpack.unused_data
            yield start, at - len(buffer) - start, b"".join(parts)
            start, parts, unpack = at - len(buffer), [], zlib.decompressobj(31)
        else:
            buffer = b""
    if parts and any(parts) or at != size:
        raise BadRecord(f"cut off at byte {start}")


def parsed(data: bytes, with_html: bool) -> tuple | None:
    """The columns of ``RECORD`` that a record tells; None for a warcinfo record."""
    end = data.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    block = memoryview(data)[end + 4 : end + 4 + int(fields["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise BadRecord(f"block digest of {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "warcinfo":
        return None
    cut = bytes(block[:400]).index(b"\r\n\r\n") + 4
    length = int(bytes(block[:cut]).split(b"Content-Length: ")[1].split(b"\r\n")[0])
    payload = block[cut:]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise BadRecord(f"payload of {fields['WARC-Record-ID']}")
    number = lambda x: None if x in (None, "-") else int(x)
    url = fields["WARC-Target-URI"]
    if url != "-":
        from urllib.parse import unquote

        url = unquote(url, errors="surrogatepass")
    html = bytes(payload).decode("utf-8", "surrogatepass") if with_html and fields["WARC-Type"] == "response" else None
    return number(fields["X-Page-ID"]), None if url == "-" else url, length, digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID")), html


def read_archives(manifest: DataFrame, folder: str, with_html: bool = True) -> DataFrame:
    """A row for every record of the files in the manifest; digests are verified, a bad record raises ``BadRecord``."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, length, data in members(stream, size):
                        if (told := parsed(data, with_html)) is None:
                            continue
                        rows.append((*told, name, offset, length))
                        held += len(data) if with_html else 200
                        if held > 4 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)

    files = manifest.select("file", "bytes")
    # one row a file; each file goes to a task of its own as far as there are partitions
    return files.repartition(partitions_of(session_of(manifest)), "file").mapInArrow(read, RECORD)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, with_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM g
"""
