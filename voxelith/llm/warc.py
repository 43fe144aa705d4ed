"""WARC archives with a two-level capture index.

Writing: every page becomes one WARC/1.1 record, a gzip member of its own, in one archive
for each task. Of records with equal payloads of at least REVISIT_BYTES, the one with the
largest page_id is a response; the others are revisits that name it and carry no payload.
Captures are sorted by reversed-host URL keys and written as blocks of gzip-compressed
lines; a sparse directory holds the first key and place of each block.

Reading: a lookup searches the directory by bisection, reads one range of the index, searches
the block by bisection and reads one range of an archive. A full read goes the same way from
directory to blocks to ranges, one task for each of many blocks, and resolves revisits by
joining them to their responses.

Files appear under their final name by an atomic rename. A name holds the task's attempt, so
a task that runs twice, or twice at once, never changes a file that an index row names.
They lie under the shared folder and are reached by pyarrow's file systems.

Null html is an empty payload, a null URL an empty one. A null page_id counts as the
smallest. Repeated rows are records of their own; rows that repeat the largest page_id of
their payload are all responses. Payloads may be of any size and hold any character. An
empty table gives an index without blocks. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import materialize, partitions_for, shared_dir, table

#: Payloads of fewer bytes are always responses.
REVISIT_BYTES = 1000
#: Index lines in a compressed block.
BLOCK_LINES = 1000
#: Bytes of html that a task takes from Arrow at a time.
BATCH_ROWS = 256
LEVEL = 6
#: All records bear one date, so that a rewrite gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
STAMP = "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The reversed-host key: com,example,blog)/path?query."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + text
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(text: str | None) -> str:
    """A header value: no line ends, no characters a header can't hold."""
    return "".join(c if " " <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, block.partition(b"\r\n\r\n")[2]


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class _Writer:
    """A file that appears under its name when closed whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _store(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.final)


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


@dataclass(frozen=True)
class Archive:
    """Where archives and index lie, and the sparse directory: one row for each block."""

    folder: str
    directory: DataFrame


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns a capture for each record: key, page_id, url, file, offset, length."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    groups = (
        rows.where(F.length("body") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head")
    )
    joined = rows.join(groups, "digest", "left").select("page_id", "url", "body", "digest", "head")
    arrow = pa.schema(
        [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
         ("length", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        name = f"part-{_attempt()}.warc.gz"
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                out = []
                part = batch.slice(i, BATCH_ROWS)
                for page_id, url, body, digest, head in zip(*[part.column(c) for c in range(5)], strict=True):
                    page_id, url, head = page_id.as_py(), url.as_py(), head.as_py()
                    revisit = head is not None and page_id != head
                    data = record(page_id, url, body.as_py(), bytes.fromhex(digest.as_py()), head, revisit)
                    writer = writer or _Writer(folder, name)
                    offset, length = writer.add(gzip.compress(data, LEVEL, mtime=0))
                    out.append((surt(url), page_id, url, name, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if writer:
            writer.close()

    return joined.mapInArrow(run, "key string, page_id long, url string, file string, offset long, length long")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts the captures by key into compressed blocks; returns the directory: first_key, last_key,
    file, offset, length, lines."""
    n = partitions_for(captures.sparkSession)
    keyed = captures.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    line = F.concat_ws(
        " ", F.regexp_replace(F.encode("key", "utf-8").cast("string"), "[ \\n]", "%20"), F.lit(STAMP), "page", "file",
        F.col("offset").cast("string"), F.col("length").cast("string"),
    )
    lines = keyed.select(line.cast("binary").alias("line"))
    ordered = lines.repartitionByRange(n, "line").sortWithinPartitions("line")
    arrow = pa.schema(
        [("first_key", pa.binary()), ("last_key", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
         ("length", pa.int64()), ("lines", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held, out = None, [], []
        name = f"index-{_attempt()}.cdx.gz"

        def flush() -> None:
            offset, length = writer.add(gzip.compress(b"\n".join(held) + b"\n", LEVEL, mtime=0))
            out.append((held[0].split(b" ")[0], held[-1].split(b" ")[0], name, offset, length, len(held)))
            held.clear()

        for batch in batches:
            for value in batch.column(0).to_pylist():
                writer = writer or _Writer(folder, name)
                held.append(value)
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    schema = "first_key binary, last_key binary, file string, offset long, length long, lines long"
    return materialize(ordered.mapInArrow(run, schema), "warc-directory")


def write(pages: DataFrame, folder: str | None = None) -> Archive:
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = materialize(write_archives(pages, folder), "warc-captures")
    return Archive(folder, write_index(captures, folder))


class RangeReader:
    """Reads byte ranges of files in a folder, with the last file held open."""

    def __init__(self, folder: str):
        self.fs, self.root = _store(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)

    def member(self, name: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self.read(name, offset, length), 31)


class Lookup:
    """Finds captures by URL: bisection over the directory, then inside one block.

    The directory is sparse, one row for each BLOCK_LINES captures. A directory too large for
    one process is split by key range like any sorted table; read_all never gathers it.
    """

    def __init__(self, archive: Archive):
        rows = archive.directory.select("first_key", "last_key", "file", "offset", "length").orderBy("first_key", "file", "offset").collect()
        self.blocks = [tuple(r) for r in rows]
        self.firsts = [bytes(b[0]) for b in self.blocks]
        self.reader = RangeReader(archive.folder)

    def captures(self, url: str) -> list[tuple[str, int, int]]:
        key = surt(url).replace(" ", "%20").replace("\n", "%20").encode()
        found = []
        # The key may start in the block before the first whose first key is at least as large.
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.blocks) and self.firsts[at] <= key:
            _, last, name, offset, length = self.blocks[at]
            if bytes(last) >= key:
                lines = self.reader.member(name, offset, length).split(b"\n")[:-1]
                for line in lines[bisect.bisect_left(lines, key + b" ") :]:
                    parts = line.split(b" ")
                    if parts[0] != key:
                        break
                    found.append((parts[3].decode(), int(parts[4]), int(parts[5])))
            at += 1
        return found

    def payloads(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        return [parse_record(self.reader.member(*c)) for c in self.captures(url)]


def read_all(archive: Archive) -> DataFrame:
    """Every record by way of the index: page_id, record_type, refers_to, payload_bytes, payload_digest.

    A revisit's payload figures come from the record that it refers to.
    """
    folder = archive.folder
    n = partitions_for(archive.directory.sparkSession)
    place = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            for name, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                lines = [x.split(b" ") for x in reader.member(name, offset, length).split(b"\n")[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[3].decode() for x in lines]), pa.array([int(x[4]) for x in lines]), pa.array([int(x[5]) for x in lines])],
                    schema=place,
                )

    spread = archive.directory.select("file", "offset", "length").repartition(n, "file", "offset")
    places = spread.mapInArrow(blocks, "file string, offset long, length long")
    # Ranges go back to the order of the archives, some megabytes of one file to a task.
    near = places.withColumn("stretch", F.shiftright("offset", 22)).repartition(n, "file", "stretch").sortWithinPartitions("file", "offset")
    arrow = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string())]
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            out = []
            for name, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                headers, payload = parse_record(reader.member(name, offset, length))
                page = int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None
                digest = hashlib.sha1(payload).hexdigest()
                named = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if headers["WARC-Type"] == "revisit":
                    out.append((page, "revisit", int(headers["X-Refers-To-Page"]), None, named))
                else:
                    if digest != named:
                        raise ValueError(f"the payload of page {page} does not have its digest")
                    out.append((page, "response", None, len(payload), digest))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    read = near.select("file", "offset", "length").mapInArrow(
        records, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    )
    read = materialize(read, "warc-records")
    # Only responses that some revisit names take part, each once; the digest is compared too.
    heads = (
        read.where("record_type = 'response'").join(read.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct(), "page_id")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("head_bytes"))
    )
    return read.join(heads, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "head_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_all(write(table(spark, sf_dir, "pages")))


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY d) AS head FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> head THEN head END AS refers_to
FROM g
"""
