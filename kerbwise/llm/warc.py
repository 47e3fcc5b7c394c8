"""WARC archives with revisit records, and a two-level capture index over them.

Every task writes one archive: a gzip member for each page. Of the pages with equal payloads (of at least
``min_bytes``) the one with the largest id is the response and the others revisit it. The
captures are sorted by reversed-host URL key into index files of compressed blocks; beside each index file stands its
sparse directory with the first key, offset and length of every block. A lookup finds the
file by binary search over the files' first keys, the block by binary search in the file's directory, range-reads
the block, and range-reads the records it names. Reading all captures back goes the same way, block by block.

Folders are reached with ``pyarrow.fs``, so they may lie in any store it knows; a file is written under a name of its attempt and
then moved, so a task that is run again replaces its own file with an equal one.

A null html is an empty payload and a null URL an empty one. Rows that repeat the response's id are responses too.
Pages without id revisit the response of their payload, or are responses if none of them has an id. An empty table
has no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import urllib.parse
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.session import new_path, written

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 1000
CAPTURES = "key string, file string, offset long, length long"
INDEX_FILES = "name string, first_key string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str) -> str:
    """Host labels in reverse, comma-joined, then path and query: ``com,example)/a?b``."""
    rest = url.partition("://")[2] or url
    host, cut, tail = re.match(r"([^/?#]*)([/?]?)([^#]*)", rest, re.DOTALL).groups()
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + (cut or "/") + tail


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Replacing:
    """A file written under a name of this attempt and moved to its own at the end."""

    def __init__(self, folder: str, name: str):
        self.store, path = _store(folder)
        self.store.create_dir(path)
        self.final = f"{path}/{name}"
        self.draft = f"{path}/_draft-{TaskContext.get().taskAttemptId()}-{name}"
        self.stream, self.size = self.store.open_output_stream(self.draft, compression=None), 0

    def write(self, data: bytes) -> int:
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.draft, self.final)


def record(page_id: int | None, url: str, payload: bytes, response: int | None) -> bytes:
    """One WARC record; ``response`` is the page that a revisit refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if response is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {urllib.parse.quote(url, safe=_PRINTABLE)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if response is not None:
        head[4:4] = [
            f"WARC-Refers-To: <urn:page:{response}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What a header line may hold as it is; all else, the percent sign too, is percent-encoded.
_PRINTABLE = "".join(map(chr, [*range(0x21, 0x25), *range(0x26, 0x7F)]))


def parsed(data: bytes) -> tuple:
    """The row of a record; a response whose payload does not have the stated digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(name: str) -> int | None:
        found = fields.get(name, "")[len("<urn:page:"):-1]
        return int(found) if found else None

    url = urllib.parse.unquote(fields["WARC-Target-URI"])
    return page("WARC-Record-ID"), url, size, digest, fields["WARC-Type"], page("WARC-Refers-To"), None if revisit else payload


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        out = None
        for batch in batches:
            rows = []
            for page_id, url, html, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response"))):
                out = out or _Replacing(folder, name)
                member = gzip.compress(record(page_id, url or "", (html or "").encode(), response), 6, mtime=0)
                rows.append((url_key(url or ""), name, out.write(member), len(member)))
            if rows:
                key, file, offset, length = zip(*rows)
                yield pa.record_batch({"key": pa.array(key), "file": pa.array(file), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})
        if out:
            out.close()

    return run


def _index(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{TaskContext.get().partitionId():06d}"
        out, directory, lines, first = None, [], [], None

        def block() -> None:
            data = gzip.compress("".join(line for _, line in lines).encode(), 6, mtime=0)
            directory.append(f"{lines[0][0]}\t{out.write(data)}\t{len(data)}\n")
            lines.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                shown = _shown(key)
                out = out or _Replacing(folder, f"{name}.gz")
                first = shown if first is None else first
                lines.append((shown, f"{shown}\t{file}\t{offset}\t{length}\n"))
                if len(lines) == block_lines:
                    block()
        if out:
            if lines:
                block()
            out.close()
            sparse = _Replacing(folder, f"{name}.directory")
            sparse.write("".join(directory).encode())
            sparse.close()
            yield pa.record_batch({"name": pa.array([name]), "first_key": pa.array([first])})

    return run


def _shown(key: str) -> str:
    """A key as it stands in index lines: white space and percent signs percent-encoded, in byte order."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write archives and index under ``folder``; returns the index files, ``(name, first_key)``."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("sha1"))
    large = rows.where(F.octet_length(html) >= min_bytes)
    repeated = written(
        large.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha1", "last"),
        "repeated",
    )
    joined = rows.join(repeated, "sha1", "left")
    same = F.col("page_id").eqNullSafe(F.col("last")) | (F.octet_length(html) < min_bytes)
    captures = written(
        joined.select("page_id", "url", "html", F.when(~same, F.col("last")).alias("response")).mapInArrow(
            _archive(f"{folder}/archive"), CAPTURES
        ),
        "captures",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "file", "offset"]
    return written(
        captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_index(f"{folder}/index", block_lines), INDEX_FILES),
        "index-files",
    )


@lru_cache(maxsize=64)
def _directory(folder: str, name: str) -> tuple[list[str], list[tuple[int, int]]]:
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/index/{name}.directory", compression=None) as f:
        rows = [line.split("\t") for line in f.read().decode().split("\n")[:-1]]
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


class _Reader:
    """Range reads under a folder; keeps the last few files open."""

    def __init__(self, folder: str):
        self.store, self.path = _store(folder)
        self.files: dict[str, object] = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 16:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.path}/{name}")
        return gzip.decompress(self.files[name].read_at(length, offset))

    def lines(self, name: str, offset: int, length: int) -> list[list[str]]:
        return [line.split("\t") for line in self.read(f"index/{name}.gz", offset, length).decode().split("\n")[:-1]]

    def records(self, lines: list[list[str]]) -> Iterator[tuple]:
        for _, file, offset, length in sorted(lines, key=lambda x: (x[1], int(x[2]))):
            yield parsed(self.read(f"archive/{file}", int(offset), int(length)))


_RECORD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.record_batch({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows) if rows else [()] * 7, _RECORD_TYPES)})


def read(index_files: DataFrame, folder: str) -> DataFrame:
    """Every record, through the index: each block is range-read, then the records it names."""

    def blocks(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                _, places = _directory(folder, name)
                yield pa.record_batch(
                    {"name": pa.array([name] * len(places)), **{c: pa.array([p[i] for p in places], pa.int64()) for i, c in enumerate(("at", "size"))}}
                )

    def run(batches):
        reader = _Reader(folder)
        for batch in batches:
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "size"))):
                yield _record_batch(list(reader.records(reader.lines(name, at, size))))

    parts = int(index_files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index_files.mapInArrow(blocks, "name string, at long, size long").repartition(parts).mapInArrow(run, RECORDS)


def lookup(index_files: DataFrame, folder: str, urls: DataFrame) -> DataFrame:
    """The records of the given URLs (column ``url``), each with the URL asked for under ``asked``.

    The driver holds one key for each index file.
    """
    files = sorted((key, name) for name, key in index_files.collect())

    def run(batches):
        reader = _Reader(folder)
        for batch in batches:
            for url in batch.column("url").to_pylist():
                key, rows = _shown(url_key(url or "")), []
                at = max(bisect_right([k for k, _ in files], key) - 1, 0)
                # Captures of one key may begin at the end of earlier blocks and files.
                while at > 0 and files[at][0] == key:
                    at -= 1
                for first, name in files[at:]:
                    if first > key:
                        break
                    keys, places = _directory(folder, name)
                    i = max(bisect_right(keys, key) - 1, 0)
                    while i > 0 and keys[i] == key:
                        i -= 1
                    for k, place in zip(keys[i:], places[i:]):
                        if k > key:
                            break
                        rows += reader.records([x for x in reader.lines(name, *place) if x[0] == key])
                out = _record_batch(rows)
                yield out.append_column("asked", pa.array([url] * len(rows), pa.string()))

    return urls.select("url").distinct().mapInArrow(run, RECORDS + ", asked string")


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives and read every record back through the index."""
    folder = new_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    return read(write(pages, folder, min_bytes), folder)
