"""WARC archives and a two-level capture index over them.

Records are gzip members in archive files. The index holds one line per
record under its reversed-host key, sorted, in gzip blocks; a sparse directory
of block starts lies beside each index file, and one row per index file says
where its keys begin. A look-up bisects those rows, the directory and the
block, and reads only the ranges it needs.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.storage import bounded, open_system, shared_folder
from scoreweave.session import cut_lineage

#: Payloads from this size on are written once, others that equal them revisit it.
REVISIT_BYTES = 100
#: Bytes after which an archive file ends; lines of an index block; lines of an index file, about.
ARCHIVE_BYTES, BLOCK_LINES, INDEX_LINES = 128 << 20, 1000, 2_000_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_key(url: str | None) -> str:
    """A URL's key: the host's labels from the right, then path and query; http://a.b.org/x?y gives org,b,a)/x?y."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return _clean(url or "")
    path = parts.path or "/"
    return _clean(",".join(reversed(host.split("."))) + port + ")" + path + (f"?{parts.query}" if parts.query else ""))


def _clean(text: str) -> str:
    """Controls and blanks percent-encoded, so that a value stays in its line and column."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers, payload length and payload (None for a revisit) of one record; a broken one raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(headers["content-length"])]
    if not first.startswith("WARC/") or len(body) < int(headers["content-length"]):
        raise ValueError("not a whole WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if headers["warc-type"] == "revisit":
        return headers, sizes[0], None
    return headers, len(payload), payload


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _write(folder: str):
    """Write records; one row for each once its file is closed. A retried task writes files of other names."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_system(folder)
        system.create_dir(path, recursive=True)
        out, rows, name = None, [], ""
        for batch in batches:
            for page, url, html, digest, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = _member(record(page, url, (html or "").encode(), digest, first))
                rows.append((reversed_key(url), page, name, out.tell(), len(data)))
                out.write(data)
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    yield _rows(rows)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield _rows(rows)

    return each


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "page_id", "file", "offset", "length"])


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html) and return (key, page_id, file, offset, length), written as a table.

    Of rows with equal payloads of `revisit_bytes` and more, the smallest
    page_id is a response and the others revisit it; rows without page_id and
    repeats of the smallest are responses. Null html is an empty payload, a
    null url has the key of an empty one. Other columns are not used.
    """
    html = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    large = named.where(f"bytes >= {revisit_bytes} and page_id is not null").select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = cut_lineage(firsts.where("first < last").drop("last"))
    revisits = bounded(large.join(shared, "digest").where("page_id > first").distinct())
    marked = named.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "first")
    return cut_lineage(marked.mapInArrow(_write(folder), "key string, page_id long, file string, offset long, length long"))


@dataclass
class Index:
    """An index: its folder, and of each index file the first key, in order."""

    folder: str
    files: list[str]
    first: list[str]


def _line(row: tuple) -> str:
    key, page, file, offset, length = row
    return f"{key} {'' if page is None else page} {file} {offset} {length}\n"


def _write_index(folder: str, block_lines: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_system(folder)
        out, block, starts, name = None, [], [], uuid.uuid4().hex

        def flush():
            data = _member("".join(map(_line, block)).encode())
            starts.append((block[0][0], out.tell(), len(data)))
            out.write(data)
            block.clear()

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.idx.gz", compression=None)
                block.append(row)
                if len(block) == block_lines:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with system.open_output_stream(f"{path}/{name}.dir", compression=None) as directory:
            directory.write("".join(f"{k} {at} {n}\n" for k, at, n in starts).encode())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([starts[0][0]])], ["file", "first"])

    return each


def write_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES, file_lines: int = INDEX_LINES) -> Index:
    """Sort entries by key into blocks and directories. A key with very many captures spans blocks and files.

    The driver gets one row per index file.
    """
    parts = max(1, -(-entries.count() // file_lines))
    order = ["key", "page_id", "file", "offset"]
    ranged = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = cut_lineage(ranged.mapInArrow(_write_index(folder, block_lines), "file string, first string"))
    rows = sorted(files.collect(), key=lambda r: r["first"].encode())
    return Index(folder, [r["file"] for r in rows], [r["first"] for r in rows])


class Reader:
    """Range reads with a few open files and directories kept."""

    def __init__(self, folder: str):
        self.system, self.path = open_system(folder)
        self.open = functools.lru_cache(64)(lambda name: self.system.open_input_file(f"{self.path}/{name}"))
        self.directory = functools.lru_cache(8)(self._directory)

    def _directory(self, name: str) -> tuple[list[str], list[tuple[int, int]]]:
        with self.system.open_input_file(f"{self.path}/{name}.dir") as f:
            rows = [x.split(" ") for x in f.read().decode().split("\n")[:-1]]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def member(self, name: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self.open(name).read_at(length, offset), 31)


def _candidates(starts: list[str], key: str) -> range:
    """Which of the sorted stretches with these first keys may hold a key."""
    return range(max(bisect.bisect_left(starts, key) - 1, 0), bisect.bisect_right(starts, key))


def locate(keys: DataFrame, index: Index) -> DataFrame:
    """(key, file, offset, length): index blocks that may hold each key. Bisects file starts and directories; shuffles nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index.folder)
        for batch in batches:
            out = []
            for key in sorted(batch["key"].drop_null().to_pylist()):
                for i in _candidates(index.first, key):
                    starts, places = reader.directory(index.files[i])
                    out += [(key, f"{index.files[i]}.idx.gz", *places[j]) for j in _candidates(starts, key)]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["key", "file", "offset", "length"])

    return keys.select("key").mapInArrow(each, "key string, file string, offset long, length long")


def read_captures(keys: DataFrame, index: Index, archives: str, with_payload: bool = False) -> DataFrame:
    """Records of the given distinct keys: page_id, key, payload_bytes, payload_digest, record_type, refers_to(, payload).

    A block is one unit of work however many of its lines one key has. Keys
    that are not in the index give no row. A response whose payload does not
    have its recorded digest fails the task.
    """
    blocks = locate(keys, index).groupBy("file", "offset", "length").agg(F.collect_set("key").alias("keys"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, records = Reader(index.folder), Reader(archives)
        for batch in batches:
            for row in batch.to_pylist():
                wanted, entries = set(row["keys"]), []
                for line in lines.member(row["file"], row["offset"], row["length"]).decode().split("\n")[:-1]:
                    key, page, file, offset, length = line.split(" ")
                    if key in wanted:
                        entries.append((file, int(offset), int(length), key, int(page) if page else None))
                out = []
                for file, offset, length, key, page in sorted(entries, key=lambda e: e[:2]):
                    headers, size, payload = parse_record(records.member(file, offset, length))
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload is not the one recorded")
                    out.append((page, key, size, digest, headers["warc-type"], _page(headers.get("warc-refers-to")), *[payload] * with_payload))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["page_id", "key", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
    schema = "page_id long, key string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return blocks.mapInArrow(each, schema)


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
    SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.html = f.html AND p.n >= 100
    """
)
def op1_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as archives, indexed, and read back through the index."""
    home = shared_folder(spark, "warc")
    entries = write_archives(spark.read.parquet(f"{folder}/pages.parquet"), f"{home}/archives")
    index = write_index(entries, f"{home}/index")
    return read_captures(entries.select("key").distinct(), index, f"{home}/archives").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
