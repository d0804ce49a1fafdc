"""WARC archives with revisit records and a two-level capture index.

``write`` turns pages into archives of gzip members, one per record. Of pages with equal payloads of at least
``revisit_from`` bytes, the one with the smallest page id is a response record and the others are revisit records that
refer to it; the groups are found by digest before anything is written. The capture index has a line per record under
the page's reversed-host URL key. Lines are range-sorted over the cluster; each shard of the index is one file of
compressed blocks of lines, followed by a sparse directory, the first key of every block. Reading goes by keys:
``fetch`` sorts the wanted keys, searches the shards' key ranges and then a shard's directory by bisection, and deals
the blocks found over the cluster, where each is range-read once, searched for its keys, and its records are range-read
from the archives. ``read_all`` goes through the blocks of all shards instead.

Files are written under names of their own for each attempt of a task and never again, so a task that runs twice
leaves a file that no index line names. What tasks report is checkpointed before it is used. All files lie in a folder
that the whole cluster sees, reached through pyarrow's file systems.

Defined results: a null html is an empty payload; pages of the same id and the same payload are all responses if that
id is the smallest; a null page id counts as larger than any other; a null URL is written as ``urn:x-none:``, control
characters, blanks and non-ASCII characters of URLs are percent-encoded; whole payloads of any length are kept; an
empty table gives an empty capture; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm.common import cut, fresh_path, small_or_not

NO_URL = "urn:x-none:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.UUID("6f1d1c8e-7d0b-5a52-9f5e-3c6a1f0e2b47")
SHARD_COLUMNS = "path string, first_key string, last_key string, at long, length long, n long"
RECORD_COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a Hadoop-style path and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path


def read_range(path: str, at: int, length: int) -> bytes:
    system, inner = filesystem(path)
    with system.open_input_file(inner) as file:
        return file.read_at(length, at)


def url_key(url: str) -> str:
    """Reversed host, port and path in lower case for the host: ``https://a.example.org/X?q`` gives ``org,example,a)/X?q``."""
    parts = urlsplit(url)
    if not parts.netloc:
        return url
    try:
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def written_url(url: str | None) -> str:
    return NO_URL if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- records --------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """A record and its payload digest. A revisit keeps the HTTP header, which states the full payload's length."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(IDS, str(page_id))}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(IDS, str(refers_to))}>", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its header says")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class _Files:
    """Appends to files of limited size under fresh names."""

    def __init__(self, folder: str, suffix: str, most_bytes: int):
        self.folder, self.suffix, self.most_bytes = folder, suffix, most_bytes
        self.out, self.path, self.at = None, "", 0

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.most_bytes:
            self.close()
            system, inner = filesystem(self.folder)
            system.create_dir(inner, recursive=True)
            name = f"{uuid.uuid4().hex}{self.suffix}"
            self.path, self.at = f"{self.folder}/{name}", 0
            self.out = system.open_output_stream(f"{inner}/{name}", compression=None)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.path, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


# -- writing --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Capture:
    """A written capture: its folder and the key ranges of the index shards, one row for each task that sorted lines."""

    folder: str
    shards: DataFrame


def with_originals(pages: DataFrame, revisit_from: int) -> DataFrame:
    """Pages with ``original`` (page id of the response with the same payload) and ``revisit``."""
    html = F.coalesce(F.col("html"), F.lit("")).alias("html")
    keyed = pages.select("page_id", "url", html).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    sized = keyed.where(F.octet_length("html") >= revisit_from).select("page_id", "digest")
    shared = sized.groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null")
    # ids and digests alone meet; a page joins by both, so that a payload that many pages share lies in no one place
    again = sized.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("original"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "original")
    again = small_or_not(cut(again.distinct()))
    joined = keyed.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "html", "original", F.col("original").isNotNull().alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, revisit_from: int = 0, date: str = "2000-01-01T00:00:00Z", block_lines: int = 1_000, most_bytes: int = 1 << 30) -> Capture:
    """Write archives and capture index of pages (page_id, url, html)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Files(f"{folder}/archive", ".warc.gz", most_bytes)
        for batch in batches:
            lines = []
            for page_id, url, html, original, revisit in zip(batch["page_id"], batch["url"], batch["html"], batch["original"], batch["revisit"], strict=True):
                page = None if pd.isna(page_id) else int(page_id)
                address = written_url(url)
                data, _ = record(page, address, html.encode(), int(original) if revisit else None, bool(revisit), date)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                path, at = files.append(member)
                lines.append((url_key(address), page, path.rpartition("/")[2], at, len(member)))
            yield pd.DataFrame(lines, columns=["key", "page_id", "file", "at", "length"]).astype({"page_id": "Int64"})
        files.close()

    lines = cut(with_originals(pages, revisit_from).mapInPandas(archive, "key string, page_id long, file string, at long, length long"))
    ordered = lines.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Files(f"{folder}/index", ".idx", 1 << 62)
        directory: list[tuple[str, int, int]] = []
        first, last, n, held = "", "", 0, []

        def pack() -> None:
            block = zlib.compress("\n".join(json.dumps(line) for line in held).encode())
            _, at = files.append(block)
            directory.append((held[0][0], at, len(block)))

        for batch in batches:
            for key, page_id, file, at, length in zip(batch["key"], batch["page_id"], batch["file"], batch["at"], batch["length"], strict=True):
                if not n:
                    first = key
                last, n = key, n + 1
                held.append((key, None if pd.isna(page_id) else int(page_id), file, int(at), int(length)))
                if len(held) == block_lines:
                    pack()
                    held = []
        if held:
            pack()
        if n:
            packed = zlib.compress(json.dumps(directory).encode())
            path, at = files.append(packed)
            files.close()
            yield pd.DataFrame([(path, first, last, at, len(packed), n)], columns=["path", "first_key", "last_key", "at", "length", "n"])

    return Capture(folder, cut(ordered.mapInPandas(index, SHARD_COLUMNS)))


# -- reading --------------------------------------------------------------------------------------------------------


def _directory(path: str, at: int, length: int) -> list[tuple[str, int, int]]:
    return json.loads(zlib.decompress(read_range(path, at, length)))


def _block(path: str, at: int, length: int) -> list[tuple]:
    return [json.loads(line) for line in zlib.decompress(read_range(path, at, length)).decode().split("\n")]


def _read_lines(folder: str, lines: list[tuple]) -> Iterator[tuple]:
    """Records of index lines, read file by file in the order of their offsets, with their digests checked."""
    opened, name = None, None
    for _, page_id, file, at, length in sorted(lines, key=lambda x: (x[2], x[3])):
        if file != name:
            if opened is not None:
                opened.close()
            system, inner = filesystem(f"{folder}/archive/{file}")
            opened, name = system.open_input_file(inner), file
        fields, http, payload = parse_record(opened.read_at(length, at))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["Content-Length"])):
            raise ValueError(f"a payload in {file} at {at} is not the one that was written")
        found = int(fields["Page-Id"]) if "Page-Id" in fields else None
        if found != page_id:
            raise ValueError(f"the index names page {page_id} in {file} at {at}, the record page {found}")
        refers = fields.get("Refers-To-Page-Id")
        yield found, fields["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, None if refers is None else int(refers), payload
    if opened is not None:
        opened.close()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pd.DataFrame([r[:6] for r in rows], columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_all(capture: Capture) -> DataFrame:
    """Every record that the index names, read back from the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to."""
    folder = capture.folder

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, at, length in zip(batch["path"], batch["at"], batch["length"], strict=True):
                found = _directory(path, int(at), int(length))
                yield pd.DataFrame([(path, a, n) for _, a, n in found], columns=["path", "at", "length"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, at, length in zip(batch["path"], batch["at"], batch["length"], strict=True):
                yield _frame(list(_read_lines(folder, _block(path, int(at), int(length)))))

    listed = capture.shards.select("path", "at", "length").mapInPandas(blocks, "path string, at long, length long")
    return listed.repartition(_partitions(capture), F.col("path"), F.col("at")).mapInPandas(records, RECORD_COLUMNS)


def _partitions(capture: Capture) -> int:
    """Partitions for blocks, given by number: a block is a small row that stands for much reading."""
    return int(capture.shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keys_of(urls: DataFrame) -> DataFrame:
    """The distinct index keys (column ``key``) of URLs (column ``url``)."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": [url_key(written_url(url)) for url in batch["url"]]}, dtype="object")

    return urls.select("url").distinct().mapInPandas(keys, "key string").distinct()


def blocks_of(key: str, ranges: list[tuple], lasts: list[str], directory) -> Iterator[tuple[str, int, int]]:
    """Path, place and length of the blocks that may hold a key: a bisection of the shards' ranges, given in order with
    their last keys, and one of each shard's directory."""
    s = bisect_left(lasts, key)
    while s < len(ranges) and ranges[s][0] <= key:
        _, _, path, at, length = ranges[s]
        blocks = directory(path, at, length)
        b = max(bisect_left(blocks, key, key=lambda d: d[0]) - 1, 0)
        while b < len(blocks) and blocks[b][0] <= key:
            yield path, blocks[b][1], blocks[b][2]
            b += 1
        s += 1


def fetch(capture: Capture, keys: DataFrame) -> DataFrame:
    """Records under the given keys (distinct, column ``key``), each once; columns of :func:`read_all` and ``payload``."""
    folder = capture.folder
    shards = sorted((tuple(r) for r in capture.shards.select("first_key", "last_key", "path", "at", "length").collect()), key=lambda x: x[:2])
    shared = keys.sparkSession.sparkContext.broadcast(shards)  # one row for each task that sorted lines

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = shared.value
        lasts = [x[1] for x in ranges]
        directory = lru_cache(maxsize=4)(_directory)  # keys come in order, and so do shards
        for batch in batches:
            found = [(*block, key) for key in batch["key"] for block in blocks_of(key, ranges, lasts, directory)]
            yield pd.DataFrame(found, columns=["path", "at", "length", "key"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, wanted = None, set()

        def read() -> pd.DataFrame:
            rows = list(_read_lines(folder, [line for line in _block(*block) if line[0] in wanted]))
            return _frame(rows).assign(payload=[r[6] for r in rows])

        for batch in batches:
            for path, at, length, key in zip(batch["path"], batch["at"], batch["length"], batch["key"], strict=True):
                if block != (path, at, length):
                    if block is not None:
                        yield read()
                    block, wanted = (path, int(at), int(length)), set()
                wanted.add(key)
        if block is not None:
            yield read()

    ordered = cut(keys.select("key")).repartitionByRange("key").sortWithinPartitions("key")
    asked = ordered.mapInPandas(search, "path string, at long, length long, key string")
    dealt = asked.repartition(_partitions(capture), F.col("path"), F.col("at")).sortWithinPartitions("path", "at")
    return dealt.mapInPandas(records, RECORD_COLUMNS + ", payload binary")


def lookup(spark: SparkSession, capture: Capture, urls: DataFrame) -> DataFrame:
    """Records of the captures of given URLs (column ``url``), each once; columns of :func:`fetch`."""
    return fetch(capture, keys_of(urls))
