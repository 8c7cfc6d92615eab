"""WARC archives with a two-level capture index (operator 7).

Every page is one gzip member in an archive. The index has a line per capture, sorted by the reversed-host
key of its URL, in compressed blocks; a sparse directory has the first key of each block. A lookup searches
the directory, then one block, and reads single ranges of the archives.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Files, Scratch, partitions

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: str | None) -> str:
    """``https://m.a.example.com/x?q`` becomes ``com,example,a,m)/x?q``; what isn't a URL stays, in lower case."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").rstrip(".")
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        host = ""
    if not host:
        return (url or "").strip().lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the response's headers, its length and digest, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"Quern-Page-ID: {'' if page_id is None else page_id}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"Quern-Refers-To-Page-ID: {'' if revisit_of is None else revisit_of}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """A record's headers, in lower case, with ``payload`` and the length that its HTTP headers state."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(out["content-length"])].partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return out | {"payload": payload, "stated": stated}


def keepers(pages: DataFrame, least: int = 1000, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """digest, bytes, keeper of every payload of at least ``least`` bytes that occurs more than once, from narrow columns alone.

    Of equal payloads (length and SHA-1) the largest page_id is the response. It is found with sums before the
    shuffle, so a payload that a third of all pages share is a row for each task.
    """
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("bytes"))
    groups = narrow.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    return groups.filter("copies > 1").drop("copies")


def write(pages: DataFrame, to: str, groups: DataFrame, archive_bytes: int = 64 << 20, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per page and returns the captures: key, page_id, name, offset, size.

    ``groups`` are those of :func:`keepers`, one row for each repeated payload. While they are few, Spark sends them
    to all tasks and no payload is shuffled; else the pages meet them in a join whose large partitions Spark splits.
    Null html is empty, a null url ``about:blank``. A repeated task writes the same names anew.
    """
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.length("payload").cast("long")}).join(groups, ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    rows = rows.select("page_id", "url", "payload", "digest", revisit.alias("is_revisit"), F.when(revisit, F.col("keeper")).alias("refers_to"))

    def run(batches):
        files, part, n = Files(to), TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        lines: list[tuple] = []
        at = 0

        def close():
            nonlocal n, at
            name = f"pages-{part:06d}-{n:06d}.warc.gz"
            files.write(name, parts)
            cols = list(zip(*lines, strict=True))
            got = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array([name] * len(lines), pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["key", "page_id", "name", "offset", "size"])
            n, at = n + 1, 0
            parts.clear()
            lines.clear()
            return got

        for b in batches:
            for i, u, p, d, again, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                member = record(i, u, p, d, of, again)
                lines.append((reversed_host_key(u), i, at, len(member)))
                parts.append(member)
                at += len(member)
                if at >= archive_bytes:
                    yield close()
        if parts:
            yield close()

    return rows.mapInArrow(run, "key string, page_id long, name string, offset long, size long")


def index(captures: DataFrame, to: str, block_lines: int = 256) -> DataFrame:
    """Sorts the captures by key into compressed blocks below ``to``; returns the directory: first, last, part, block, name, offset, size.

    Range partitions split by key and page_id, so a host with a third of all pages is dealt to many tasks.
    """

    def run(batches):
        files, part = Files(to), TaskContext.get().partitionId()
        name, at, parts, rows, lines = f"index-{part:06d}.qidx", 0, [], [], []

        def close():
            nonlocal at
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            rows.append((lines[0][0], lines[-1][0], part, len(rows), name, at, len(packed)))
            parts.append(packed)
            at += len(packed)
            lines.clear()

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(x)
                if len(lines) >= block_lines:
                    close()
        if lines:
            close()
        if parts:
            files.write(name, parts)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["first", "last", "part", "block", "name", "offset", "size"])

    rows = captures.repartitionByRange(partitions(captures.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id", "name", "offset")
    return rows.select("key", "page_id", "name", "offset", "size").mapInArrow(run, "first string, last string, part long, block long, name string, offset long, size long")


def _block(files: Files, name: str, offset: int, size: int) -> list[list]:
    with files.open(name) as f:
        f.seek(offset)
        return [json.loads(x) for x in zlib.decompress(f.read(size)).decode().split("\n")]


def read(directory: DataFrame, index_at: str, archives_at: str, with_html: bool = False) -> DataFrame:
    """Reads every record back by way of the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's length and digest are computed from the payload that is read and must equal those stated; a
    revisit's are those stated in its record.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", html string" if with_html else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.string()] * with_html

    def number(x):
        return int(x) if x else None

    def run(batches):
        index_files, files = Files(index_at), Files(archives_at)
        for b in batches:
            for name, offset, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, handle, now = [], None, None
                for _, _, archive, at, length in sorted(_block(index_files, name, offset, size), key=lambda x: (x[2], x[3])):
                    if archive != now:
                        if handle:
                            handle.close()
                        handle, now = files.open(archive), archive
                    handle.seek(at)
                    r = parse(handle.read(length))
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] == "response" and (hashlib.sha1(r["payload"]).hexdigest(), len(r["payload"])) != (digest, r["stated"]):
                        raise ValueError(f"the payload in {archive} at {at} isn't the one that was written")
                    rows.append((number(r["quern-page-id"]), r["stated"], digest, r["warc-type"], number(r.get("quern-refers-to-page-id")), r["warc-target-uri"]) + ((r["payload"].decode() if r["warc-type"] == "response" else None,) if with_html else ()))
                if handle:
                    handle.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return directory.select("name", "offset", "size").repartition(partitions(directory.sparkSession)).mapInArrow(run, schema)


class Lookup:
    """Finds the captures of single URLs. The directory is held for one part of the index at a time."""

    def __init__(self, directory: DataFrame, index_at: str, archives_at: str):
        self.directory, self.index_files, self.files = directory, Files(index_at), Files(archives_at)

    def find(self, url: str) -> list[dict]:
        key, out = reversed_host_key(url), []
        for (part,) in self.directory.filter((F.col("first") <= key) & (F.col("last") >= key)).select("part").distinct().collect():
            blocks = sorted(self.directory.filter(F.col("part") == part).select("block", "first", "last", "name", "offset", "size").collect())
            firsts, lasts = [x["first"] for x in blocks], [x["last"] for x in blocks]
            for x in blocks[bisect_left(lasts, key) : bisect_right(firsts, key)]:
                lines = _block(self.index_files, x["name"], x["offset"], x["size"])
                keys = [y[0] for y in lines]
                for _, page, archive, at, length in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                    with self.files.open(archive) as f:
                        f.seek(at)
                        out.append({"page_id": page} | parse(f.read(length)))
        return out


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes archives and index of all pages, then reads the archives back by the index; one row per page.

    Null html is an empty payload; repeated rows are each written. Of rows that also share the largest page_id
    of a group, each is a response. An empty table gives no rows. Columns other than page_id, url and html are
    never read, whatever their names.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    groups = scratch.keep(keepers(pages, least), "keepers")
    captures = scratch.keep(write(pages, scratch.path("archives"), groups), "captures")
    directory = scratch.keep(index(captures, scratch.path("index")), "directory")
    return read(directory, scratch.path("index"), scratch.path("archives"))
