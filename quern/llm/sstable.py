"""Token ids in sorted-string-table shards (operator 8).

A shard holds documents in ascending order of their keys::

    block*      each compressed; entries: shared, rest and value lengths as varints, rest of the key, value
    Bloom       bits over all keys of the shard
    index       JSON, one entry per block: first key, offset, size, entries
    footer      64 bytes: offsets and sizes of the two above, documents, ids, bytes per id, magic

Keys are the identifier as 8 big-endian bytes with the sign bit turned, so byte order is numeric order;
a null identifier is the empty key and comes first. Equal keys are all kept.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Files, Scratch, partitions, read_varint, varint
from quern.llm.tokens import encoded

MAGIC = b"QSST0001"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BITS, HASHES = 10, 7


def key_of(i: int | None) -> bytes:
    return b"" if i is None else struct.pack(">Q", i + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + j * b) % bits for j in range(HASHES)]


class Writer:
    """Collects entries in ascending key order; ``parts()`` then gives the shard's bytes."""

    def __init__(self, width: int, block_bytes: int = 64 << 10):
        self.width, self.block_bytes = width, block_bytes
        self.out: list[bytes] = []
        self.index: list[list] = []
        self.keys: list[bytes] = []
        self.size = self.ids = 0
        self._begin()

    def _begin(self):
        self.buf, self.first, self.last, self.n = bytearray(), b"", b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.buf += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.n += 1
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.buf) >= self.block_bytes:
            self._end()

    def _end(self):
        if self.n:
            packed = zstandard.ZstdCompressor(level=1).compress(bytes(self.buf))
            self.index.append([self.first.hex(), self.size, len(packed), self.n])
            self.out.append(packed)
            self.size += len(packed)
            self._begin()

    def parts(self) -> list[bytes]:
        self._end()
        bits = max(64, BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = zlib.compress(json.dumps([bits, self.index]).encode())
        footer = FOOTER.pack(self.size, len(bloom), self.size + len(bloom), len(index), len(self.keys), self.ids, self.width, MAGIC)
        return [*self.out, bytes(bloom), index, footer]


class Reader:
    """Reads one shard: whole, in order, or single keys by Bloom filter and binary search."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - FOOTER.size)
        at, n, self.at_index, n_index, self.docs, self.ids, self.width, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        f.seek(at)
        self.bloom = f.read(n)
        self.bits, self.index = json.loads(zlib.decompress(f.read(n_index)))
        self.firsts = [bytes.fromhex(x[0]) for x in self.index]

    def block(self, j: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, n = self.index[j]
        self.f.seek(at)
        buf, at, key = zstandard.ZstdDecompressor().decompress(self.f.read(size)), 0, b""
        for _ in range(n):
            shared, at = read_varint(buf, at)
            rest, at = read_varint(buf, at)
            length, at = read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            yield key, np.frombuffer(buf, f"<u{self.width}", length // self.width, at)
            at += length

    def __iter__(self):
        for j in range(len(self.index)):
            yield from self.block(j)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key."""
        if not self.index or not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out, j = [], bisect_right(self.firsts, key) - 1
        while j > 0 and self.firsts[j] == key:  # equal keys may begin in an earlier block
            j -= 1
        for j in range(max(j, 0), len(self.index)):
            if self.firsts[j] > key:
                break
            out += [ids for k, ids in self.block(j) if k == key]
        return out


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0, width: int = 2, shard_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents as shards below ``to`` and returns the manifest: part, shard, name, docs, ids, first, last.

    The input is range-partitioned by identifier and sorted, ties by the text's hash, so part and shard numbers follow
    the ascending order. Rows that share an identifier, or have none, are split by that hash, and equal rows by
    their number in the input, so no identifier's rows need fit one task. A repeated task writes the same names
    anew, each by one rename. ``width`` is 2 or 4 bytes per id (2 for vocabularies below 65,536). Null texts are
    empty; null identifiers come first; an empty table gives an empty manifest. Other columns are never read,
    whatever their names.
    """

    def run(batches):
        files, part, shard = Files(to), TaskContext.get().partitionId(), 0
        made, w, first, last = [], Writer(width), None, None

        def close():
            nonlocal shard, w
            if w.keys:
                name = f"ids-{part:06d}-{shard:06d}.qsst"
                made.append((part, shard, name, len(w.keys), w.ids, first, last))
                files.write(name, w.parts())
                shard, w = shard + 1, Writer(width)

        for names, ids in encoded(batches, tokenizer, end_id):
            for i, x in zip(names, ids, strict=True):
                if not w.keys:
                    first = i
                value = np.frombuffer(x, "<u4")
                if width == 2 and len(value) and value.max() > 0xFFFF:
                    raise ValueError("an id needs more than 2 bytes")
                w.add(key_of(i), value.astype(f"<u{width}").tobytes())
                last = i
                if w.size >= shard_bytes:
                    close()
        close()
        cols = list(zip(*made, strict=True)) if made else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j == 2 else pa.int64()) for j, c in enumerate(cols)], ["part", "shard", "name", "docs", "ids", "first", "last"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"th": F.xxhash64(F.coalesce("text", F.lit(""))), "nth": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "th", "nth").sortWithinPartitions("doc_id", "th", "nth")
    return rows.select("doc_id", "text").mapInArrow(run, "part long, shard long, name string, docs long, ids long, first long, last long")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids in all shards before: sums over parts first, then over the shards of a part."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).drop("part_start")


def read(manifest: DataFrame, base: str, with_ids: bool = False) -> DataFrame:
    """Every document of the shards in the manifest: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``manifest`` has been through :func:`with_starts`. A task streams its shards block by block.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        files, rows = Files(base), []

        def out():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open(name) as f:
                    for key, ids in Reader(f):
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + ((ids.tolist(),) if with_ids else ()))
                        start += len(ids)
                        if len(rows) >= (500 if with_ids else 20_000):
                            yield out()
        yield out()

    return manifest.select("name", "start").repartition(partitions(manifest.sparkSession)).mapInArrow(run, schema)


def find(manifest: DataFrame, base: str, ids: list[int]) -> list[tuple[int, list[int]]]:
    """Looks up a short list of identifiers on the driver, opening only shards whose key range holds them."""
    files, out = Files(base), []
    for i in ids:
        for row in manifest.filter((F.col("first") <= i) & (F.col("last") >= i)).select("name").collect():
            with files.open(row["name"]) as f:
                out += [(i, x.tolist()) for x in Reader(f).get(key_of(i))]
    return out


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Writes all documents and reads them back: doc_id, start, n_tokens, ids_crc32, as the files have them."""
    scratch = Scratch(docs.sparkSession, "sstable")
    to = scratch.path("shards")
    manifest = scratch.keep(write(docs, to, tokenizer, **how), "manifest")
    return read(with_starts(manifest), to)
