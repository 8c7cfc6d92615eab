"""Exact removal of byte strings that occur twice (operator 4), by sorting suffixes.

A full suffix array of the corpus isn't needed: what matters is which strings of ``length`` bytes are equal.
Every such string holds an anchor, its k-mer of smallest hash, at a place its bytes decide. So equal strings
have equal anchors, and it is enough to sort the suffixes that begin at anchors, and the reversed prefixes
that end there. Consecutive strings with one anchor form a segment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm.common import NULL_ID, Scratch, let_go, partitions

_PART = 1 << 19
#: Different segments with one anchor that one task sorts at most; the strings of more are dealt to all tasks by their 128-bit hashes.
HOT = 4096


def _anchors(b: np.ndarray, doc: np.ndarray, length: int, k: int):
    """Segments of a buffer of texts: first string, number of strings, anchor's place and hash. ``doc`` has each byte's text."""
    n = len(b) - k + 1
    if len(b) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(shingles._BYTE[b] * shingles._POWER[: len(b)], out=sums[1:])
    h = shingles.mix((sums[k:] - sums[:-k]) * shingles._BACK[:n])
    low = np.uint64((1 << 20) - 1)
    code = (h & ~low) | np.arange(n, dtype=np.uint64)  # equal hashes: the leftmost is smaller
    w = length - k + 1
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = code
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)
    s = np.flatnonzero(doc[: len(m)] == doc[length - 1 : length - 1 + len(m)])
    if not len(s):
        return s, s, s, s.astype(np.uint64)
    m = m[s]
    first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (s[1:] != s[:-1] + 1)])
    return s[first], np.diff(np.r_[first, len(s)]), m[first], h[m[first]]


def _parts(texts: list[bytes], length: int):
    """(buffer, text number of each byte, and for each text of the buffer: number, place in the buffer, place in the text)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _PART):
            piece = t[at : at + _PART + length - 1]
            if size + len(piece) > _PART and group:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


def _words(b: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """``width`` bytes from each place on, forwards or backwards, as 8-byte words; zero beyond ``size``."""
    reach = np.arange(width)
    inside = reach < size[:, None]
    out = np.where(inside, b[np.where(inside, at[:, None] + step * reach, 0)], 0).astype(np.uint8)
    return np.ascontiguousarray(out).view(">u8").astype(np.uint64)


def multikey_sort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows by (group, words): each level sorts, by its word, only rows that are still equal to another."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    n = len(g)
    cls = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(n), 0)) if n else np.zeros(0, int)
    for d in range(words.shape[1]):
        same = np.zeros(n, bool)
        same[1:] = cls[1:] == cls[:-1]
        same[:-1] |= same[1:].copy()
        at = np.flatnonzero(same)
        if not len(at):
            break
        rows = order[at]
        key, c = words[rows, d], cls[at]
        o = np.lexsort((key, c))
        order[at] = rows[o]
        key = key[o]
        new = np.r_[True, (c[1:] != c[:-1]) | (key[1:] != key[:-1])]
        cls[at] = np.maximum.accumulate(np.where(new, at, 0))
    return order


def shared(words: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before; -1 where the group changes."""
    w, g = words[order], group[order]
    out = np.full(len(order), -1)
    if len(order) > 1:
        x = w[1:] ^ w[:-1]
        at = (x != 0).argmax(axis=1)
        v = x[np.arange(len(x)), at]
        lead = np.full(len(v), 8)
        for byte in range(8):
            lead = np.where((lead == 8) & ((v >> np.uint64(56 - 8 * byte)) & np.uint64(255) != 0), byte, lead)
        out[1:] = np.where(g[1:] != g[:-1], -1, np.where(v == 0, 8 * w.shape[1], 8 * at + lead))
    return out


def repeated(segments: list[bytes], group: np.ndarray, n: np.ndarray, off: np.ndarray, length: int, k: int) -> np.ndarray:
    """For different segments, by distance before the anchor: whether the string there equals one of another segment.

    Anchored suffixes and reversed prefixes are sorted. A string of distance a is equal to another if its
    segments share length - a bytes from the anchor on and a bytes before it: both are runs of the sorted orders.
    """
    m, most = len(segments), length - k + 1
    b = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    start = np.r_[0, np.cumsum(size)[:-1]]
    right = _words(b, start + off, size - off, -(-length // 8) * 8, 1)
    left = _words(b, start + off - 1, off, -(-length // 8) * 8, -1)
    sides = []
    for words in (right, left):
        order = multikey_sort(words, group)
        sides.append((order, shared(words, group, order)))
    found, at = np.zeros((m, most), bool), np.arange(m)
    for a in range(most):
        rows = np.flatnonzero((off - n < a) & (a <= off))
        if len(rows) < 2:
            continue
        block = []
        for (order, lcp), depth in zip(sides, (length - a, a), strict=True):
            of = np.empty(m, np.int64)
            of[order] = np.maximum.accumulate(np.where(lcp < depth, at, 0))
            block.append(of[rows])
        _, back, count = np.unique(block[0] * m + block[1], return_inverse=True, return_counts=True)
        found[rows, a] = count[back] > 1
    return found


def suffix_dedup(docs: DataFrame, length: int = 200, k: int = 40, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and ``kept``, the remaining bytes).

    Removes each byte that is covered by a string of ``length`` bytes of one text that also starts anywhere
    else, in this text or another; judged on the input. Null texts are empty; shorter texts lose nothing.

    1. Every segment gives a narrow row: place, anchor's hash, 128-bit hash of its bytes, which names its kind. Anchors
       seen once are unique.
    2. Of each kind that repeats two segments are fetched, and one of each other kind of an anchor that has several;
       kinds are counted with sums before the shuffle, so thousands of copies are two rows.
    3. They are range-partitioned by their leading bytes at sampled splitters, sorted, and each bucket sorts its
       suffixes and prefixes by multikey quicksort (:func:`repeated`), which alone says what is repeated. A bucket
       holds every suffix with one leading k-mer, so no equal strings lie on two sides of a boundary. An anchor with more than HOT different segments would overfill
       a bucket: each of its strings is a row of its own instead, keyed by 128 bits of hash (its 200 bytes as the key
       take twelve times the memory), so equal ones meet however many tasks the anchor is dealt to.
    4. What is repeated in a kind goes to all its segments, in a join whose large partitions Spark splits; the removed
       spans meet the texts, and the rest is hashed.

    Rows equal in id and text are repeated texts, like any others. An empty table gives no rows. Segments are of one kind
    if their 128-bit hashes are equal. Columns other than those named are never read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(content).alias("th"), F.encode(content, "UTF-8").alias("raw"))

    def scan(batches):
        let_go()
        names = ["d", "th", "lo", "n", "off", "kh", "sh", "sh2"]
        for batch in batches:
            ids, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for group in _parts(batch.column(2).to_pylist(), length):
                raw = b"".join(p for _, _, p in group)
                sizes = np.array([len(p) for _, _, p in group])
                b = np.frombuffer(raw, np.uint8)
                which = np.repeat(np.arange(len(group)), sizes)
                s, n, m, kh = _anchors(b, which, length, k)
                if not len(s):
                    continue
                sh = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x : x + y]) for x, y in zip(s.tolist(), (n + length - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                g = which[s]
                text_no, base = np.array([x[0] for x in group])[g], (np.array([x[1] for x in group]) - np.r_[0, np.cumsum(sizes)[:-1]])[g]
                cols = [ids[text_no], th[text_no], s + base, n.astype(np.int32), (m - s).astype(np.int32), kh.view(np.int64), np.ascontiguousarray(sh[:, 0]), np.ascontiguousarray(sh[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    segments = scratch.keep(rows.select("d", "th", "raw").filter(F.length("raw") >= length).mapInArrow(scan, "d long, th long, lo long, n int, off int, kh long, sh long, sh2 long"), "segments")
    twice = segments.groupBy("kh").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    candidates = scratch.keep(segments.join(twice, "kh"), "candidates")
    scratch.drop("segments")
    kinds = candidates.groupBy("kh", "sh", "sh2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "th", "lo", "n", "off")).alias("one"), F.max(F.struct("d", "th", "lo", "n", "off")).alias("other"))
    kinds = scratch.keep(kinds, "kinds")
    per_anchor = kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("kinds"))
    wanted = kinds.join(per_anchor, "kh").filter("kinds > 1 or c > 1")
    # a row that repeats as a whole has one place only, though it is there twice
    own = F.struct("kh", "sh", "sh2", ((F.col("c") > 1) & (F.col("one") == F.col("other"))).alias("again"), (F.col("kinds") > HOT).alias("hot"))
    places = F.when((F.col("c") > 1) & (F.col("one") != F.col("other")), F.array("one", "other")).otherwise(F.array("one"))
    wanted = wanted.select(F.explode(places).alias("p"), own.alias("k")).select("p.*", "k.*")
    wanted = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("lo", "n", "off", "kh", "sh", "sh2", "again", "hot")).alias("parts"))

    def fetch(batches):
        let_go()
        names = ["lo", "n", "off", "kh", "sh", "sh2", "again", "hot", "lead", "bytes"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            seen, size = set(), 0
            for d, th, raw, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (d, th) in seen:  # a repeated row
                    continue
                seen.add((d, th))
                for p in parts:
                    piece = raw[p["lo"] : p["lo"] + p["n"] + length - 1]
                    for c, v in zip(cols, (*p.values(), piece[p["off"] : p["off"] + k], piece), strict=True):
                        c.append(v)
                    size += len(piece)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                    cols, size = [[] for _ in names], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    fetched = rows.select("d", "th", "raw").join(wanted, ["d", "th"]).select("d", "th", "raw", "parts").mapInArrow(fetch, "lo long, n int, off int, kh long, sh long, sh2 long, again boolean, hot boolean, lead binary, bytes binary")
    fetched = scratch.keep(fetched, "fetched")  # rows that repeat give theirs in each task that has one: equal, like any copies

    def compare(batches):
        let_go()
        held: list[list] = []
        size = 0

        def solve():
            lead, kh, sh, sh2, n, off, again, parts = (list(x) for x in zip(*held, strict=True))
            group = np.cumsum(np.r_[0, [x != y for x, y in zip(lead[1:], lead, strict=False)]]).astype(np.int64)
            n, off = np.array(n), np.array(off)
            found = repeated(parts, group, n, off, length, k)
            every = np.arange(found.shape[1])
            found |= np.array(again)[:, None] & (every > (off - n)[:, None]) & (every <= off[:, None])
            edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            names = [np.array(x, np.int64)[row] for x in (kh, sh, sh2)]
            return pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(off[row] - last, pa.int64()), pa.array(off[row] - first + length, pa.int64())], ["kh", "sh", "sh2", "a", "b"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 2_000_000 and x[0] != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                held.append(x)
                size += len(x[-1])
        if held:
            yield solve()

    spans = "kh long, sh long, sh2 long, a long, b long"
    ordered = fetched.filter("not hot").select("lead", "kh", "sh", "sh2", "n", "off", "again", "bytes").repartitionByRange(partitions(spark), "lead").sortWithinPartitions("lead")
    edges = ordered.mapInArrow(compare, spans)

    def strings(batches):
        let_go()
        for batch in batches:
            for kh, sh, sh2, n, again, piece in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h = [xxhash.xxh3_128_digest(piece[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * n, pa.int64()) for v in (kh, sh, sh2)), pa.array(range(n), pa.int64()), pa.array([again] * n), pa.array(h, pa.binary())], ["kh", "sh", "sh2", "a", "again", "h"])

    hot = fetched.filter("hot").select("kh", "sh", "sh2", "n", "again", "bytes").mapInArrow(strings, "kh long, sh long, sh2 long, a long, again boolean, h binary")
    hot = scratch.keep(hot, "strings")
    twice = hot.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.max("again").alias("any")).filter("times > 1 or any").select("h")
    more = hot.join(twice, "h").select("kh", "sh", "sh2", "a", (F.col("a") + length).alias("b"))
    found = scratch.keep(edges.union(more).distinct(), "found")
    gone = candidates.join(found, ["kh", "sh", "sh2"]).select("d", "th", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    gone = gone.groupBy("d", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # rows that repeat have theirs once

    def finish(batches):
        let_go()
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        for batch in batches:
            out = []
            for i, raw, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, kept, n = 0, [], 0
                end = -1
                for x in sorted((x["a"], x["b"]) for x in found or ()):
                    if x[0] > end:
                        n += 1
                        kept.append(raw[at : x[0]])
                    end = max(end, x[1])
                    at = end
                kept = b"".join([*kept, raw[at:]])
                out.append((i, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    met = rows.join(gone, ["d", "th"], "left").select("id", "raw", "spans")
    return met.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
