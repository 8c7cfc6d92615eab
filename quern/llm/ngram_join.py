"""Exact Jaccard self-join of documents on word n-grams (operator 5).

Overlaps are counted by a blocked sparse product of the document by n-gram incidence matrix with itself.
Which blocks can hold a link at all is found from prefixes: of a set of n shingles in one common order, two
linked sets share one of the first n - ceil(t n) + 1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import NULL_ID, Scratch, let_go, partitions
from quern.llm.components import components
from quern.llm.embeddings import unite
from quern.llm.shingles import mix, set_hashes, sets

#: A block holds at most about so many documents, and so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
#: Longest run of one shingle whose members are compared by signature; those of longer ones are taken as candidates.
LIST = 256
#: A task solves the runs it has read when it holds so many entries.
HELD = 100_000


def linked(found: list[np.ndarray], percent: int, side: np.ndarray | None = None, columns: int = 2048, sparse: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j), i < j, of sets that link, by a blocked sparse product; and how many counters were ever open.

    The incidence matrix of sets by n-grams times its transpose, n-grams in blocks, the rarest first. Two sets of n and
    m link if they share ``percent * (n + m) / (100 + percent)``. A pair whose sizes alone forbid that is never counted.
    Along the way a pair is dropped once its count and what the smaller set has left are too few, and a set without
    open pairs leaves the product. With ``side`` only pairs of different sides count.
    """
    m = len(found)
    n = np.array([len(s) for s in found], np.int64)
    need = percent * (n[:, None] + n[None, :])
    alive = np.triu((100 + percent) * np.minimum(n[:, None], n[None, :]) >= need, 1) & (n > 0)[:, None]
    if side is not None:
        alive &= side[:, None] != side[None, :]
    doc = np.repeat(np.arange(m, dtype=np.int32), n)
    every = np.concatenate(found) if m else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
    df = np.diff(np.r_[starts, len(every)])
    left, count = n.copy(), np.zeros((m, m), np.int32)
    pi, pj = np.nonzero(alive)

    def drop():
        """Drops pairs that can no longer reach their bound."""
        nonlocal pi, pj
        good = (100 + percent) * (count[pi, pj].astype(np.int64) + np.minimum(left[pi], left[pj])) >= need[pi, pj]
        alive[pi[~good], pj[~good]] = False
        pi, pj = pi[good], pj[good]

    left -= np.bincount(doc[starts[df == 1]], minlength=m)  # shared with nobody here
    drop()
    opened = len(pi)
    for d in range(2, min(sparse, m) + 1):  # few sets have them: their pairs one by one
        docs = doc[starts[df == d][:, None] + np.arange(d)]  # ascending in every row
        for i in range(d):
            for j in range(i + 1, d):
                some = alive[docs[:, i], docs[:, j]]
                np.add.at(count, (docs[some, i], docs[some, j]), 1)
        left -= np.bincount(docs.ravel(), minlength=m)
    drop()
    at, d = starts[df > sparse], df[df > sparse]
    by = np.argsort(d, kind="stable")
    at, d = at[by], d[by]
    for step, c in enumerate(range(0, len(at), columns), 1):
        if not len(pi):
            break
        a, k = at[c : c + columns], d[c : c + columns]
        entries = np.repeat(a - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(int(k.sum()))
        who, column = doc[entries], np.repeat(np.arange(len(a)), k)
        rows = np.unique(np.concatenate([pi, pj]))
        place = np.full(m, -1)
        place[rows] = np.arange(len(rows))
        here = place[who] >= 0
        dense = np.zeros((len(rows), len(a)), np.float32)
        dense[place[who[here]], column[here]] = 1
        count[np.ix_(rows, rows)] += (dense @ dense.T).astype(np.int32)
        left -= np.bincount(who, minlength=m)
        if step & (step - 1) == 0:  # after 1, 2, 4, ... blocks
            drop()
    good = (100 + percent) * count[pi, pj].astype(np.int64) >= need[pi, pj]
    return pi[good], pj[good], opened


def _packed(counts: np.ndarray) -> bytes:
    """A slice of counters: one byte each, or only those above 0 with their places; a count above 255 counts as 255."""
    at = np.flatnonzero(counts)
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() if 3 * len(at) >= len(counts) else at.astype("<u2").tobytes() + small[at].tobytes()


def _unpack(raw: bytes, into: np.ndarray) -> None:
    if len(raw) == len(into):
        into += np.frombuffer(raw, np.uint8)
    else:
        n = len(raw) // 3
        into[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, np.uint8, n, 2 * n)


def _signature(s: np.ndarray) -> bytes:
    """How many shingles fall to each part, about eight a part, so large sets have more parts; 255 stands for any more.

    An intersection is at most the sum of the smaller counts.
    """
    parts = 1 << min(13, max(6, (len(s) // 8).bit_length()))
    return np.minimum(np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()


def _may_link(sig: list[bytes], a: np.ndarray, b: np.ndarray, need: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures leave pairs (a, b) an overlap of need / (100 + percent). The finer of two is folded to the coarser."""
    size = np.array([len(x) for x in sig])
    full = np.array([b"\xff" in x for x in sig])
    out, low = full[a] | full[b], np.minimum(size[a], size[b])
    for parts in np.unique(low).tolist():
        at = np.flatnonzero((low == parts) & ~out)
        rows, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        m = np.empty((len(rows), parts), np.uint16)
        for i, r in enumerate(rows.tolist()):
            m[i] = np.frombuffer(sig[r], np.uint8).reshape(-1, parts).sum(axis=0)
        step = max(1, (8 << 20) // parts)
        for c in range(0, len(at), step):
            some = slice(c, min(c + step, len(at)))
            x, y = m[place[: len(at)][some]], m[place[len(at) :][some]]
            out[at[some]] = (100 + percent) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= need[at[some]]
    return out


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for counters that other shingles' load explains, else the logarithm of what is above the load."""
    load = float(np.median(counts))
    over = counts - load
    return np.where(over >= 4 * math.sqrt(load) + 2, 1 + 2 * np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def edges_of_runs(batches, percent: int, part: int):
    """Rows (part, h, n, a, b, end) of three kinds: edges (a, b); members b, of n shingles, of the list h (end 2);
    for each end of the partition its run's h, n and first member a (end 0 and 1)."""
    first, last, starred = None, None, False  # starred: the held run's first and last stand for members that are edges already
    fields, seen, held, out = ["part", "h", "n", "a", "b", "end"], set(), [np.zeros(0, np.int64)] * 3, []

    def emit(final):
        if out and (final or sum(len(x[0]) for x in out) > 200_000):
            h, n, a, b, end = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            edge = end < 0
            keep = pa.array(edge)
            none = pa.nulls(len(h), pa.int64())
            columns = [none, pa.compute.if_else(keep, none, pa.array(h)), pa.compute.if_else(keep, none, pa.array(n)), pa.compute.if_else(keep, pa.array(a), none), pa.array(b), pa.compute.if_else(keep, pa.nulls(len(h), pa.int32()), pa.array(end))]
            yield pa.RecordBatch.from_arrays(columns, fields)

    def put(h, n, a, b, end):
        out.append((h, n, a, b, np.full(len(b), end, np.int32)))

    def solve(h, n, node, starts, opens, closes, starred):
        """Takes whole runs; the partition's first and last, which may go on elsewhere, one that is a star already, and long ones become edges to their first."""
        sizes = np.diff(np.r_[starts, len(h)])
        lists = (sizes > 1) & (sizes <= LIST)
        stars = sizes > LIST
        if opens or starred:
            lists[0], stars[0] = False, True
        if closes:
            lists[-1], stars[-1] = False, True
        run = np.repeat(np.arange(len(starts)), sizes)
        lead = node[starts][run]
        at = np.flatnonzero(stars[run] & (lead != node))
        if len(at):
            put(h[at], n[at], lead[at], node[at], -1)
        name = np.add.reduceat(mix(node.view(np.uint64)), starts)
        fresh = np.zeros(len(starts), bool)
        for r in np.flatnonzero(lists).tolist():
            if name[r] not in seen:
                seen.add(name[r])
                fresh[r] = True
        at = np.flatnonzero(fresh[run])
        if len(at):
            put(name.view(np.int64)[run[at]], n[at], node[at], node[at], 2)
        return node[starts[-1]]

    def begins(h, n):
        new = np.r_[True, (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])]
        if starred:
            new[1] = False
        return np.flatnonzero(new)

    for b in batches:
        held = [np.concatenate([x, np.asarray(c).astype(np.int64)]) for x, c in zip(held, b.columns, strict=True)]
        h, n, node = held
        if len(h) < HELD:
            continue
        starts = begins(h, n)
        if len(starts) == 1:  # one long run: its first stands for those read
            put(h[1:], n[1:], np.full(len(h) - 1, node[0]), node[1:], -1)
            if first is None:
                first = (h[0], n[0], node[0])
            held, starred = [np.r_[x[:1], x[-1:]] for x in held], True
        else:
            cut = starts[-1]
            solve(h[:cut], n[:cut], node[:cut], starts[:-1], first is None, False, starred)
            first = first or (h[0], n[0], node[0])
            held, starred = [x[cut:] for x in held], False
        yield from emit(False)
    h, n, node = held
    if len(h):
        starts = begins(h, n)
        last = (h[-1], n[-1], solve(h, n, node, starts, first is None, True, starred))
        first = first or (h[0], n[0], node[0])
    yield from emit(True)
    if last is not None:
        ends = [(part, int(h), int(n), int(a), None, e) for e, (h, n, a) in enumerate((first, last))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends, strict=True), [pa.int64()] * 5 + [pa.int32()], strict=True)], fields)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, sketch_bits: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_links, component_id of every row; links where 100 * intersection >= percent * union.

    Words are maximal runs of characters other than space and 9 to 13, A-Z in lower case. A text of fewer than
    ``k`` words has its whole sequence as its one shingle; without words (empty, null) it links with nothing.

    1. Documents with equal sets, by 128 bits of hash, are one node with a weight, so exact copies cost nothing more.
       Nodes have numbers of their own; candidates are named by 64 of the bits, so nodes that share these meet in one block,
       where their sets are told apart.
    2. Shingles are ordered by frequency, then hash, so prefixes hold rare ones. Frequencies come from counters
       of a fixed number (2^sketch_bits); any order gives the same links, a good one only fewer candidates.
    3. Prefix entries are range-sorted by (shingle, size), which makes runs of compatible sizes. Members of a
       short run are candidates if the sums of their signatures' smaller counts leave a link possible; equal
       runs count once. All members of a long run are, by edges to its first, linked across the partitions'
       boundaries: a frequent shingle is dealt to many tasks and gives a row per entry, never its pairs. The
       components of the candidates are groups: they say which documents meet in a block, not which link.
    4. Groups are multiplied in blocks (:func:`linked`): large ones are divided by size bands, of which only equal
       and neighbouring ones can hold links, and by hash. A block returns link counts and a spanning forest.

    Rows with equal ids are rows of their own. A null id counts as the smallest. An empty table gives no rows. Columns
    other than those named are never read, whatever their names.
    """
    out = _joined(docs, k, percent, sketch_bits, doc_id, text)
    component = F.when(F.col("lowest").isNull(), F.col("id")).when(F.col("lowest") != NULL_ID, F.col("lowest"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))


def _joined(docs: DataFrame, k: int, percent: int, sketch_bits: int, doc_id: str, text: str) -> DataFrame:
    """id, th, n, n_links, c, lowest of every row: th is the text's hash, c the group's own number and null without words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), _text_hash(F.col(text)).alias("th"))
    texts = texts.withColumn("th2", F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))))  # rows without an identifier, or of one, are told apart by their texts
    slots, shift = 1 << sketch_bits, np.uint64(64 - sketch_bits)
    width = min(slots, 1 << 16)

    def read(batches):
        """Rows (id, th, n, node, node2, signature) of documents, then this task's counters in slices, whose numbers stand in the place of id."""
        let_go()
        counters, waiting = np.zeros(slots, np.int32), []
        names = ["id", "th", "th2", "n", "node", "node2", "counts", "signature"]
        for b in batches:
            found = sets(b.column(1).to_pylist(), k)
            waiting += found
            if sum(map(len, waiting)) > 500_000:
                np.add.at(counters, (np.concatenate(waiting) >> shift).astype(np.int64), 1)
                waiting = []
            keys = [set_hashes(s) if len(s) else (None, None) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([len(s) for s in found], pa.int64()), pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), pa.nulls(len(found), pa.binary()), pa.array([_signature(s) for s in found], pa.binary())], names)
        if waiting:
            np.add.at(counters, (np.concatenate(waiting) >> shift).astype(np.int64), 1)
        for i in range(0, slots, 16 * width):
            some = [(j // width, _packed(counters[j : j + width])) for j in range(i, min(slots, i + 16 * width), width)]
            some = [x for x in some if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), *[pa.nulls(len(some), pa.int64())] * 5, pa.array([x[1] for x in some], pa.binary()), pa.nulls(len(some), pa.binary())], names)

    def add_up(batches):
        """Sums of each slice that this task has, one slice at a time in memory for each."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _unpack(c, sums.setdefault(i, np.zeros(width, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([int(x.sum()) for x in sums.values()], pa.int64()), pa.array([_levels(x).tobytes() for x in sums.values()], pa.binary())], ["id", "total", "level"])

    both = scratch.keep(texts.mapInArrow(read, "id long, th long, th2 long, n long, node long, node2 long, counts binary, signature binary"), "rows")
    rows = both.filter("counts is null").select("id", "th", "th2", "n", "node", "node2", "signature")
    slices = both.filter("counts is not null").select("id", "counts").repartition(partitions(spark), "id").mapInArrow(add_up, "id long, total long, level binary")
    level = np.zeros(slots, np.uint8)  # of a fixed size, whatever the input
    for r in slices.select("id", "level").toLocalIterator():
        level[r["id"] * width : (r["id"] + 1) * width] = np.frombuffer(r["level"], np.uint8)
    levels = spark.sparkContext.broadcast(level)
    nodes = rows.filter("n > 0").groupBy("node", "node2").agg(F.min(F.struct(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "th", "th2")).alias("row"), F.first("n").alias("n"), F.count(F.lit(1)).alias("w"), F.first("signature").alias("signature"))
    nodes = nodes.select("node", "node2", "row.*", "n", "w", "signature")
    nodes = scratch.keep(nodes.withColumn("no", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stay
    rows = rows.drop("signature", "th2")

    def prefixes(batches):
        let_go()
        ranks, seen = levels.value, set()
        for b in batches:
            hs, ns, ids = [], [], []
            for s in sets(b.column(1).to_pylist(), k):
                if not len(s):
                    continue
                node = set_hashes(s)
                if node not in seen:
                    seen.add(node)
                    n = len(s)
                    first = s[np.argsort(ranks[(s >> shift).astype(np.int64)], kind="stable")[: n + (-percent * n // 100) + 1]]
                    hs.append(first)
                    ns.append(np.full(len(first), n, np.int32))
                    ids.append(np.full(len(first), node[0], np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(ids))], ["h", "n", "node"])

    entries = scratch.keep(texts.select("id", "text").mapInArrow(prefixes, "h long, n int, node long"), "prefixes")

    def runs(batches):
        return edges_of_runs(batches, percent, TaskContext.get().partitionId())

    def sift(batches):
        """Edges inside each list between members whose signatures leave a link possible; a spanning forest of them."""
        held: list[list] = []

        def solve():
            name = np.array([x[0] for x in held])
            n = np.array([x[1] for x in held], np.int64)
            node = np.array([x[2] for x in held], np.int64)
            sig = [x[3] for x in held]
            starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            sizes, label = np.diff(np.r_[starts, len(name)]), np.arange(len(name))
            for size in np.unique(sizes[sizes > 1]).tolist():
                at = starts[sizes == size]
                i, j = np.triu_indices(size, 1)
                for c in range(0, len(at), max(1, 200_000 // len(i))):
                    some = at[c : c + max(1, 200_000 // len(i))]
                    a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    need = percent * (n[a] + n[b])
                    may = (100 + percent) * np.minimum(n[a], n[b]) >= need
                    a, b, need = a[may], b[may], need[may]
                    may = _may_link(sig, a, b, need, percent)
                    label = unite(label, a[may], b[may])
            at = np.flatnonzero(label != np.arange(len(name)))
            return pa.RecordBatch.from_arrays([pa.array(node[label[at]]), pa.array(node[at])], ["a", "b"])

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= 20_000 and x[0] != held[-1][0]:
                    yield solve()
                    held = []
                held.append(x)
        if held:
            yield solve()

    ordered = entries.repartitionByRange(partitions(spark), "h", "n", "node").sortWithinPartitions("h", "n", "node")
    paired = scratch.keep(ordered.mapInArrow(runs, "part long, h long, n long, a long, b long, end int"), "runs")
    scratch.drop("prefixes")
    before = Window.orderBy("part", "end")  # two rows for each partition
    ends = paired.filter("end < 2").select("end", "h", "n", "a", F.lag("h").over(before).alias("h0"), F.lag("n").over(before).alias("n0"), F.lag("a").over(before).alias("b"))
    across = ends.filter(f"end = 0 and h = h0 and 100 * n0 >= {int(percent)} * n").select("a", "b")
    lists = paired.filter("end = 2").select("h", F.col("b").alias("node")).distinct().join(nodes, "node")
    lists = lists.select("h", "n", "node", "signature").repartition(partitions(spark), "h").sortWithinPartitions("h")
    sifted = scratch.keep(lists.mapInArrow(sift, "a long, b long"), "sifted")
    groups = components(paired.filter("end is null").select("a", "b").union(across).union(sifted), scratch, "groups").withColumnsRenamed({"component": "g"})
    scratch.drop("runs")

    step = math.log(100 / (percent - 0.1))
    nodes = nodes.drop("signature")
    members = scratch.keep(nodes.join(groups, "node").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int")), "members")
    whole = members.groupBy("g").agg(F.sum("n").alias("gn"), F.count(F.lit(1)).alias("gm")).withColumn("small", (F.col("gm") <= 2 * BLOCK_DOCS) & (F.col("gn") <= 2 * BLOCK_SHINGLES)).select("g", "small")
    members = members.join(whole, "g")
    own_columns = ["no", "node", "node2", "id", "th", "th2", "w"]
    small = members.filter("small").select("g", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(0).alias("side"), *own_columns)
    large = members.filter("not small")
    parts = large.groupBy("g", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    around = parts.select("g", "band", "parts").union(parts.select("g", F.col("band") + 1, "parts")).union(parts.select("g", F.col("band") - 1, "parts")).select("g", "band").distinct()
    table = around.join(parts, ["g", "band"], "left")
    other = lambda by, name: parts.select("g", (F.col("band") + by).alias("band"), F.col("parts").alias(name))
    table = table.join(other(-1, "above"), ["g", "band"], "left").join(other(1, "below"), ["g", "band"], "left").filter("parts is not null").na.fill(0)
    large = large.join(table, ["g", "band"]).withColumn("own", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    upto = lambda c: F.expr(f"if({c} > 0, sequence(0, {c} - 1), cast(array() as array<int>))")
    as_task = lambda lo, hi, s, t, side: F.struct(lo.alias("lo"), hi.alias("hi"), s.alias("s"), t.alias("t"), side.alias("side"))
    band, own = F.col("band"), F.col("own")
    jobs = F.concat(
        F.transform(upto("parts"), lambda x: as_task(band, band, F.least(own, x), F.greatest(own, x), F.when(own > x, 1).otherwise(0))),
        F.transform(upto("above"), lambda x: as_task(band, band + 1, own, x, F.lit(0))),
        F.transform(upto("below"), lambda x: as_task(band - 1, band, x, own, F.lit(1))),
    )
    large = large.select("g", F.explode(jobs).alias("j"), *own_columns).select("g", "j.lo", "j.hi", "j.s", "j.t", "j.side", *own_columns)
    work_rows = scratch.keep(small.union(large), "work")
    row_of = ["id", "th", "th2"]
    once = texts.withColumn("id", F.coalesce("id", F.lit(NULL_ID))).groupBy(*row_of).agg(F.first("text").alias("text"))  # of equal rows, however many, one
    wanted = once.join(work_rows.hint("merge"), row_of).drop(*row_of)  # either side grows with the input

    def multiply(t: pa.Table) -> pa.Table:
        whole_block = (t["lo"][0], t["s"][0]) == (t["hi"][0], t["t"][0])
        nodes_, side, w, found = [], [], [], []
        for at in range(0, t.num_rows, 256):
            part = t.slice(at, 256)
            for s, no, *key, one, weight in zip(sets(part["text"].to_pylist(), k), *(part[c].to_pylist() for c in ("no", "node", "node2", "side", "w")), strict=True):
                if len(s) and set_hashes(s) == tuple(key):
                    nodes_.append(no)
                    side.append(one)
                    w.append(weight)
                    found.append(s)
        nodes_, side, w = np.array(nodes_, np.int64), np.array(side, int), np.array(w, np.int64)
        i, j, _ = linked(found, percent, None if whole_block else side)
        links, label = np.zeros(len(found), np.int64), np.arange(len(found))
        np.add.at(links, i, w[j])
        np.add.at(links, j, w[i])
        label = unite(label, i, j)
        some, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(found)))
        return pa.table({"a": pa.array(np.concatenate([nodes_[some], nodes_[joined]]), pa.int64()), "b": pa.array(np.concatenate([links[some], nodes_[label[joined]]]), pa.int64()), "edge": pa.array(np.concatenate([np.zeros(len(some), bool), np.ones(len(joined), bool)]))})

    found = scratch.keep(wanted.groupBy("g", "lo", "hi", "s", "t").applyInArrow(multiply, "a long, b long, edge boolean"), "found")
    links = found.filter("not edge").groupBy(F.col("a").alias("no")).agg(F.sum("b").alias("links"))
    comps = components(found.filter("edge").select("a", "b"), scratch, "links").withColumnsRenamed({"node": "no", "component": "c"})
    nodes = nodes.join(links, "no", "left").join(comps, "no", "left").withColumn("c", F.coalesce("c", "no"))
    nodes = scratch.keep(nodes.select("node", "node2", "id", "w", "links", "c"), "result")
    lowest = nodes.groupBy("c").agg(F.min("id").alias("lowest"))
    by_node = nodes.join(lowest, "c").select("node", "node2", "c", "lowest", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return rows.join(by_node, ["node", "node2"], "left").select("id", "th", "n", "n_links", "c", "lowest")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but one row of each group of :func:`ngram_join`: that of the smallest (identifier, hash of the text).

    A null identifier is the smallest. Of rows equal in identifier and text that are a group's smallest one stays, whichever:
    their other columns may differ. Rows without words (null and empty texts) are no group and all stay. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    rows = scratch.keep(_joined(docs, k, percent, 24, doc_id, text).select(F.coalesce("id", F.lit(NULL_ID)).alias("__q_d"), F.col("th").alias("__q_th"), "c"), "groups")
    smallest = rows.filter("c is not null").groupBy("c").agg(F.min(F.struct("__q_d", "__q_th")).alias("s")).select("s.*")
    copies = rows.groupBy("__q_d", "__q_th").agg(F.count(F.lit(1)).alias("copies"), F.max(F.col("c").isNull()).alias("wordless"))
    stay = scratch.keep(copies.join(smallest.withColumn("first", F.lit(True)), ["__q_d", "__q_th"], "left").filter("wordless or first"), "stay")
    keyed = docs.withColumns({"__q_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__q_th": _text_hash(F.col(text))})
    repeated = (F.col("copies") > 1) & ~F.col("wordless")
    once = keyed.join(stay.filter(~repeated), ["__q_d", "__q_th"], "left_semi")
    twice = keyed.join(stay.filter(repeated), ["__q_d", "__q_th"], "left_semi").dropDuplicates(["__q_d", "__q_th"])
    return once.union(twice).drop("__q_d", "__q_th")
