"""Benchmark decontamination (operator 1): BM25 inverted index of test items, searched with block-max WAND."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles as sh
from quern.llm.common import Files, Scratch, let_go, partitions
from quern.llm.shingles import shingles

K1, B = 1.2, 0.75
#: Shortest stride of passages, in words.
STRIDE = 64
#: Items of a range that has a block maximum, and postings of a shard of the index. Neither changes a result.
BLOCK, POSTINGS = 8, 400_000
#: Bytes of text that meet the shards at once, and pairs of a passage's term and a block held at once.
TEXTS, ENTRIES = 16 << 20, 1_000_000
_SLACK = 1e-9


def words(texts: list[str | None]) -> list[np.ndarray]:
    return sh.words(texts, marks=False)


def stride_of(length):
    """Passages that an item of ``length`` words is looked for in advance by so many words and are twice as long; it depends on the item alone."""
    return max(STRIDE, 1 << (int(length) - 1).bit_length())


def expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``sizes`` numbers from ``starts`` on: the number of the range, and the numbers."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


@dataclass
class Item:
    item_id: int | None
    terms: np.ndarray
    impacts: np.ndarray
    question: np.ndarray
    answer: np.ndarray


class Shard:
    """Postings of some items of one stride, with impacts scaled by each item's own score, so one threshold serves all items.

    A term's postings are (item, impact) in ascending order of items. Items are numbered so that those that share
    their most frequent term lie together, and every ``BLOCK`` of them are a block: of each term that occurs in a
    block the index has the largest impact there and where its postings begin. ``term_max`` is the largest of all.
    """

    ARRAYS = ("ids", "terms", "key", "impact", "term_max", "block_ptr", "block_no", "block_max", "block_start", "block_end", "question", "q_ptr", "answer", "a_ptr")

    def __init__(self, arrays: dict[str, np.ndarray], stride: int):
        self.__dict__.update(arrays)
        self.stride, self.n = stride, len(self.ids)
        self.blocks = -(-self.n // BLOCK)
        self.item = self.key % self.n
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, items: list[Item], stride: int) -> Shard:
        n, sizes = len(items), [len(i.terms) for i in items]
        every = np.concatenate([i.terms for i in items])
        terms, row = np.unique(every, return_inverse=True)
        key = row.astype(np.int64) * n + np.repeat(np.arange(n), sizes)
        order = np.argsort(key)
        key, impact = key[order], np.concatenate([i.impacts for i in items])[order]
        row, block = key // n, key % n // BLOCK
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
        a = {
            "ids": np.array([(0, 1) if i.item_id is None else (i.item_id, 0) for i in items], np.int64), "terms": terms, "key": key, "impact": impact,
            "term_max": np.maximum.reduceat(impact, np.searchsorted(row, np.arange(len(terms)))), "block_ptr": np.searchsorted(row[start], np.arange(len(terms) + 1)), "block_no": block[start],
            "block_max": np.maximum.reduceat(impact, start), "block_start": start, "block_end": np.r_[start[1:], len(key)],
        }
        for name, at, parts in (("question", "q_ptr", [i.question for i in items]), ("answer", "a_ptr", [i.answer for i in items])):
            a[name], a[at] = np.concatenate(parts).astype(np.uint64), np.r_[0, np.cumsum([len(x) for x in parts])]
        return cls(a, stride)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, stride=np.array(self.stride), **{x: getattr(self, x) for x in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, f) -> Shard:
        with np.load(io.BytesIO(f.read())) as z:
            return cls({x: z[x] for x in cls.ARRAYS}, int(z["stride"]))

    def item_id(self, j: int) -> int | None:
        return None if self.ids[j, 1] else int(self.ids[j, 0])

    def parts(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        return self.question[self.q_ptr[j] : self.q_ptr[j + 1]], self.answer[self.a_ptr[j] : self.a_ptr[j + 1]]

    def search(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of every item that scores ``threshold`` or more for passage h[start:end]."""
        known = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.terms, h[known]), len(self.terms) - 1)
        found = self.terms[row] == h[known]
        known, row = known[found], row[found]
        lo, hi = np.searchsorted(known, starts), np.searchsorted(known, ends)
        load = np.cumsum(np.r_[0, np.diff(self.block_ptr)[row]])
        cost = np.cumsum(load[hi] - load[lo])
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + ENTRIES, "right")))
            for p, j, score in zip(*self._passages(row, lo[at:to], hi[at:to], threshold - _SLACK), strict=True):
                yield p + at, j, score
            at = to

    def _passages(self, row, lo, hi, threshold):
        """Live blocks: a passage's distinct terms add up their block maxima, and blocks that stay below the threshold are skipped."""
        n_terms = len(self.terms)
        passage, position = expand(lo, hi - lo)
        code = np.sort(passage * n_terms + row[position])
        code = code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code
        passage, term = code // n_terms, code % n_terms
        alive = np.bincount(passage, self.term_max[term], len(lo)) >= threshold  # no pivot at all without it
        passage, term = passage[alive[passage]], term[alive[passage]]
        which, b = expand(self.block_ptr[term], self.block_ptr[term + 1] - self.block_ptr[term])
        pair = passage[which] * self.blocks + self.block_no[b]
        live = np.bincount(pair, self.block_max[b], len(lo) * self.blocks) >= threshold
        some = live[pair]
        pair, item, score = self._pivots(pair[some], b[some], threshold)
        return (pair // self.blocks).tolist(), item.tolist(), score.tolist()

    def _pivots(self, pair, b, threshold):
        """WAND inside the live blocks, for all (passage, block) pairs side by side.

        The cursors of a pair are put in order of their items. The first item at which the maxima of the cursors so
        far reach the threshold is its pivot: no smaller item can score enough. The cursors before it skip to the
        pivot, it is scored, and all move past it, until no cursors of the pair reach the threshold.
        """
        cur, end, most = self.block_start[b], self.block_end[b], self.block_max[b]
        out = []
        while len(pair):
            order = np.argsort(pair * self.n + self.item[cur])
            pair, cur, end, most = pair[order], cur[order], end[order], most[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            sizes = np.diff(np.r_[first, len(pair)])
            total = np.cumsum(most)
            total -= np.repeat((total - most)[first], sizes)
            pivot = np.minimum.reduceat(np.where(total >= threshold, np.arange(len(pair)), len(pair)), first)
            going = np.repeat(pivot < len(pair), sizes)
            target = np.repeat(self.item[cur[np.minimum(pivot, len(pair) - 1)]], sizes)[going]
            pair, cur, end, most = pair[going], cur[going], end[going], most[going]
            behind = self.item[cur] < target
            cur[behind] = np.searchsorted(self.key, self.key[cur[behind]] - self.item[cur[behind]] + target[behind])
            here = (cur < end) & (self.item[np.minimum(cur, len(self.item) - 1)] == target)
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, int)
            score = np.add.reduceat(np.where(here, self.impact[np.minimum(cur, len(self.item) - 1)], 0.0), first) if len(pair) else np.zeros(0)
            good = score >= threshold
            if good.any():
                out.append((pair[first[good]], target[first[good]], score[good]))
            cur = cur + here
            left = cur < end
            pair, cur, end, most = pair[left], cur[left], end[left], most[left]
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def overlap(part: np.ndarray, passage: np.ndarray, k: int) -> float:
    """Share of the part's distinct shingles of ``k`` words (of all its words, if fewer) that the passage has; 1 without words."""
    k = min(k, len(part))
    if not k:
        return 1.0
    own = np.unique(shingles(part, k))
    return float(np.isin(own, shingles(passage, k)).mean()) if len(passage) >= k else 0.0


@lru_cache(8)
def _shard(base: str, name: str) -> Shard:
    with Files(base).open(name) as f:
        return Shard.load(f)


@dataclass
class Index:
    """The shards of an index in the shared folder, and what makes a passage a leak. Tasks load shard after shard."""

    base: str
    shards: list[str]
    threshold: float = 0.7
    share: float = 0.8
    answer_share: float = 0.6
    k: int = 5

    def texts(self, texts: list[str | None]) -> list[dict]:
        """For each text: item_id to (score, question's overlap, answer's overlap, first word of the passage), best passage first."""
        h = words(texts)
        out: list[dict] = [{} for _ in texts]
        every = np.concatenate(h) if h else np.zeros(0, np.uint64)
        sizes = np.array([len(x) for x in h], np.int64)
        base = np.r_[0, np.cumsum(sizes)]
        for name in self.shards:
            shard = _shard(self.base, name)
            count = np.where(sizes > 0, np.maximum(1, -(-sizes // shard.stride) - 1), 0)
            which, nth = expand(np.zeros(len(count), np.int64), count)
            starts = base[which] + nth * shard.stride
            ends = np.minimum(starts + 2 * shard.stride, base[which + 1])
            for p, j, score in shard.search(every, starts, ends, self.threshold):
                (question, answer), passage = shard.parts(j), every[starts[p] : ends[p]]
                q, a = overlap(question, passage, self.k), overlap(answer, passage, 1)
                if q >= self.share and a >= self.answer_share:
                    row, mine, item = (round(score, 6), q, a, int(starts[p] - base[which[p]])), out[which[p]], shard.item_id(j)
                    if item not in mine or (row[:3], -row[3]) > (mine[item][:3], -mine[item][3]):
                        mine[item] = row
        return out

    def batches(self, batches, at: int):
        """Batches with what :meth:`texts` finds in their column ``at``; a few at a time, so that shards serve many texts."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(at).nbytes
            if size >= TEXTS:
                yield from self._solve(held, at)
                held, size = [], 0
        yield from self._solve(held, at)

    def _solve(self, held, at):
        found = self.texts([x for b in held for x in b.column(at).to_pylist()])
        for b in held:
            yield b, found[: b.num_rows]
            found = found[b.num_rows :]


def build(items: DataFrame, threshold: float = 0.7, share: float = 0.8, answer_share: float = 0.6, k: int = 5, item_id: str = "item_id", text: str = "text", question: str | None = None, answer: str | None = None, postings: int = POSTINGS) -> Index:
    """Writes the index of all items to the shared folder, shard by shard; the driver learns only the shards' names.

    Document frequencies and the mean length are those of all items. Without columns for the two parts, the
    question is the first three quarters of an item's words and the answer the rest. Items without words (null and
    empty texts) are left out; rows that repeat, or share an identifier or have none, are items of their own. Other
    columns are never read. ``postings`` bounds a shard, and so the memory of a task; it changes no result.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "benchmark")
    cols = [F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")]
    cols += [F.col(c).cast("string").alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((question, "q"), (answer, "a"))]
    longs = pa.list_(pa.int64())

    def prepare(batches):
        for b in batches:
            rows = []
            for i, x, w, q, a in zip(b.column(0).to_pylist(), zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True), *(words(b.column(c).to_pylist()) for c in (1, 2, 3)), strict=True):
                if len(w):
                    cut = max(1, (3 * len(w)) // 4)
                    q, a = (w[:cut], w[cut:]) if x == (None, None) else (q, a)
                    t, c = np.unique(w, return_counts=True)
                    rows.append((i, len(w), t.view(np.int64), c.astype(np.int64), q.view(np.int64), a.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), longs, longs, longs, longs], strict=True)], ["item_id", "length", "terms", "counts", "q", "a"])

    rows = items.select(*cols).mapInArrow(prepare, "item_id long, length long, terms array<long>, counts array<long>, q array<long>, a array<long>")
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).first()
    if not total["n"]:
        return Index(scratch.path("shards"), [], threshold, share, answer_share, k)
    n, mean = total["n"], total["words"] / total["n"]
    entries = rows.select("row", "length", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("row", "length", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
    frequency = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    # each item's most frequent term: items that share it get numbers next to each other
    weighted = entries.join(frequency, "term").groupBy("row").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("weights"), F.max(F.struct("df", "term"))["term"].alias("theme"))
    ready = rows.join(weighted, "row").select("row", "item_id", "length", "theme", F.col("weights.term").alias("terms"), F.col("weights.w").alias("weights"), "q", "a")
    ready = ready.withColumn("stride", F.greatest(F.lit(STRIDE), F.pow(F.lit(2), F.ceil(F.log2(F.col("length")) - 1e-9))).cast("long"))
    to = scratch.path("shards")

    def write(batches):
        files, part, held, size, stride, made = Files(to), TaskContext.get().partitionId(), [], 0, 0, []

        def close():
            name = f"items-{part:06d}-{len(made):06d}.npz"
            files.write(name, [Shard.of(held, stride).dump()])
            made.append(name)

        for b in batches:
            for i, length, terms, weights, q, a in zip(*(b.column(x).to_pylist() for x in ("item_id", "length", "terms", "weights", "q", "a")), strict=True):
                if held and (stride != stride_of(length) or size + len(terms) > postings):
                    close()
                    held, size = [], 0
                stride, size, w = stride_of(length), size + len(terms), np.array(weights)
                held.append(Item(i, np.array(terms, np.int64).view(np.uint64), w / w.sum(), np.array(q, np.int64).view(np.uint64), np.array(a, np.int64).view(np.uint64)))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["name"])

    heavy = rows.agg(F.sum(F.size("terms"))).first()[0]
    ordered = ready.repartitionByRange(max(1, min(partitions(spark), -(-heavy // postings))), "stride", "theme", "length", "row").sortWithinPartitions("stride", "theme", "length", "row")
    names = scratch.keep(ordered.mapInArrow(write, "name string"), "names")
    return Index(to, sorted(r["name"] for r in names.collect()), threshold, share, answer_share, k)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, passage: a row for each document and item it holds.

    Every passage of every text is a query: windows whose length depends on the item's alone (:func:`stride_of`; at least
    128 words and twice the item), each half over the next, so an item lies whole in one of them. All items that score
    ``threshold`` of their own score are retrieved; a leak is one of which the passage has ``share`` of the question's
    ``k``-word shingles and ``answer_share`` of the answer's words. The row tells of the best passage, the first of equal
    ones. Case and ASCII marks don't count.

    Null and empty texts hold nothing. A row that repeats gives its rows again; a null identifier stays null. Without
    items, or documents, there are no rows. Columns other than those named are never read, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    index, types = build(items, **how), [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()]

    def run(batches):
        let_go()
        for b, maps in index.batches(batches, 1):
            found = [(i, item, *x) for i, m in zip(b.column(0).to_pylist(), maps, strict=True) for item, x in m.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage"])

    return rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage long")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no item, as :func:`leaks` says.

    Null and empty texts stay, as do all rows where there are no items. Equal rows stay or go together.
    """
    at, index = docs.columns.index(text), build(items, **how)

    def run(batches):
        let_go()
        for b, maps in index.batches(batches, at):
            yield b.filter(pa.array([not m for m in maps], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
