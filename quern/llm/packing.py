"""Sequences of equal size from documents (operator 2), by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let_go
from quern.llm.tokens import encoded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Divides items among k windows so that the windows' sums are nearly equal.

    Each item begins as a partial partition of its own. The two partial partitions with the largest
    imbalance are merged, the largest window of one with the smallest of the other, until one is left.
    A partial partition holds its windows that aren't empty, largest first, as (sum, members).
    """

    def imbalance(p):
        return p[0][0] - (p[-1][0] if len(p) == k else 0)

    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)] if k > 1 else []
    if not heap:
        return [list(range(len(sizes)))] if sizes else []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heap[0]
        both = len(a) + len(b) - k
        if both <= 0:
            merged = a + b
        else:
            cut = len(a) - both  # windows a[cut:] meet b's, its smallest with the largest
            merged = a[:cut] + b[: len(b) - both] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[cut:], reversed(b[len(b) - both :]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        heapq.heapreplace(heap, (-imbalance(merged), i, merged))
    out = []
    for _, tree in heap[0][2]:
        todo, got = [tree], []
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                got.append(x)
        out.append(sorted(got))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As many windows as the sum needs, and more as long as one exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        got = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in got):
            return got
        k += max(1, k // 200)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, piece: int = 256, block: int = 700, end_id: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids; one row per piece.

    Each full ``capacity`` of a document is a sequence of its own. What remains of it is cut into pieces of
    at most ``piece`` ids, and blocks of ``block`` pieces are divided among windows by differencing. Every
    task packs what it reads: nothing is shuffled, and a block bounds the memory. A sequence's number is the
    partition's number times 2^33 plus a running one, so a repeated task gives the same rows.

    A null text is an empty document of one id, the end id. Documents with a null or repeated identifier are
    packed like any other. An empty table gives no rows. ``with_ids`` adds the piece's ids.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    arrow = pa.schema([(n, pa.int64()) for n in SCHEMA.replace(" long", "").split(", ")] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        let_go(encoder=False)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting: list[tuple] = []  # doc_id, start, ids, length of the document

        def put(piece_, offset):
            i, start, ids, n = piece_
            rows.append((i, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset) + ((np.frombuffer(ids, "<u4").astype("i4").tolist(),) if with_ids else ()))

        def flush():
            nonlocal sequence
            for w in windows([len(x[2]) // 4 for x in waiting], capacity):
                offset = 0
                for j in w:
                    put(waiting[j], offset)
                    offset += len(waiting[j][2]) // 4
                sequence += 1
            waiting.clear()

        def out():
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            rows.clear()
            return got

        for names, ids in encoded(batches, tokenizer, end_id):
            for i, x in zip(names, ids, strict=True):
                n, at = len(x) // 4, 0
                while n - at >= capacity:
                    put((i, at, x[4 * at : 4 * (at + capacity)], n), 0)
                    sequence += 1
                    at += capacity
                while at < n:
                    to = min(n, at + piece)
                    waiting.append((i, at, x[4 * at : 4 * to], n))
                    at = to
                if len(waiting) >= block:
                    flush()
            if len(rows) > 5000 or with_ids:
                yield out()
        flush()
        yield out()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
