"""The prefix trie of conversations by an LCP-aware external mergesort (operator 11).

A conversation is the sequence of its turns' SHA-256 digests, in the order of the turns. Spark deals all conversations
by sampled splitters into ranges of the order (sequence, conv_id). Within a range each batch of rows is sorted into a run
that carries the number of turns every sequence shares with the one before it (its LCP); a loser tree merges the runs and
compares two sequences from where their LCPs with the last winner end, and not at all where these differ. The merged
stream keeps a stack of open nodes, the path of the conversation it is at: what the next one doesn't share is finished.

Only the path of a range's first conversation and that of its last can go on in other ranges. These paths, a few rows a
range, pass once more through such a stack, in the order of the ranges, and come out as whole nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, partitions

#: Bytes of a turn's digest, bytes of sequences in a range, and identifiers in one row of a node's ends.
TURN, RANGE, ENDS = 32, 16_000_000, 8192
#: What the rows of a range are: nodes, nodes whose parent is open, open nodes; and of the second pass: nodes, links.
NODE, WAITING, OPEN, WHOLE, LINK = range(5)
_PARTS = "kind int, part long, at long, chunk int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, digest binary, ends string"
_WHOLES = "kind int, part long, at long, node long, parent_node long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")

Entry = tuple[bytes, int, list[int]]  # sequence, conv_id, words of its turns


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, digest, words)) of ``turns`` (conv_id, turn, role, text), in the order of turns.

    A null turn comes first; turns of one number come in the order of their digests. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation. Texts are hashed before the shuffle; a task holds the digests of one
    conversation at a time, never its texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), words.alias("words")).alias("x"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def regrafted(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c begins with the first h turns of c - c % ``group``, then come its own after its first h.

    h is the crc32 of c's decimal digits modulo ``most``; % keeps the sign of c, as in SQL. A head that is shorter is
    taken whole, one that is absent is empty. Each head meets at most ``group`` conversations (twice as many around 0).
    """
    heads = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice(F.col("head"), F.lit(1), F.col("h"))
    return convs.join(heads, "base", "left").select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(head, own)).alias("turns"))


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns two sequences share, given that they share ``at``."""
    most = min(len(a), len(b))
    i = at * TURN
    while i < most and a[i : i + TURN] == b[i : i + TURN]:
        i += TURN
    return i // TURN


class Run:
    """A sorted run of entries, each with its LCP with the entry before it; the first has 0."""

    def __init__(self, entries: list[Entry]):
        self.entries = sorted(entries, key=lambda e: e[:2])
        self.lcps = [0, *(shared(x[0], y[0]) for x, y in zip(self.entries, self.entries[1:], strict=False))]


def merged(runs: list[Run]) -> Iterator[tuple[Entry, int]]:
    """All entries in the order (sequence, conv_id), each with its LCP with the one before it, by a tree of losers.

    Each run's next entry knows its LCP with the last winner: from its run if it follows the winner there, otherwise
    from the comparison that it lost. The larger LCP wins without a look at the sequences.
    """
    size = 1
    while size < len(runs):
        size *= 2
    runs = [*runs, *[Run([])] * (size - len(runs))]
    heads = [r.entries[0] if r.entries else None for r in runs]
    lcps, at = [0] * size, [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP is then that with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if lcps[x] != lcps[y]:
            return (x, y) if lcps[x] > lcps[y] else (y, x)
        n = shared(a[0], b[0], lcps[x])
        i = n * TURN
        first = (a[0][i : i + TURN], a[1]) < (b[0][i : i + TURN], b[1])  # nothing is left of the shorter one
        winner, loser = (x, y) if first else (y, x)
        lcps[loser] = n
        return winner, loser

    losers = [0] * size

    def first_round(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(first_round(2 * node), first_round(2 * node + 1))
        return winner

    winner = first_round(1)
    while (entry := heads[winner]) is not None:
        yield entry, lcps[winner]
        run, at[winner] = runs[winner], at[winner] + 1
        more = at[winner] < len(run.entries)
        heads[winner] = run.entries[at[winner]] if more else None
        lcps[winner] = run.lcps[at[winner]] if more else 0
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _ends(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


class _Node:
    __slots__ = ("at", "conv_id", "depth", "digest", "ends", "n_children", "n_convs", "n_leaves", "saved", "waiting", "words")

    def __init__(self, depth: int, digest: bytes, words: int, at: int | None):
        self.depth, self.digest, self.words, self.at = depth, digest, words, at
        self.conv_id: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ends: list[str] = []
        self.waiting: list[tuple] = []  # finished children, until this node's conv_id is known

    def take(self, conv_id: int | None, n_convs: int, n_leaves: int, saved: int) -> None:
        """Adds a finished child, or what is known of this node elsewhere."""
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id
        self.n_convs += n_convs
        self.n_leaves += n_leaves
        self.saved += saved


def nodes_of_range(stream: Iterator[tuple[Entry, int]], part: int) -> Iterator[tuple]:
    """Rows of ``_PARTS`` of one range: nodes that lie in it, and what it knows of those on its first and last path."""
    stack: list[_Node] = []
    opened = 0

    def close(node: _Node) -> Iterator[tuple]:
        if node.at is not None:
            yield from ((WAITING, part, node.at, 0, *row) for row in node.waiting)
            for k in range(0, max(1, len(node.ends)), ENDS):
                counts = (node.n_convs, node.n_children, node.n_leaves, node.saved) if not k else (0, 0, 0, 0)
                yield (OPEN, part, node.at, k // ENDS, node.conv_id, node.depth, None, *counts, node.words, node.digest, ",".join(node.ends[k : k + ENDS]))
            return
        yield from ((NODE, part, None, 0, *row[:2], node.conv_id, *row[3:]) for row in node.waiting)
        leaves, saved = node.n_leaves or 1, node.saved + (node.n_convs - 1) * node.words
        up = stack[-1]
        up.take(node.conv_id, node.n_convs, leaves, saved)
        up.n_children += 1
        up.waiting.append((node.conv_id, node.depth, None, node.n_convs, node.n_children, leaves, saved, None, None, _ends(node.ends)))

    for (path, conv_id, words), lcp in stream:
        while len(stack) > max(lcp, 0) + 1:
            yield from close(stack.pop())
        first = not stack
        if first:
            stack.append(_Node(0, b"", 0, 0))
        for d in range(len(stack), len(path) // TURN + 1):
            stack.append(_Node(d, path[(d - 1) * TURN : d * TURN], words[d - 1], d if first else None))
        if first:
            opened = len(stack)
        stack[-1].take(conv_id, 1, 0, 0)
        stack[-1].ends.append(str(conv_id))
    for node in stack:
        if node.at is None:
            node.at, opened = opened, opened + 1
    while stack:
        yield from close(stack.pop())


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of sequences to its rows; each batch is a run."""
    runs = [Run([(path, conv_id, words) for conv_id, path, words in _rows(b)]) for b in batches]
    context = TaskContext.get()
    yield from _batches(nodes_of_range(merged(runs), context.partitionId() if context else 0), _arrow(_PARTS))


class _Whole:
    __slots__ = ("hash", "known", "node", "parent", "some")

    def __init__(self, node: int, parent: int | None, known: _Node):
        self.node, self.parent, self.known, self.some, self.hash = node, parent, known, False, hashlib.sha256()


def whole_nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of ``_WHOLES`` from the open nodes of all ranges, in the order (part, at, chunk)."""
    stack: list[_Whole] = []
    made = 0

    def close() -> tuple:
        w = stack.pop()
        k = w.known
        leaves, saved = (k.n_leaves if k.n_children else 1), k.saved + (k.n_convs - 1) * k.words
        if stack:
            stack[-1].known.take(k.conv_id, k.n_convs, leaves, saved)
            stack[-1].known.n_children += 1
        return (WHOLE, None, None, w.node, w.parent, k.conv_id, k.depth, k.n_convs, k.n_children, leaves, saved, w.hash.hexdigest())

    for _, part, at, chunk, conv_id, depth, _, n_convs, n_children, n_leaves, saved, words, digest, ends in rows:
        if depth >= len(stack) or stack[depth].known.digest != digest:
            while len(stack) > depth:
                yield close()
            stack.append(_Whole(made, stack[-1].node if stack else None, _Node(depth, digest, words, None)))
            made += 1
        w = stack[depth]
        w.known.take(conv_id, n_convs, n_leaves, saved)
        w.known.n_children += n_children
        if ends:
            w.hash.update((("," if w.some else "") + ends).encode())
            w.some = True
        if not chunk:
            yield (LINK, part, at, w.node, None, None, None, None, None, None, None, None)
    while stack:
        yield close()


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(whole_nodes(row for b in batches for row in _rows(b)), _arrow(_WHOLES))


def trie(convs: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """One row per node of the prefix trie of ``convs`` (conv_id: distinct longs; turns: array of (digest: hex, words, ...)).

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent (null for the root), ``n_convs`` the members,
    ``n_children`` the children, ``n_leaves`` the nodes without children in the subtree, ``saved_tokens`` the words that
    need not be read again in the subtree, ``ends_sha256`` the SHA-256 of the comma-joined ids of the conversations that
    end at the node, in ascending order. Conversations without turns end at the root. Without conversations there is no
    node. Copies of one conversation, however many, are dealt to ranges like others: ranges cut between their ids.

    A task holds one range, about ``range_bytes`` of sequences or one conversation if that has more. The open paths of
    all ranges pass through one task as a stream: two paths for each range, and of a conversation's copies their ids,
    as SHA-256 can't be taken in parts; it holds one path.
    """
    spark = convs.sparkSession
    scratch = Scratch(spark, "trie")
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    kept = scratch.keep(convs.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["words"]).alias("words")), "sequences")
    size = kept.agg(F.sum(F.octet_length("path") + 16)).first()[0] or 0
    n = max(partitions(spark), -(-size // range_bytes))
    parts = scratch.keep(kept.repartitionByRange(n, "path", "conv_id").mapInArrow(_range, _PARTS), "ranges")
    paths = parts.filter(F.col("kind") == OPEN).repartition(1).sortWithinPartitions("part", "at", "chunk")
    wholes = scratch.keep(paths.mapInArrow(_wholes, _WHOLES), "paths")

    def counts(t: str = "") -> list[Column]:
        return [F.col(f"{t}{c}") for c in _COUNTS]

    nodes = wholes.filter(F.col("kind") == WHOLE)
    parents = nodes.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    links = wholes.filter(F.col("kind") == LINK).select("part", "at", F.col("node").alias("parent_node")).join(parents, "parent_node").drop("parent_node")
    inner = parts.filter(F.col("kind") == NODE).select("conv_id", "depth", "parent_conv_id", *counts(), F.col("ends").alias("ends_sha256"))
    under = parts.filter(F.col("kind") == WAITING).drop("parent_conv_id").join(links, ["part", "at"]).select("conv_id", "depth", "parent_conv_id", *counts(), F.col("ends").alias("ends_sha256"))
    across = nodes.join(parents, "parent_node", "left").select("conv_id", "depth", "parent_conv_id", *counts(), "ends_sha256")
    return inner.unionByName(under).unionByName(across)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """:func:`trie` of all conversations in ``turns`` (conv_id, turn, role, text), rebuilt by :func:`regrafted`.

    Nulls, ties and rows without a conv_id are as in :func:`sequences`; repeated rows are turns of their own; texts are
    hashed whole; other columns are never read, whatever they are called. An empty table gives no rows.
    """
    scratch = Scratch(turns.sparkSession, "conversations")
    return trie(regrafted(scratch.keep(sequences(turns.select("conv_id", "turn", "role", "text")), "conversations")))


#: h is the crc32 of a conversation's digits, byte by byte and bit by bit.
ORACLE = """
    WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
                      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({'x': x, 'w': words} ORDER BY turn NULLS FIRST, x) AS ts FROM t GROUP BY conv_id),
    h AS (SELECT *, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
              lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT)) % 4 AS INTEGER) AS h FROM own),
    c AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1 : h.h], []), h.ts[h.h + 1 :]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
    p AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts FROM c),
    m AS (SELECT conv_id, depth, n = depth AS ends, list_transform(ts[1 : depth], lambda v: v.x) AS path, CASE WHEN depth > 0 THEN ts[depth].w ELSE 0 END AS w FROM p),
    q AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, depth),
    k AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM q WHERE depth > 0 GROUP BY 1),
    a AS (SELECT q.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * w AS own FROM q LEFT JOIN k USING (path)),
    e AS (SELECT path[1 : up] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM a) GROUP BY 1)
    SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
    FROM a JOIN e USING (path) LEFT JOIN q u ON a.depth > 0 AND u.path = a.path[1 : a.depth - 1]"""
