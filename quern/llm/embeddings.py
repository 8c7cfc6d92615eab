"""Exact near-duplicate vectors (operator 3) by dual traversal of cover trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.components import components

#: Added to every bound, for rounding; a pair that a bound leaves open is decided by its cosine.
SLACK = 1e-7
#: Pairs of nodes looked at in one go, and the size from which the children of two nodes are multiplied as matrices.
PAIRS, DENSE = 1 << 18, 1 << 12
#: Points that may become centres of a level in one go.
BATCH = 256


def chords(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


class CoverTree:
    """Cover tree over unit vectors, by chords: nested nets whose radii halve from level to level.

    The net of level l is the first ``sizes[l]`` points of ``order``. Nesting: each net holds the one before.
    Covering: every point lies within ``radii[l]`` of its node's centre, and a centre that is new within
    ``radii[l - 1]`` of its parent's. Separation: centres of one net are more than ``radii[l]`` apart. The root
    covers everything; the last level is the first below ``floor``, or that where all points are centres.
    ``node[l]`` has each point's node of level l, ``reach[l]`` each node's true covering radius: the largest
    distance to a point below it.
    """

    def __init__(self, x: np.ndarray, floor: float):
        n = len(x)
        self.x, self.radii, self.sizes = x, [2.0], [1]
        place = np.full(n, -1)  # of a centre in the order
        order, parent, owner = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], np.zeros(n, np.int64)
        place[0], size = 0, 1
        dot = x @ x[0]
        while size < n and self.radii[-1] >= floor:
            r = self.radii[-1] / 2
            least = 1.0 - r * r / 2
            rest = np.flatnonzero(place < 0)
            loose = rest[dot[rest] < least]
            centres, before = np.concatenate(order), owner.copy()
            for at in range(0, len(centres), BATCH * 8):
                loose = self._take(loose, centres[at : at + BATCH * 8], at, least, owner, dot)
            while len(loose):
                first, loose = loose[:BATCH], loose[BATCH:]
                dots = x[first] @ x[first].T
                near = dots >= least
                free, new = np.ones(len(first), bool), []
                for i in range(len(first)):
                    if free[i]:
                        new.append(i)
                        free &= ~near[i]
                refused = np.flatnonzero(~np.isin(np.arange(len(first)), new))
                if len(refused):  # by the product that refused them: another one may round another way
                    theirs = dots[new][:, refused]
                    nearest = theirs.argmax(axis=0)
                    owner[first[refused]], dot[first[refused]] = size + nearest, theirs[nearest, np.arange(len(refused))]
                new = first[new]
                place[new] = np.arange(size, size + len(new))
                order.append(new)
                parent.append(before[new])
                loose = self._take(loose, new, size, least, owner, dot)
                owner[new], dot[new] = place[new], 1.0
                size += len(new)
            self.radii.append(r)
            self.sizes.append(size)
        self.order, parent = np.concatenate(order), np.concatenate(parent)
        at, self.node, self.reach, self.child = owner, [], [], []
        for level in range(len(self.sizes) - 1, -1, -1):
            inside = at < self.sizes[level]
            at = np.where(inside, at, parent[at])
            self.node.append(at)
            far = np.zeros(self.sizes[level])
            np.maximum.at(far, at, chords(np.einsum("ij,ij->i", x, x[self.order[at]])))
            alone = np.bincount(at, minlength=self.sizes[level]) == 1
            far[alone] = 0.0
            self.reach.append(far)
        self.node.reverse()
        self.reach.reverse()
        for level, upto in enumerate(self.sizes[1:]):
            up = np.r_[np.arange(self.sizes[level]), parent[self.sizes[level] : upto]]
            kids = np.argsort(up, kind="stable")
            self.child.append((np.r_[0, np.cumsum(np.bincount(up, minlength=self.sizes[level]))], kids))
        members = np.argsort(self.node[-1], kind="stable")
        self.child.append((np.r_[0, np.cumsum(np.bincount(self.node[-1], minlength=self.sizes[-1]))], members))

    def _take(self, points, centres, first, least, owner, dot):
        """Gives each point within the radius of a centre to the nearest; returns the others."""
        for at in range(0, len(points), 8192):
            some = points[at : at + 8192]
            d = self.x[some] @ self.x[centres].T
            best = d.argmax(axis=1)
            value = d[np.arange(len(some)), best]
            good = value >= least
            owner[some[good]], dot[some[good]] = first + best[good], value[good]
        return points[dot[points] < least] if len(points) else points

    @property
    def depth(self) -> int:
        return len(self.sizes)

    def level(self, level: int) -> int:
        return min(level, self.depth - 1)

    def kids(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Children of every node of a level; a tree whose last level is above stays where it is."""
        if level < self.depth - 1:
            return self.child[level]
        return np.arange(self.sizes[-1] + 1), np.arange(self.sizes[-1])


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the classes of i and j; ``label`` has each point's class, its smallest point."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


@dataclass
class Seen:
    """What a traversal has looked at: pairs of nodes, and pairs of points below nodes that no bound has decided."""

    nodes: int = 0
    points: int = 0
    #: The most open pairs of one level that were held together.
    held: int = 0


class _Taken:
    """What the pairs of nodes of one level that were taken whole give to the points below either: summed up by node."""

    def __init__(self, own: np.ndarray, others: np.ndarray):
        self.own, self.others = own, others
        self.gain_a, self.gain_b = np.zeros(len(own), np.int64), np.zeros(len(others), np.int64)
        self.whole_a, self.whole_b, self.itself = np.zeros(len(own), bool), np.zeros(len(others), bool), np.zeros(len(own), bool)

    def add(self, i: np.ndarray, j: np.ndarray, one: bool) -> None:
        self.whole_a[i], self.whole_b[j] = True, True
        np.add.at(self.gain_a, i, self.others[j])
        apart = (i != j) if one else np.ones(len(i), bool)
        np.add.at(self.gain_b, j[apart], self.own[i[apart]])
        self.itself[i[~apart]] = True


def _products(p, q, a, b, same):
    """Chunks of (rows, columns) of children of each pair: large ones as blocks for matrix products, the others side by side.

    Of a pair of a node with itself only column >= row counts. Yields (rows, columns, block): for a block the two
    are lists to be multiplied, else equally long arrays.
    """
    sizes = np.diff(a[0])[p], np.diff(b[0])[q]
    area = sizes[0] * sizes[1]
    for k in np.flatnonzero(area >= DENSE).tolist():
        rows, columns = a[1][a[0][p[k]] : a[0][p[k] + 1]], b[1][b[0][q[k]] : b[0][q[k] + 1]]
        step = max(1, PAIRS // len(columns))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], columns[at:] if same[k] else columns, True, bool(same[k])
    small = np.flatnonzero(area < DENSE)
    small = small[area[small] > 0]
    ends = np.cumsum(area[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        k = small[at:to]
        which = np.repeat(np.arange(len(k)), area[k])
        nth = np.arange(len(which)) - np.repeat(np.cumsum(area[k]) - area[k], area[k])
        i, j = nth // sizes[1][k][which], nth % sizes[1][k][which]
        good = ~same[k][which] | (j >= i)
        i, j, which = i[good], j[good], which[good]
        yield a[1][a[0][p[k]][which] + i], b[1][b[0][q[k]][which] + j], False, False
        at = to


def near_pairs(x: np.ndarray, weight: np.ndarray, first: np.ndarray, second: np.ndarray | None, cosine: float, seen: Seen | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each row and its class, over pairs inside ``first``, or between ``first`` and ``second``.

    Two trees are walked down together, from the pair of their roots. A pair of nodes goes when its centres are
    further apart than the covering radii and the threshold allow, and is taken whole when they are so close that
    all points below must be near; of the others the children meet. Only pairs of points that are left below the
    last level are decided one by one. As soon as some ``PAIRS`` pairs of a level are open they are walked to the end,
    so a level's open pairs, which may be a share of all pairs, are never held together.
    """
    links, label, most = np.zeros(len(x), np.int64), np.arange(len(x)), math.sqrt(2 - 2 * cosine)
    seen = seen if seen is not None else Seen()
    floor = most / 4
    a = CoverTree(x[first], floor)
    b = a if second is None else CoverTree(x[second], floor)
    other = first if second is None else second
    depth = max(a.depth, b.depth)
    xa = a.x[a.order]
    xb = xa if b is a else b.x[b.order]
    taken: dict[int, _Taken] = {}

    def meet(level: int, p: np.ndarray, q: np.ndarray) -> None:
        """Of the children of these pairs of nodes, which are of level ``level``, or points."""
        nonlocal label
        same = (p == q) if a is b else np.zeros(len(p), bool)
        if level == depth:
            for rows, columns, block, diagonal in _products(p, q, a.child[-1], b.child[-1], same):
                if block:
                    near = a.x[rows] @ b.x[columns].T >= cosine
                    if diagonal:
                        near &= np.arange(len(columns)) > np.arange(len(rows))[:, None]
                    seen.points += near.size
                    i, j = np.nonzero(near)
                    i, j = rows[i], columns[j]
                else:
                    near = (np.einsum("ij,ij->i", a.x[rows], b.x[columns]) >= cosine) & (True if a is not b else rows != columns)
                    seen.points += len(rows)
                    i, j = rows[near], columns[near]
                np.add.at(links, first[i], weight[other[j]])
                np.add.at(links, other[j], weight[first[i]])
                label = unite(label, first[i], other[j])
            return
        if level:
            kids_a, kids_b = a.kids(level - 1), b.kids(level - 1)
        else:
            kids_a = kids_b = (np.array([0, 1]), np.zeros(1, np.int64))
        la, lb = a.level(level), b.level(level)
        far_a, far_b = a.reach[la], b.reach[lb]
        open_, waiting, whole, gathered = [], 0, [], 0

        def take() -> None:
            nonlocal label, gathered
            i, j = (np.concatenate(c) for c in zip(*whole, strict=True))
            whole.clear()
            gathered = 0
            if level not in taken:
                taken[level] = _Taken(np.bincount(a.node[la], weight[first], a.sizes[la]).astype(np.int64), np.bincount(b.node[lb], weight[other], b.sizes[lb]).astype(np.int64))
            taken[level].add(i, j, a is b)
            label = unite(label, first[a.order[i]], other[b.order[j]])

        for rows, columns, block, diagonal in _products(p, q, kids_a, kids_b, same):
            if block:
                dots = xa[rows] @ xb[columns].T
                keep = 2.0 - 2.0 * dots <= (far_a[rows][:, None] + (far_b[columns] + (most + SLACK))) ** 2
                seen.nodes += dots.size
                if diagonal:
                    keep &= np.arange(len(columns)) >= np.arange(len(rows))[:, None]
                i, j = np.nonzero(keep)
                d, i, j = chords(dots[i, j]), rows[i], columns[j]
            else:
                seen.nodes += len(rows)
                d = chords(np.einsum("ij,ij->i", xa[rows], xb[columns]))
                keep = d <= far_a[rows] + far_b[columns] + (most + SLACK)
                d, i, j = d[keep], rows[keep], columns[keep]
            if a is b:
                d[i == j] = 0.0
            every = d + far_a[i] + far_b[j] < most - SLACK
            if every.any():
                whole.append((i[every], j[every]))
                gathered += len(whole[-1][0])
                if gathered >= PAIRS:
                    take()
            if not every.all():
                open_.append((i[~every], j[~every]))
                waiting += len(open_[-1][0])
                seen.held = max(seen.held, waiting)
                if waiting >= PAIRS:
                    now = [np.concatenate(c) for c in zip(*open_, strict=True)]
                    open_, waiting = [], 0
                    meet(level + 1, *now)
        if whole:
            take()
        if open_:
            now = [np.concatenate(c) for c in zip(*open_, strict=True)]
            open_.clear()
            meet(level + 1, *now)

    meet(0, np.zeros(1, np.int64), np.zeros(1, np.int64))
    for level, t in taken.items():
        na, nb = a.node[a.level(level)], b.node[b.level(level)]
        links[first] += t.gain_a[na]
        links[other] += t.gain_b[nb]
        if a is b:
            links[first] -= weight[first] * t.itself[na]
        label = unite(label, first[t.whole_a[na]], first[a.order[na[t.whole_a[na]]]])
        label = unite(label, other[t.whole_b[nb]], other[b.order[nb[t.whole_b[nb]]]])
    return links, label


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten()).astype("f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, block_bytes: int = 8 << 20, pivot_bytes: int = 32 << 20, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links at ``cosine`` or more between vectors of one label.

    Equal vectors of a label are one node with a weight, so copies cost nothing; they are told apart by 128-bit
    hashes and get numbers of their own. A block holds as many nodes as fit in ``block_bytes``. Labels of more are
    dealt to balls around pivots, the top of a tree that no task holds whole: one pivot for each block, so the
    pivots follow the label. A node visits another ball only within the ball's covering radius plus the threshold,
    and balls and their visitors are cut into parts by hash, so a task holds a bounded number of vectors whatever a
    label's size; a ball is sent as often as its own visitors, not the label, fill tasks. All pivots together take ``pivot_bytes`` of memory at most, the largest labels first; a label that
    has none is one ball, which prunes less and finds the same pairs. In a task, cover trees are walked pair by
    pair (:func:`near_pairs`); it returns sums of links and a spanning forest, never the pairs.

    A vector that is null, zero or has a null or non-finite component links with nothing, nor does one with
    a null label; vectors of different sizes don't meet. Rows with equal ids are rows of their own. A null id
    counts as the smallest. An empty table gives no rows. Other columns are never read, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    e = F.col("e")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"), F.col(label).cast("string").alias("label"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = e.isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumns({"dim": F.size("e"), "h": F.when(F.col("ok"), F.xxhash64("label", "e")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(7), "e", "label"))})
    kinds = rows.filter("ok").groupBy("label", "dim", "h", "h2").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("nameless"), F.first("e").alias("e"))
    nodes = scratch.keep(kinds.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stay
    size_of = F.greatest(F.lit(16), F.expr(f"{int(block_bytes)} div (8 * dim)"))
    sizes = scratch.keep(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("block", size_of.cast("long")), "sizes")
    big, room = {}, pivot_bytes
    # a label with pivots has two at least, so no more labels than this can have any
    for r in sizes.filter("n > block").orderBy(F.desc("n"), "label", "dim").limit(max(1, pivot_bytes // 16)).collect():
        want = min(-(-r["n"] // r["block"]), room // (8 * r["dim"]))
        if want > 1:
            big[r["label"], r["dim"]] = (want, r["n"])
            room -= want * 8 * r["dim"]
    centres: dict = {}
    if big:
        wanted = spark.createDataFrame([(k[0], k[1], max(1, v[1] // (2 * v[0]))) for k, v in big.items()], "label string, dim int, every long")
        for r in nodes.join(F.broadcast(wanted), ["label", "dim"]).filter("pmod(h, every) = 0").select("label", "dim", "h", "e").collect():
            centres.setdefault((r["label"], r["dim"]), []).append((r["h"], r["e"]))
        for k, v in centres.items():
            v.sort()
            x = np.array([y[1] for y in v[: big[k][0]]])
            x /= np.abs(x).max(axis=1, keepdims=True)
            centres[k] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    reach = math.sqrt(2 - 2 * cosine) + SLACK

    def groups(batch):
        """(label, dim, rows) of a batch."""
        keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
        at: dict = {}
        for i, k in enumerate(keys):
            at.setdefault(k, []).append(i)
        return [(k, np.array(v)) for k, v in at.items()]

    def assign(batches):
        for b in batches:
            cell, far = np.zeros(b.num_rows, "i4"), np.zeros(b.num_rows)
            for k, at in groups(b):
                if k in centres:
                    d = chords(_matrix(b.column("e").take(pa.array(at)), k[1]) @ centres[k].T)
                    cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    celled = nodes.join(sizes, ["label", "dim"]).select("label", "dim", "n", "block", "h", "node", "w", "e")
    if centres:
        celled = scratch.keep(celled.mapInArrow(assign, "label string, dim int, n long, block long, h long, node long, w long, e array<double>, cell int, far double"), "celled")
        balls = {(r["label"], r["dim"], r["cell"]): (r["r"], r["m"]) for r in celled.join(F.broadcast(wanted), ["label", "dim"], "left_semi").groupBy("label", "dim", "cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("m")).collect()}
    else:
        celled, balls = celled.withColumns({"cell": F.lit(0), "far": F.lit(0.0)}), {}

    def guests(batches):
        """How many vectors of this task visit each ball."""
        found: dict = {}
        for b in batches:
            cells = np.asarray(b.column("cell"))
            for (name, dim), at in groups(b):
                if (name, dim) in centres:
                    d = chords(_matrix(b.column("e").take(pa.array(at)), dim) @ centres[name, dim].T)
                    for c in range(d.shape[1]):
                        if (name, dim, c) in balls:
                            comes = int(((cells[at] < c) & (d[:, c] <= balls[name, dim, c][0] + reach)).sum())
                            found[name, dim, c] = found.get((name, dim, c), 0) + comes
        names, dims, cs = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(dims, pa.int32()), pa.array(cs, pa.int32()), pa.array(found.values(), pa.int64())], ["label", "dim", "cell", "visits"])

    visits: dict = {}
    if centres:
        counted = celled.mapInArrow(guests, "label string, dim int, cell int, visits long").groupBy("label", "dim", "cell").agg(F.sum("visits").alias("visits"))
        visits = {(r["label"], r["dim"], r["cell"]): r["visits"] for r in counted.collect()}

    def deal(batches):
        for b in batches:
            h = np.asarray(b.column("h")).astype("u8")
            cells, n, blocks = np.asarray(b.column("cell")), np.asarray(b.column("n")), np.asarray(b.column("block"))
            for (name, dim), at in groups(b):
                k, total, block = (name, dim), int(n[at[0]]), int(blocks[at[0]])
                own = cells[at]
                known = [(c, *balls[name, dim, c], visits.get((name, dim, c), 0)) for c in range(len(centres[k])) if (name, dim, c) in balls] if k in centres else [(0, 2.0, total, 0)]
                d = chords(_matrix(b.column("e").take(pa.array(at)), dim) @ centres[k].T) if k in centres else None
                for c, radius, m, v in known:
                    subs, g_all = max(1, -(-m // block)), max(1, -(-(m + v) // (8 * block)))
                    guest = (h[at] >> np.uint64(20)) % np.uint64(g_all)
                    sub = (h[at] >> np.uint64(8)) % np.uint64(subs)
                    here = own == c
                    visitors = own < c
                    if d is not None:
                        visitors &= d[:, c] <= radius + reach
                    for s in range(subs):
                        sent = [(at[here & (sub == s)], g, True) for g in range(g_all)]
                        comes = visitors | (here & (sub < s))
                        sent += [(at[comes & (guest == g)], g, False) for g in range(g_all)]
                        for take, g, home in sent:
                            if len(take):
                                some, size = pa.array(take), len(take)
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([name] * size), *(pa.array([v] * size, pa.int32()) for v in (dim, c, s, g)), pa.array([home] * size), *(b.column(x).take(some) for x in ("node", "w", "e"))],
                                    ["label", "dim", "cell", "sub", "g", "home", "node", "w", "e"],
                                )

    def work(t: pa.Table) -> pa.Table:
        node, w, home = np.asarray(t["node"]), np.asarray(t["w"]), np.asarray(t["home"])
        x = _matrix(t["e"], t["dim"][0].as_py())
        links, label_ = np.zeros(len(node), np.int64), np.arange(len(node))
        inside, others = np.flatnonzero(home), np.flatnonzero(~home)
        jobs = [(inside, None)] if t["g"][0].as_py() == 0 and len(inside) else []
        for first, second in jobs + ([(inside, others)] if len(inside) and len(others) else []):
            more, found = near_pairs(x, w, first, second, cosine)
            links += more
            label_ = unite(label_, np.arange(len(node)), found)
        some, joined = np.flatnonzero(links), np.flatnonzero(label_ != np.arange(len(node)))
        return pa.table({"a": pa.array(np.concatenate([node[some], node[joined]])), "b": pa.array(np.concatenate([links[some], node[label_[joined]]])), "edge": pa.array(np.concatenate([np.zeros(len(some), bool), np.ones(len(joined), bool)]))})

    dealt = celled.mapInArrow(deal, "label string, dim int, cell int, sub int, g int, home boolean, node long, w long, e array<double>")
    found = scratch.keep(dealt.groupBy("label", "dim", "cell", "sub", "g").applyInArrow(work, "a long, b long, edge boolean"), "found")
    links = found.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    comps = components(found.filter("edge").select("a", "b"), scratch).withColumnsRenamed({"component": "c"})
    own = nodes.select("node", "h", "h2", "w", "low", "nameless").join(links, "node", "left").join(comps, "node", "left").withColumn("c", F.coalesce("c", "node"))
    own = scratch.keep(own, "own")
    lowest = own.groupBy("c").agg(F.min("low").alias("lowest"), F.max("nameless").alias("nameless")).select("c", F.when(~F.col("nameless"), F.col("lowest")).alias("lowest"))
    by_node = own.drop("nameless").join(lowest, "c").select("h", "h2", "lowest", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.lit(True).alias("met"))
    out = rows.select("id", "h", "h2").join(by_node, ["h", "h2"], "left")
    component = F.when(F.col("met"), F.col("lowest")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
