"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.embeddings import CoverTree, Seen, chords, near_pairs, near_vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType())])


def brute(rows, cosine):
    n = len(rows)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ok, unit = [], []
    for _, e, label, _ in rows:
        good = e is not None and label is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)
        v = np.array(e, "f4").astype("f8") if good else None
        ok.append(good)
        unit.append(v / np.linalg.norm(v) if good else None)
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n))


def fixture(seed=5, n=360, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        v = base[int(rng.integers(40)) if i % 3 else 0] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3])
        rows.append((int(1000 - i), [float(x) for x in v], int(i % 3 == 2), "x"))
    rows += [(5000, None, 0, None), (5001, [0.0] * dim, 0, None), (5002, [float("nan")] + [1.0] * (dim - 1), 0, None), (5003, [None] + [1.0] * (dim - 1), 0, None), (5004, [1.0] * dim, None, None), (5005, [1.0, 2.0], 0, None), (5006, [2.0, 4.0], 0, None), (5007, [], 0, None)]
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_labels_in_one_task(spark):
    rows = fixture()
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93)) == brute(rows, 0.93)


def test_labels_dealt_to_balls_and_parts(spark):
    rows = fixture(7)
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93, block_bytes=16 * 8 * 12)) == brute(rows, 0.93)
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93, block_bytes=16 * 8 * 12, pivot_bytes=0)) == brute(rows, 0.93)


@pytest.mark.parametrize("entries", [(-1, 0, 1), (0, 1), (-1, 1)])
def test_quantised_vectors(entries):
    """Points lie exactly on the nets' radii, where products of different shapes round differently."""
    for seed in range(500):
        rng = np.random.default_rng(seed)
        dim = int(rng.choice([3, 4, 7, 16, 64]))
        x = np.unique(rng.choice(entries, size=(int(rng.integers(2, 120)), dim)).astype("f8"), axis=0)
        x = x[np.abs(x).max(axis=1) > 0]
        if not len(x):
            continue
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        exact = x @ x.T
        cosine = 0.93 if dim > 16 else float(rng.choice([0.5, 0.7, 0.93]))
        sure = np.abs(exact - cosine) > 1e-12
        if not sure.all():
            cosine -= 1e-9
        near = exact >= cosine
        np.fill_diagonal(near, False)
        links, _ = near_pairs(x, np.ones(len(x), np.int64), np.arange(len(x)), None, cosine)
        assert (links == near.sum(axis=1)).all()


def test_quantised_labels_in_the_query(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(y) for y in rng.choice([-1, 0, 1], 12)], int(i % 40), "x") for i in range(900)]
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93)) == brute(rows, 0.93)
    assert got(near_vectors(spark.createDataFrame([(a, b, 0, d) for a, b, _, d in rows], SCHEMA), 0.81, block_bytes=20 * 8 * 12)) == brute([(a, b, 0, d) for a, b, _, d in rows], 0.81)


def dealt(spark, n, monkeypatch):
    """Rows that near_vectors deals out, as its tasks get them: clusters of one label, more of them the larger n."""
    from quern.llm import embeddings

    seen = spark.sparkContext.accumulator(0)
    whole = embeddings.near_pairs

    def counting(x, w, first, second, cosine):
        seen.add(len(first) + (0 if second is None else len(second)))
        return whole(x, w, first, second, cosine)

    monkeypatch.setattr(embeddings, "near_pairs", counting)
    x = clustered(4, n // 50, 50, 4, 0.001)
    rows = [(i, [float(y) for y in v], 0, "x") for i, v in enumerate(x)]
    near_vectors(spark.createDataFrame(rows, SCHEMA), 0.9999, block_bytes=200 * 8 * 4).write.format("noop").mode("overwrite").save()
    monkeypatch.undo()
    return seen.value


def test_what_is_dealt_grows_with_the_label(spark, monkeypatch):
    """Once by the label's size, not by its square: a ball is repeated for its visitors alone."""
    small, large = dealt(spark, 4000, monkeypatch), dealt(spark, 16000, monkeypatch)
    assert large < 8 * small


def test_empty_table(spark):
    df = near_vectors(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"] and df.collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 1, None), (3, [1.0, 0.01], 1, None), (3, [0.0, 1.0], 1, None), (3, [0.0, 1.0], 1, None)]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found) == [("3", 1, "3"), ("3", 1, "3"), ("3", 1, "None"), ("None", 1, "None")]


def test_a_cosine_exactly_at_the_threshold_links(spark):
    rows = [(1, [1.0, 0.0], 1, None), (2, [3.0, 4.0], 1, None), (3, [2.999, 4.0], 1, None)]
    assert [r[1] for r in got(near_vectors(spark.createDataFrame(rows, SCHEMA), 0.6))] == [1, 2, 1]


def test_spread_vectors_of_64_dimensions_with_copies(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 64))
    x[250:] = x[:250] + rng.normal(size=(250, 64)) * rng.choice([0.0, 0.3, 0.38, 0.45], 250)[:, None]
    rows = [(i, [float(y) for y in v], 0, "x") for i, v in enumerate(x)]
    want = brute(rows, 0.93)
    assert 50 < sum(r[1] > 0 for r in want) < 450
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93)) == want
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("a"), "h": F.lit(None), "n": F.lit(1)}), 0.93, block_bytes=64 * 8 * 64)) == want


def clustered(seed, centres, each, dim, width):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(centres, dim)), each, axis=0) + rng.normal(size=(centres * each, dim)) * width
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [2, 8, 64])
def test_tree_is_nested_covers_and_separates(dim):
    x = clustered(1, 30, 20, dim, 0.2)
    tree = CoverTree(x, 0.05)
    assert tree.depth > 3
    for level in range(tree.depth):
        net, node = tree.order[: tree.sizes[level]], tree.node[level]
        far = chords(x[net] @ x[net].T) + 10 * np.eye(len(net))
        assert len(net) == 1 or far.min() > tree.radii[level] - 1e-9  # separation
        assert chords(x @ x[net].T).min(axis=1).max() <= tree.radii[level] + 1e-9  # covering
        below = np.linalg.norm(x - x[net[node]], axis=1)
        assert (below <= tree.reach[level][node] + 1e-7).all()
        if level:
            assert (tree.node[level - 1][net] == np.r_[np.arange(tree.sizes[level - 1]), tree.node[level - 1][net[tree.sizes[level - 1] :]]]).all()  # nesting
            radius = np.linalg.norm(x[net] - x[tree.order[tree.node[level - 1][net]]], axis=1)
            assert (radius <= tree.radii[level - 1] + 1e-9).all()
    assert len(set(tree.order.tolist())) == tree.sizes[-1]


@pytest.mark.parametrize(("dim", "width"), [(3, 0.2), (8, 0.1), (64, 0.03), (64, 1.0)])
def test_traversal_is_exact_and_bounds_decide_most_pairs(dim, width):
    x = clustered(2, 40, 25, dim, width)
    n, rng, seen = len(x), np.random.default_rng(3), Seen()
    weight = rng.integers(1, 4, n)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links, _ = near_pairs(x, weight, np.arange(n), None, 0.9, seen)
    assert (links == near @ weight).all()
    if width < 1:  # clusters: nodes stand for most pairs of points
        assert seen.nodes + seen.points < 0.2 * n * (n - 1) / 2
    first = rng.permutation(n)[:300]
    second = np.setdiff1d(np.arange(n), first)
    across = np.zeros_like(near)
    across[np.ix_(first, second)] = near[np.ix_(first, second)]
    links, label = near_pairs(x, weight, first, second, 0.9)
    assert (links == (across | across.T) @ weight).all()
    assert (label[first][:, None] == label[second])[near[np.ix_(first, second)]].all()


def test_open_pairs_are_not_held_together(monkeypatch):
    from quern.llm import embeddings

    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(300, 64)), 4, axis=0) + rng.normal(size=(1200, 64)) * 0.35
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    for first, second in ((np.arange(1200), None), (np.arange(400), np.arange(400, 1200))):
        monkeypatch.setattr(embeddings, "PAIRS", 1 << 10)
        seen = Seen()
        links, label = near_pairs(x, np.ones(1200, np.int64), first, second, 0.93, seen)
        met = near & ~np.eye(1200, dtype=bool) if second is None else near & ((np.arange(1200) < 400)[:, None] != (np.arange(1200) < 400))
        assert links.tolist() == met.sum(axis=1).tolist() and seen.held <= 4 * (1 << 10)
