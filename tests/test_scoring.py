"""Batches of about equal lengths: what padding costs, what a batch may hold, and ranks that don't depend on it."""

import random

import pandas as pd
import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from quern.operators import scoring as SC


def padding(batches, text="chunk"):
    """What a model reads beyond the texts when each batch is padded to its longest."""
    sizes = [[len(t or "") for t in b[text]] for b in batches]
    return sum(len(s) * max(s) - sum(s) for s in sizes)


def frames(sizes, each):
    df = pd.DataFrame({"i": range(len(sizes)), "chunk": ["x" * n if n else None for n in sizes]})
    return [df.iloc[at : at + each] for at in range(0, len(df), each)]


@pytest.mark.parametrize("seed", range(8))
def test_padding_is_bounded_by_a_batch_of_the_longest(seed):
    rnd = random.Random(seed)
    longest = rnd.choice((100, 1500))
    sizes = [rnd.choice((rnd.randint(0, 40), rnd.randint(0, longest))) for _ in range(rnd.randint(1, 1200))]
    cut = SC.Batches(rows=20, window=25)
    got = list(cut.of(frames(sizes, rnd.choice((1, 7, 300, 5000))), "chunk"))
    assert sorted(i for b in got for i in b["i"]) == list(range(len(sizes))) and max(map(len, got)) <= 20
    windows = -(-len(sizes) // (20 * 25))
    assert padding(got) <= windows * 20 * max(sizes)
    if len(sizes) > 400:
        assert padding(got) < padding(SC.Batches(20, window=1).of(frames(sizes, 300), "chunk")) / 4


def test_long_texts_make_smaller_batches():
    sizes = [10] * 50 + [400] * 9 + [5000, 3, 0]
    got = list(SC.Batches(rows=20, window=10, padded=1000).of(frames(sizes, 11), "chunk"))
    held = [[len(t or "") for t in b["chunk"]] for b in got]
    assert all(len(s) * max(s) <= 1000 or len(s) == 1 for s in held) and [5000] in held
    assert sorted(sum(held, [])) == sorted(sizes) and max(map(len, held)) == 20
    assert [400, 400] in held


def test_edges_of_batches():
    assert list(SC.Batches().of([], "chunk")) == []
    assert [len(b) for b in SC.Batches(rows=3, window=1).of(frames([5, 1, 9, 2], 4), "chunk")] == [3, 1]
    assert [list(b["i"]) for b in SC.Batches(rows=3, window=1).of(frames([5, 1, 9, 2], 2), "chunk")] == [[0, 1, 2], [3]]
    assert [list(b["i"]) for b in SC.Batches(rows=2, window=2).of(frames([7, 7, 7, 7, 7], 5), "chunk")] == [[0, 1], [2, 3], [4]]  # ties stay in order
    words = SC.Batches(rows=2, window=5, length=lambda t: len(t.split()))
    df = pd.DataFrame({"i": range(4), "chunk": ["a b c", "dddddddddd", "e f g", "h"]})
    assert [set(b["i"]) for b in words.of([df], "chunk")] == [{1, 3}, {0, 2}]


def test_ranks_do_not_depend_on_batches(spark):
    vocabulary = ["sql", "web", "math", "io", "ui"]
    df = spark.range(300).select(F.col("id").alias("i"), F.when(F.col("id") % 17 != 0, F.expr("repeat(cast(id as string), cast(id * 7 % 90 as int))")).alias("chunk"))
    loader = SC.stub_loader(vocabulary)
    of = lambda batch: sorted(map(tuple, SC.best(df, loader, vocabulary, ["i"], 3, batch).collect()))
    want = of(SC.Batches(20, window=1))
    assert len(want) == 900
    for batch in (7, SC.Batches(64, 3, padded=2000), SC.Batches(1), SC.Batches(500, 1000)):
        assert of(batch) == want
    flat = lambda batch: sorted(map(tuple, SC.logits(df, loader, vocabulary, ["i"], batch).collect()))
    assert flat(SC.Batches(33, 2, 500)) == flat(SC.Batches(20, window=1))
    assert SC.best(df.limit(0), loader, vocabulary, ["i"]).count() == 0


def test_the_profile_reaches_the_plan(spark):
    need = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    df = spark.createDataFrame([(1, "a")], "i long, chunk string")
    for f in (SC.best, SC.logits):
        plan = f(df, SC.stub_loader(["a"]), ["a"], ["i"], profile=need)._jdf.queryExecution().analyzed().toString()
        assert "Profile" in plan and "Profile" not in f(df, SC.stub_loader(["a"]), ["a"], ["i"])._jdf.queryExecution().analyzed().toString()
