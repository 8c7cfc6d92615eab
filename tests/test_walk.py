"""The walk for repositories on executors against the plain one."""

import os
import random

import pytest

from quern.sources import git as G


def tree(root, seed, folders=150):
    """A tree in which one folder in four is a repository, some are hidden and one has most of the others."""
    rnd, made = random.Random(seed), [str(root)]
    for i in range(folders):
        above = made[0] if rnd.random() < 0.5 else rnd.choice(made)
        at = os.path.join(above, rnd.choice(("", ".")) * (rnd.random() < 0.2) + f"f{i}é")
        os.makedirs(at)
        made.append(at)
        kind = rnd.random()
        if kind < 0.25:
            os.makedirs(os.path.join(at, ".git", "sub"))
        elif kind < 0.3:
            open(os.path.join(at, ".git"), "w").close()  # a worktree's mark is no repository
    os.symlink(str(root), os.path.join(str(root), "loop"))
    return str(root)


@pytest.mark.parametrize("hidden", [False, True])
def test_listing_hands_on_what_is_left(tmp_path, hidden):
    root = tree(tmp_path / "t", 1)
    want = G.discover(root, hidden)
    assert len(want) > 10
    for most in (1, 5, 40, 10**6):
        found, ahead, rounds = [], [root], 0
        while ahead:
            got = list(G._listed(ahead, hidden, most))
            found += [p for p, f in got if f]
            ahead = [p for p, f in got if not f]
            rounds += 1
        assert sorted(found) == want and (rounds == 1 if most == 10**6 else rounds > 1 or most == 40)


def test_walk_by_executors(spark, tmp_path, monkeypatch):
    one, two = tree(tmp_path / "one", 2), tree(tmp_path / "two", 3, 60)
    inside = G.discover(two)[0]
    roots = spark.createDataFrame([(one,), (two,), (two,), (inside,), (None,), (str(tmp_path / "absent"),)], "at string")
    monkeypatch.setattr(G.os, "walk", None)  # the driver walks nothing
    for most in (1, 10, 2000):
        got = [r.repo_path for r in G.walk(roots, most=most, path="at").collect()]
        monkeypatch.undo()
        assert sorted(got) == sorted({*G.discover(one), *G.discover(two)})
        monkeypatch.setattr(G.os, "walk", None)
    monkeypatch.undo()
    table = spark.createDataFrame([(one,), (two,)], "repo_path string")
    assert {r.repo_path for r in G.repositories(spark, table, prune_hidden=True).collect()} == {*G.discover(one, True), *G.discover(two, True)}
    assert G.walk(table.limit(0)).count() == 0 and G.repositories(spark).count() == 0
    assert [tuple(r) for r in G.repositories(spark, str(tmp_path), name="x").collect()] == [(f"{tmp_path}/x", "x")]
    assert [r.repo_path for r in G.repositories(spark, inside).collect()] == [inside]
