"""Git as a source: ranges of commits, filters in git's arguments, one process a range, and runs that go on."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from quern.config import Config
from quern.plans import files as PF
from quern.plans import profile as P
from quern.sources import git as G
from quern.streaming import resume as RS


def made(path, suppliers):
    subprocess.run(["git", "init", "-q", "-b", "main", str(path)], check=True, capture_output=True)
    with subprocess.Popen(["git", "-C", str(path), "fast-import", "--quiet", "--force"], stdin=subprocess.PIPE) as p:
        for x in PF._history(0, suppliers):
            p.stdin.write(x)
        p.stdin.close()
    assert p.returncode == 0
    return str(path)


@pytest.fixture(scope="module")
def huge(tmp_path_factory):
    return made(tmp_path_factory.mktemp("git") / "huge", range(1, 80))


def plain(path, *args):
    return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, text=True).stdout


@pytest.fixture
def calls(monkeypatch):
    """The arguments of every git process."""
    seen = []
    popen = subprocess.Popen

    def counting(args, *rest, **named):
        seen.append(list(args))
        return popen(args, *rest, **named)

    monkeypatch.setattr(subprocess, "Popen", counting)
    return seen


def test_one_repository_in_many_ranges_a_process_each(huge, calls):
    total = len(plain(huge, "rev-list", "HEAD").split())
    for rows in (G._Commits, G._Numbers):
        reader = G._Reader({"paths": huge, "commits": "10"}, rows)
        parts = reader.partitions()
        assert len(parts) == -(-total // 10) > 10 and {p.tip for p in parts} == {plain(huge, "rev-parse", "HEAD").strip()}
        for p in parts:
            calls.clear()
            got = list(reader.read(p))
            assert len(calls) == 1 and got
    one = {r[4] for p in parts for r in reader.read(p)}
    assert one <= set(plain(huge, "rev-list", "HEAD").split())


def test_filters_are_in_gits_arguments(huge, calls):
    reader = G._Reader({"paths": f"{huge},/elsewhere/other", "commits": "1000"}, G._Commits)
    pushed = [GreaterThanOrEqual(("ts",), 1583000000), LessThan(("ts",), 1590000000), In(("author",), ("dev1@x.org", "dev2@x.org")), EqualTo(("repo",), "huge")]
    assert list(reader.pushFilters(pushed)) == pushed  # Spark filters again
    (part,) = reader.partitions()
    calls.clear()
    got = list(reader.read(part))
    (args,) = calls
    assert {"--since-as-filter=@1583000000", "--until=@1589999999", "--fixed-strings", "--regexp-ignore-case", "--author=dev1@x.org", "--author=dev2@x.org"} <= set(args)
    every = [line.split() for line in plain(huge, "log", "--format=%ae %ct %H").splitlines()]
    assert sorted(r[4] for r in got) == sorted(h for a, t, h in every if a.lower() in ("dev1@x.org", "dev2@x.org") and 1583000000 <= int(t) < 1590000000)
    odd = G._Reader({"paths": huge}, G._Commits)
    list(odd.pushFilters([EqualTo(("author",), "é b"), GreaterThanOrEqual(("ts",), 5), EqualTo(("commit_id",), "x")]))
    assert odd.limits == G.Limits()


def test_sources_in_spark(spark, huge, tmp_path):
    G.register(spark)
    empty = str(tmp_path / "empty")
    subprocess.run(["git", "init", "-q", empty], check=True)
    df = spark.read.format("git_log").option("paths", f"{huge},{tmp_path},{empty}").option("commits", 25).load()
    assert df.rdd.getNumPartitions() > 4
    (bad,) = df.filter("error is not null").collect()
    assert bad.repo_path == str(tmp_path) and "not a git repository" in bad.error
    good = df.filter("error is null")
    assert sorted(r.commit_id for r in good.collect()) == sorted(plain(huge, "rev-list", "HEAD").split())
    numbers = spark.read.format("git_numstat").option("paths", huge).option("commits", 25).load().drop("author", "ts")
    commits = good.select("repo_path", "repo", "commit_id")
    assert sorted(map(tuple, numbers.collect())) == sorted(map(tuple, G.numstat(commits).select(numbers.columns).collect()))
    assert spark.read.format("git_log").option("paths", huge).load().filter("ts >= 4000000000").count() == 0


def test_diffs_of_many_commits_are_those_of_each(spark, tmp_path):
    """One call shows what a call a commit shows: of literal paths, with merges and renamed files."""
    path = made(tmp_path / "r", range(1, 30))
    odd = tmp_path / "r" / "a[1]*.py"
    plain(path, "checkout", "-q", "main")
    odd.write_text("x = 1\n\n" * 20)
    (tmp_path / "r" / "a1b.py").write_text("y\n" * 30)
    for args in (("add", "-A"), ("-c", "user.name=n", "-c", "user.email=n@x.org", "commit", "-qm", "odd")):
        plain(path, *args)
    commits = plain(path, "rev-list", "HEAD").split()
    wanted = []
    for c in commits:
        names = plain(path, "show", "--diff-merges=first-parent", "--diff-filter=d", "--name-only", "--no-renames", "--format=", c).split("\n")
        wanted += [(path, "r", c, n) for n in names if n.endswith(".py") and n != "a1b.py"]
    files = spark.createDataFrame(wanted, "repo_path string, repo string, commit_id string, path string")
    got = {r.commit_id: (r.show, r.error) for r in G.shows(files, "S", "D").collect()}
    assert got.keys() == {w[2] for w in wanted}
    for c, (text, error) in got.items():
        own = [w[3] for w in wanted if w[2] == c]
        alone = plain(path, "--literal-pathspecs", "show", "--format=", "--src-prefix=S/", "--dst-prefix=D/", c, "--", *own)
        assert error is None and text == (alone if "diff --git" in alone else "")


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_a_run_goes_on_with_new_commits_only(spark, tmp_path):
    whole = made(tmp_path / "whole", range(1, 40))
    path, other = made(tmp_path / "grown", range(1, 20)), made(tmp_path / "other", range(3, 9))
    folder = str(tmp_path / "state")
    state = RS.advance(spark, [path], folder, commits=7)
    assert state.batches() == [0]
    first = state.commits([0]).count()
    RS.advance(spark, [path], folder)  # nothing new
    assert len(state.commits(state.batches()).collect()) == first
    plain(path, "fetch", "-q", whole, "main")
    plain(path, "update-ref", "refs/heads/main", "FETCH_HEAD")
    RS.advance(spark, [path, other], folder, commits=7)
    last = state.batches()[-1]
    new = {r.commit_id for r in state.commits([last]).filter("repo = 'grown'").collect()}
    assert new == set(plain(path, "rev-list", "main").split()) - {r.commit_id for r in state.commits([0]).collect()} and len(new) < len(plain(path, "rev-list", "main").split())
    repos = spark.createDataFrame([(path, "grown"), (other, "other")], "repo_path string, repo string")
    for config in (Config(), Config(min_months=3)):
        run, found = P.facts(repos, config=config), RS.results(state, config)
        for name in ("activity", "spans", "commits", "snippets"):
            a, b = getattr(run, name), getattr(found, name)
            assert rows(a) == rows(b.select(a.columns))
    assert state.at("activity", last).count() and found.errors.count() == 0
    # a batch that comes again is left as it is; a rewritten history counts nothing twice
    before = rows(RS.results(state).activity)
    state.take(spark.createDataFrame([], "repo_path string, repo string, author string, ts long, commit_id string, error string"), last, Config())
    plain(path, "update-ref", "refs/heads/main", plain(path, "rev-list", "--skip=9", "-1", "main").strip())
    RS.advance(spark, [path, other], folder)
    assert rows(RS.results(state).activity) == before


def test_results_before_the_first_run(spark, tmp_path):
    assert RS.results(RS.State(spark, str(tmp_path / "none"))) is None


def test_settings_of_repositories(spark, huge):
    plain(huge, "config", "user.email", "me@x.org")
    df = spark.createDataFrame([(huge, "huge"), (os.path.dirname(huge), "none")], "repo_path string, repo string")
    got = {r.repo: (r.remote, r.email) for r in G.settings(df, remote="remote.origin.url", email="user.email").collect()}
    assert got["huge"] == (None, "me@x.org") and got["none"][0] is None
    assert G.with_remotes(df).filter(F.col("remote").isNull()).count() == 2


@pytest.fixture
def odd(spark, tmp_path, monkeypatch):
    """repo_path, repo: one that is whole, and folders of whose settings git tells nothing or another's."""
    (tmp_path / "gitconfig").write_text("[user]\n\temail = own@x.org\n")
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", str(tmp_path / "gitconfig"))
    whole, bad, outer = (made(tmp_path / n, range(1, 3)) for n in ("whole", "bad", "outer"))
    (tmp_path / "bad/.git/config").write_text("[remote\n")
    plain(outer, "config", "remote.origin.url", "outer.git")
    for n in ("plain", "outer/inner/.git"):
        (tmp_path / n).mkdir(parents=True)
    paths = [whole, bad, f"{outer}/inner", *(str(tmp_path / n) for n in ("plain", "missing"))]
    return spark.createDataFrame([(p, os.path.basename(p)) for p in paths], "repo_path string, repo string")


def test_a_setting_that_git_cannot_tell_is_no_result(odd):
    keys = {"remote": "remote.origin.url", "email": "user.email"}
    got = {}
    for r in odd.collect():
        try:
            got[r.repo] = [G.config_value(r.repo_path, k) for k in keys.values()]
        except G.GitError as e:
            got[r.repo] = str(e)
    assert got.pop("whole") == [None, "own@x.org"]  # not set, and the user's own
    assert "bad config" in got["bad"] and "cannot change to" in got["missing"] and all("not a git repository" in got[n] for n in ("inner", "plain"))
    rows = {r.repo: r for r in G.settings(odd, **keys).collect()}
    assert rows.keys() == {"whole", *got} and rows["whole"].error is None
    assert all((rows[n].remote, rows[n].email, rows[n].error) == (None, None, e) for n, e in got.items())
    with pytest.raises(G.GitError, match="section"):
        G.config_value(odd.first().repo_path, "nothing")


def test_settings_that_git_cannot_tell_end_the_query(spark, odd, monkeypatch):
    monkeypatch.setattr(PF, "_repositories", lambda *_: odd.filter("repo = 'whole'"))
    assert [(r.repo, r.remote) for r in PF.git_settings(spark, "").collect()] == [("whole", None)]
    monkeypatch.setattr(PF, "_repositories", lambda *_: odd.filter("repo in ('whole', 'bad')"))
    for run in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("repo").collect()):
        with pytest.raises(Exception, match="bad config"):
            run(PF.git_settings(spark, ""))


def test_work_for_git_is_not_joined_into_one_task(spark, huge):
    """Adaptive execution joins small partitions; the few short rows that git works for are dealt by number instead."""
    repos = spark.createDataFrame([(huge, "huge")], "repo_path string, repo string")
    commits = G.log(repos).select("repo_path", "repo", F.split("line", "\x01")[2].alias("commit_id")).persist()
    groups = G._dealt(commits, F.col("commit_id"), 4)
    held = groups.select(F.spark_partition_id().alias("p"), F.size("commits").alias("n")).collect()
    assert sum(r.n for r in held) == commits.count() and len({r.p for r in held}) > 8


def test_ranges_do_not_follow_the_commits(huge, monkeypatch):
    total = len(plain(huge, "rev-list", "HEAD").split())
    monkeypatch.setattr(G, "MOST_RANGES", 7)
    for reader in (G._Reader({"paths": huge, "commits": "2"}, G._Commits), None):
        tips = G._Tips({"paths": huge, "commits": "2"}, G._Commits)
        parts = reader.partitions() if reader else tips.partitions({}, tips.latestOffset())
        got = [r[4] for p in parts for r in (reader or tips).read(p)]
        assert len(parts) <= 7 and sorted(got) == sorted(plain(huge, "rev-list", "HEAD").split()) and len(got) == total
