"""Git repositories as tables. Each repository is one work item; git runs on the executors, never through a shell.

The executors must see the repositories' paths. A failed call gives one row with ``error`` set and, of what it was
asked for, only the keys; every source has that column, so a run that missed something can tell.
"""

from __future__ import annotations

import os
import re
import secrets
import subprocess
import threading
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby, islice

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quern.functions import scalars as S


def discover(root: str, prune_hidden: bool = False) -> list[str]:
    """Repositories below a folder: those with a ``.git`` folder; nothing below a repository is looked at."""
    found = []
    for path, dirs, _ in os.walk(root):
        if ".git" in dirs:
            found.append(path)
            dirs.clear()
        elif prune_hidden:
            dirs[:] = [d for d in dirs if not d.startswith(".")]
    return sorted(found)


#: Folders that a task of a walk lists before it hands the others on.
FOLDERS_AT_ONCE = 2_000


def _listed(paths: Iterable[str], prune_hidden: bool, most: int) -> Iterator[tuple[str, bool]]:
    """(path, True) of repositories at or below folders, (path, False) of folders that are left for another task.

    Every given folder is listed, those below it while fewer than ``most`` are listed or waiting. A folder's entries
    are read one by one, so one with very many is never held.
    """
    listed = 0
    for path in paths:
        ahead = [path]
        while ahead:
            at = ahead.pop()
            listed += 1
            if os.path.isdir(os.path.join(at, ".git")):
                yield at, True
                continue
            try:
                with os.scandir(at) as entries:
                    for e in entries:
                        if not e.is_dir(follow_symlinks=False) or (prune_hidden and e.name.startswith(".")):
                            continue
                        try:
                            e.name.encode()
                        except UnicodeEncodeError:
                            continue
                        if listed + len(ahead) < most:
                            ahead.append(e.path)
                        else:
                            yield e.path, False
            except OSError:
                continue


def walk(roots: DataFrame, prune_hidden: bool = False, most: int = FOLDERS_AT_ONCE, path: str = "repo_path") -> DataFrame:
    """repo_path of the repositories at or below the folders of ``roots`` (a column ``path``), each once: what :func:`discover` finds.

    Executors list the folders. Those that a task doesn't come to are dealt to all tasks in the next round, which
    goes at least one level deeper, so a folder that holds most of the tree is listed by many and there are no more
    rounds than levels. The driver learns only whether folders are left. Rounds are checkpointed where the session has
    a folder for that, else kept on the executors' disks. Links aren't followed; folders that can't be read, or whose
    names aren't Unicode, are left out, as are null roots and those that aren't there.
    """

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _listed((p for df in frames for p in df["repo_path"]), prune_hidden, most)
        while got := list(islice(found, 1000)):
            yield pd.DataFrame(got, columns=["repo_path", "found"])

    out, ahead = [], roots.select(F.col(path).cast("string").alias("repo_path")).filter("repo_path is not null").distinct()
    saved = roots.sparkSession.sparkContext.getCheckpointDir() is not None
    while True:
        rows = ahead.mapInPandas(search, "repo_path string, found boolean")
        rows = rows.checkpoint() if saved else rows.persist(StorageLevel.DISK_ONLY)
        out.append(rows.filter("found").select("repo_path"))
        ahead = rows.filter("not found").select("repo_path")
        if ahead.isEmpty():
            return reduce(DataFrame.union, out).distinct()
        ahead = ahead.repartition("repo_path")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def repositories(spark: SparkSession, root: str | DataFrame | None = None, list_file: str | None = None, name: str | None = None, prune_hidden: bool = False) -> DataFrame:
    """repo_path, repo: walked, listed in a file (one path a line), both together without repetition, or a single one.

    ``root`` is a folder or a table of folders (``repo_path``); executors walk it.
    """
    given = root if isinstance(root, DataFrame) else spark.createDataFrame([(os.path.join(root, name) if name else root,)] if root else [], "repo_path string")
    out = given.select("repo_path") if name or root is None else walk(given, prune_hidden)
    if list_file and _exists(spark, list_file):
        listed = spark.read.text(list_file).select(S.strip("value").alias("repo_path")).filter("repo_path <> ''")
        out = out.union(listed).distinct()
    return out.withColumn("repo", S.repo_name("repo_path"))


#: Commits that one git process is asked for: their numbers, and their diffs.
COMMITS_AT_ONCE, DIFFS_AT_ONCE = 500, 200
#: What every call sets, whatever a user's settings are.
_PROGRAM = ("git", "-c", "core.quotepath=off", "-c", "safe.directory=*", "-c", "log.showSignature=false", "-c", "log.showRoot=true", "-c", "diff.suppressBlankEmpty=false")


class GitError(Exception):
    """What git says when a call fails."""


def git(repo: str, *args: str, stdin: str = "", timeout: int = 600) -> tuple[str, str | None]:
    """Output and error of one git call; arguments are passed as they are."""
    try:
        done = subprocess.run([*_PROGRAM, "-C", repo, *args], input=stdin.encode(), capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        return "", str(e)
    out = done.stdout.decode("utf-8", "replace")
    return (out, None) if done.returncode == 0 else ("", done.stderr.decode("utf-8", "replace")[:500] or "git failed")


def stream(repo: str, *args: str, stdin: str = "", timeout: int = 3600) -> Iterator[str]:
    """The lines of one git call as they come; raises :class:`GitError` at the end where it fails."""
    try:
        p = subprocess.Popen([*_PROGRAM, "-C", repo, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as e:
        raise GitError(str(e)) from e
    said: list[bytes] = []

    def feed() -> None:
        try:
            p.stdin.write(stdin.encode())
            p.stdin.close()
        except OSError:  # git has ended: its return code says why
            pass

    helpers = [threading.Thread(target=feed, daemon=True), threading.Thread(target=lambda: said.append(p.stderr.read()), daemon=True)]
    limit = threading.Timer(timeout, p.kill)
    for t in (*helpers, limit):
        t.start()
    try:
        for line in p.stdout:
            yield line.rstrip(b"\n").decode("utf-8", "replace")
        if p.wait():
            helpers[1].join()
            raise GitError(b"".join(said).decode("utf-8", "replace")[:500] or "git failed")
    finally:
        limit.cancel()
        p.kill()
        p.wait()


def records(repo: str, *args: str, stdin: str = "") -> Iterator[tuple[str, list[str]]]:
    """(what follows the mark, other lines) of each commit of a call whose format begins with ``%x01``; one is held at a time."""
    head, lines = None, []
    for line in stream(repo, *args, stdin=stdin):
        if line.startswith("\x01"):
            if head is not None:
                yield head, lines
            head, lines = line[1:], []
        elif head is not None:
            lines.append(line)
    if head is not None:
        yield head, lines


def log_arguments(months: int | None = None, authors: Iterable[str] = ()) -> list[str]:
    """Arguments of a log of author, seconds and hash; git itself limits it to the months and authors."""
    out = ["log", "--no-use-mailmap", "--pretty=format:%ae%x01%ct%x01%H"]
    if months:
        out.append(f"--since={int(months)} months ago")
    authors = list(authors)
    if authors:
        out += ["--regexp-ignore-case", *(f"--author={a}" for a in authors)]
    return out


def tasks(spark: SparkSession) -> int:
    """How many tasks work for git is dealt to. Its rows are few and short, so Spark left alone would join them into one task."""
    return 4 * spark.sparkContext.defaultParallelism


def _each(repos: DataFrame) -> DataFrame:
    """Repositories dealt to all tasks."""
    return repos.repartition(tasks(repos.sparkSession), "repo_path")


def _over(rows: DataFrame, columns: str, f, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for row in df.itertuples(index=False):
                got = list(f(row))
                for at in range(0, len(got), 1000):
                    yield pd.DataFrame(got[at : at + 1000], columns=names, dtype=object)

    return rows.select(*columns.split(", ")).mapInPandas(run, schema)


def log(repos: DataFrame, months: int | None = None, authors: Iterable[str] = ()) -> DataFrame:
    """repo_path, repo, line, error: the raw lines of every repository's log."""
    args = log_arguments(months, authors)

    def read(r):
        try:
            for line in stream(r.repo_path, *args):
                if line:
                    yield r.repo_path, r.repo, line, None
        except GitError as e:
            yield r.repo_path, r.repo, None, str(e)

    return _over(_each(repos), "repo_path, repo", read, "repo_path string, repo string, line string, error string")


def _dealt(rows: DataFrame, entry, most: int) -> DataFrame:
    """Rows (repo_path, repo, commit_id, ...) in groups of about ``most`` of one repository: an array ``commits`` of ``entry``.

    Groups go by the commits' hashes, so those of one huge repository go to all tasks.
    """
    repo = ["repo_path", "repo"]
    sizes = rows.groupBy(*repo).agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"))
    dealt = rows.join(sizes, repo).withColumn("_g", F.pmod(F.xxhash64("commit_id"), "_n"))
    return dealt.repartition(tasks(rows.sparkSession), *repo, "_g").groupBy(*repo, "_g").agg(F.array_sort(F.collect_list(entry)).alias("commits"))


def _numbers(lines: Iterable[str]) -> Iterator[list[str]]:
    """added, deleted, path of the lines of a numstat."""
    return (part for line in lines if len(part := line.split("\t")) == 3)


def numstat(commits: DataFrame) -> DataFrame:
    """repo_path, repo, commit_id, added, deleted, path, error: the changed files of each commit as git prints them, deleted files left out.

    A merge is shown against its first parent, so it counts what it merges. Commits of a repository go to git some
    hundred at a time; where such a call fails, each commit is asked for alone, so one that git can't show is the only
    one missed.
    """
    args = ("show", "--numstat", "--diff-filter=d", "--first-parent", "--format=%x01%H")

    def read(r):
        done = set()
        try:
            for commit, lines in records(r.repo_path, *args, "--stdin", stdin="\n".join(r.commits) + "\n"):
                yield from ((r.repo_path, r.repo, commit, *part, None) for part in _numbers(lines))
                done.add(commit)
            return
        except GitError:
            left = [c for c in r.commits if c not in done]
        for c in left:
            try:
                for commit, lines in records(r.repo_path, *args, c):
                    yield from ((r.repo_path, r.repo, commit, *part, None) for part in _numbers(lines))
            except GitError as e:
                yield r.repo_path, r.repo, c, None, None, None, str(e)

    dealt = _dealt(commits.select("repo_path", "repo", "commit_id").distinct(), F.col("commit_id"), COMMITS_AT_ONCE)
    return _over(dealt, "repo_path, repo, commits", read, "repo_path string, repo string, commit_id string, added string, deleted string, path string, error string")


def _only(lines: list[str], paths: set[str], src: str, dst: str) -> str:
    """The files of a diff that are among ``paths``, or whose names git quotes."""
    out, keep = [], False
    for line in lines:
        if line.startswith(f"diff --git {src}/"):
            name = line.rpartition(f" {dst}/")[2]
            keep = name in paths
        elif line.startswith("diff --git "):
            keep = True
        elif line.startswith(("diff --cc ", "diff --combined ")):
            keep = False  # a merge's own changes are no additions to its first parent
        if keep and line:  # no line of a diff is empty: the one after the last is git's
            out.append(line)
    return "\n".join(out) + "\n" if out else ""


def shows(files: DataFrame, src: str, dst: str) -> DataFrame:
    """repo_path, repo, commit_id, show, error: the diff of each commit, only of the given paths, with the given prefixes.

    Some hundred commits of a repository are one call, which is asked for all their paths and read commit by commit; of
    each commit its own paths are kept. Paths are literal, and a renamed file is a new one. Where such a call fails, each
    commit that it has not shown yet is asked for alone.
    """
    args = ("--literal-pathspecs", "show", "--no-color", "--no-ext-diff", "--no-renames", "--format=%x01%H", f"--src-prefix={src}/", f"--dst-prefix={dst}/", "--stdin")

    def call(r, wanted: dict[str, set[str]]):
        paths = sorted(set().union(*wanted.values()))
        for commit, lines in records(r.repo_path, *args, stdin="\n".join([*wanted, "--", *paths]) + "\n"):
            yield commit, _only(lines, wanted.get(commit, set()), src, dst)

    def read(r):
        wanted = {c["commit_id"]: {p for p in c["paths"] if "\n" not in p} for c in r.commits}
        done = set()
        try:
            for commit, text in call(r, wanted):
                yield r.repo_path, r.repo, commit, text, None
                done.add(commit)
        except GitError:
            for c in wanted.keys() - done:
                try:
                    yield from ((r.repo_path, r.repo, commit, text, None) for commit, text in call(r, {c: wanted[c]}))
                except GitError as e:
                    yield r.repo_path, r.repo, c, None, str(e)
                done.add(c)
        for c in wanted.keys() - done:  # git shows nothing of a commit without these paths
            yield r.repo_path, r.repo, c, "", None

    wanted = files.groupBy("repo_path", "repo", "commit_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return _over(_dealt(wanted, F.struct("commit_id", "paths"), DIFFS_AT_ONCE), "repo_path, repo, commits", read, "repo_path string, repo string, commit_id string, show string, error string")


def prefixes() -> tuple[str, str]:
    """Two prefixes that no diff holds by chance, so a diff of a diff isn't split."""
    x = secrets.token_hex(12)
    return f"a{x}", f"b{x}"


def config_values(repo: str, *keys: str) -> list[str | None]:
    """``remote.origin.url``, ``user.email`` and the like, None where one isn't set; raises :class:`GitError` where git can't tell.

    Outside of a repository git gives the user's own settings, and below one whose ``.git`` is broken those of another, so
    it is asked for the repository first.
    """
    own = ["--git-dir=.git"] if os.path.lexists(os.path.join(repo, ".git")) else []
    calls = [(*own, "rev-parse", "--git-dir"), *(("config", "--default", "", "--get", k) for k in keys)]  # with a default, one that isn't set is no failure
    out = []
    for args in calls:
        value, error = git(repo, *args)
        if error is not None:
            raise GitError(error)
        out.append(value.strip() or None)
    return out[1:]


def config_value(repo: str, key: str) -> str | None:
    """One of :func:`config_values`."""
    return config_values(repo, key)[0]


def settings(repos: DataFrame, **keys: str) -> DataFrame:
    """repo_path, repo, a column of each setting, and error: ``settings(repos, remote="remote.origin.url", email="user.email")``.

    A setting is null where it isn't set; where git can't tell, all of the repository are, and ``error`` says why.
    """

    def read(r):
        try:
            yield r.repo_path, r.repo, *config_values(r.repo_path, *keys.values()), None
        except GitError as e:
            yield r.repo_path, r.repo, *[None] * len(keys), str(e)

    return _over(_each(repos), "repo_path, repo", read, ", ".join(["repo_path string, repo string", *(f"{c} string" for c in keys), "error string"]))


def with_remotes(repos: DataFrame) -> DataFrame:
    """repo_path, repo, remote, error."""
    return settings(repos, remote="remote.origin.url")


# -- git as a data source ---------------------------------------------------------------------------------
@dataclass(frozen=True)
class Range(InputPartition):
    """Commits ``skip`` to ``skip + most`` of what is reachable from ``tip`` and not from ``base``; or why there are none."""

    path: str
    tip: str
    base: str = ""
    skip: int = 0
    most: int = 0
    error: str | None = None


@dataclass(frozen=True)
class Limits:
    """What a scan needs: arguments that git itself filters by, which is no more than Spark filters again."""

    since: int | None = None
    until: int | None = None
    authors: tuple[str, ...] | None = None
    months: int | None = None

    def arguments(self) -> list[str]:
        out = [f"--since-as-filter=@{self.since}"] if self.since is not None else []  # the other form stops at the first older commit
        out += [f"--since-as-filter={self.months} months ago"] if self.months and self.since is None else []
        out += [f"--until=@{self.until}"] if self.until is not None else []
        return out + (["--regexp-ignore-case", "--fixed-strings", *(f"--author={a}" for a in self.authors)] if self.authors else [])


def ranges(path: str, limits: Limits, size: int, base: str = "", tip: str = "") -> list[Range]:
    """The commits of one repository in ranges of ``size``, all from the same tip, so that later commits move nothing."""
    if not tip:
        tip, error = git(path, "rev-parse", "--verify", "--quiet", "HEAD^{commit}")
        if error:
            found, problem = git(path, "rev-parse", "--git-dir")
            return [] if found and not problem else [Range(path, "", error=problem or error)]  # without a commit yet
        tip = tip.strip()
    count, error = git(path, "rev-list", "--count", *limits.arguments(), tip, *([f"^{base}"] if base else []))
    if error:
        return [Range(path, tip, base, error=error)]
    return [Range(path, tip, base, at, size) for at in range(0, int(count), size)]


#: Ranges, and so tasks and git processes, of one scan or batch; where there would be more, neighbours are read as one.
MOST_RANGES = 1_000


def joined(found: list[Range], most: int) -> list[Range]:
    """The same commits in about ``most`` ranges at most, besides one for each repository: git walks to each from the tip, so their number must not follow the commits."""
    k = -(-len(found) // most)
    if k < 2:
        return found
    out: list[Range] = []
    for _, same in groupby(found, lambda r: (r.path, r.tip, r.base)):
        own = list(same)
        out += [replace(own[i], most=sum(r.most for r in own[i : i + k])) for i in range(0, len(own), k)]
    return out


#: Bounds that git reads as seconds.
_SECONDS = range(10**8, 10**11)


class _Reader(DataSourceReader):
    """Ranges of commits as partitions, each read by one git process."""

    def __init__(self, options, rows):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.size, self.rows = max(1, int(options.get("commits", 20_000))), rows
        given = tuple(a.strip() for a in options.get("authors", "").split(",") if a.strip())
        self.limits = Limits(authors=given or None, months=int(options.get("months", 0)) or None)

    def pushFilters(self, filters):
        """Bounds of ``ts``, authors, paths and names narrow what git walks; Spark filters the rows again."""
        for f in filters:
            column, value = f.attribute if hasattr(f, "attribute") else None, getattr(f, "value", None)
            values = value if isinstance(f, In) else (value,)
            if column == ("ts",) and isinstance(value, int):
                low = {GreaterThan: value + 1, GreaterThanOrEqual: value, EqualTo: value}.get(type(f))
                high = {LessThan: value - 1, LessThanOrEqual: value, EqualTo: value}.get(type(f))
                if low is not None and low in _SECONDS:
                    self.limits = replace(self.limits, since=max(low, self.limits.since or low))
                if high is not None and high in _SECONDS:
                    self.limits = replace(self.limits, until=min(high, self.limits.until or high))
            elif column == ("author",) and isinstance(f, (EqualTo, In)) and self.limits.authors is None and all(isinstance(v, str) and re.fullmatch(r"[!-~]+", v) for v in values):
                self.limits = replace(self.limits, authors=tuple(values))
            elif column in (("repo_path",), ("repo",)) and isinstance(f, (EqualTo, In)):
                self.paths = [p for p in self.paths if (p if column == ("repo_path",) else _name(p)) in values]
            yield f

    def partitions(self):
        with ThreadPoolExecutor(8) as pool:
            found = [r for some in pool.map(lambda p: ranges(p, self.limits, self.size), self.paths) for r in some]
        return joined(found, MOST_RANGES) or [Range("", "")]

    def read(self, partition):
        return _read(partition, self.limits, self.rows)


def _name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))


def _read(part: Range, limits: Limits, rows) -> Iterator[tuple]:
    if not part.path:
        return
    if part.error:
        yield (part.path, _name(part.path), *[None] * (rows.width - 3), part.error)
        return
    args = ["log", "--no-use-mailmap", f"--skip={part.skip}", f"--max-count={part.most}", *limits.arguments(), *rows.arguments, "--format=%x01%ae%x01%ct%x01%H", part.tip, *([f"^{part.base}"] if part.base else [])]
    try:
        for head, lines in records(part.path, *args):
            author, ts, commit = head.split("\x01")
            if author.strip() and ts.isdigit():
                yield from rows.of(part.path, _name(part.path), author.strip().lower(), int(ts), commit, lines)
    except GitError as e:
        yield (part.path, _name(part.path), *[None] * (rows.width - 3), str(e))


class _Commits:
    """A row for each commit."""

    schema, width, arguments = "repo_path string, repo string, author string, ts bigint, commit_id string, error string", 6, ()

    @staticmethod
    def of(path, repo, author, ts, commit, lines):
        yield path, repo, author, ts, commit, None


class _Numbers:
    """A row for each changed file of each commit, as :func:`numstat` has them; merges against their first parent."""

    schema, width = "repo_path string, repo string, author string, ts bigint, commit_id string, added string, deleted string, path string, error string", 9
    arguments = ("--numstat", "--diff-filter=d", "--diff-merges=first-parent")

    @staticmethod
    def of(path, repo, author, ts, commit, lines):
        for part in _numbers(lines):
            yield path, repo, author, ts, commit, *part, None


class _Tips(DataSourceStreamReader):
    """New commits only: an offset is the commit each repository has been read up to."""

    def __init__(self, options, rows):
        self.batch = _Reader(options, rows)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        tips = {p: git(p, "rev-parse", "--verify", "--quiet", "HEAD^{commit}")[0].strip() for p in self.batch.paths}
        return {p: t for p, t in tips.items() if t}

    def partitions(self, start, end):
        found = [r for p, tip in end.items() if start.get(p) != tip for r in ranges(p, self.batch.limits, self.batch.size, self._base(p, start.get(p, "")), tip)]
        return joined(found, MOST_RANGES) or [Range("", "")]

    @staticmethod
    def _base(path: str, commit: str) -> str:
        """The last commit read, where the repository still has it: a rewritten history may not, and is read from its beginning."""
        return commit if commit and not git(path, "cat-file", "-e", f"{commit}^{{commit}}")[1] else ""

    def read(self, partition):
        return _read(partition, self.batch.limits, self.batch.rows)

    def commit(self, end):
        pass


class GitLog(DataSource):
    """``spark.read.format("git_log").option("paths", "/a,/b").load()``: the commits of repositories, in ranges.

    :func:`register` makes it known. Options: paths, months, authors (separated by commas), commits (how many a range has; more where there would be over :data:`MOST_RANGES`).
    A repository of many commits is read by many tasks, one git process each. Filters on ts, author, repo and repo_path
    go into git's arguments. As a stream, only commits come that the last batch's tips don't reach. Planning calls
    git twice a path; for a table of repositories there is :func:`log`.
    """

    rows = _Commits

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return self.rows.schema

    def reader(self, schema):
        return _Reader(self.options, self.rows)

    def streamReader(self, schema):
        return _Tips(self.options, self.rows)


class GitNumstat(GitLog):
    """``git_numstat``: the same for changed files, with each commit's author and time."""

    rows = _Numbers

    @classmethod
    def name(cls):
        return "git_numstat"


def register(spark: SparkSession) -> None:
    """Makes ``git_log`` and ``git_numstat`` known, with filters that reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitNumstat)
