"""From repositories to profiles: the whole run, with the expensive scan behind the cheap one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import scalars as S
from quern.operators import activity as A
from quern.operators import scoring as SC
from quern.operators import skills as K
from quern.operators import snippets as SN
from quern.sources import git as G


@dataclass
class Facts:
    """The tables of a run. ``errors`` (repo_path, repo, step, commit_id, error) says what git couldn't give."""

    commits: DataFrame
    changes: DataFrame
    diffs: DataFrame
    snippets: DataFrame
    activity: DataFrame
    spans: DataFrame
    errors: DataFrame


class Steps:
    """Makes every table that git is run for, or that is read more than once, one time: written below ``folder``, from where an interrupted run goes on, or kept on the executors' disks."""

    def __init__(self, folder: str | None):
        self.folder = folder

    def once(self, name: str, df: DataFrame) -> DataFrame:
        if self.folder is None:
            return df.persist(StorageLevel.DISK_ONLY)
        spark, at = df.sparkSession, f"{self.folder}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            df.write.mode("overwrite").parquet(at)
        return spark.read.schema(df.schema).parquet(at)


def facts(repos: DataFrame, authors: Iterable[str] | None = None, months: int | None = None, allow: DataFrame | None = None, config: Config = Config(), compat: bool = False, folder: str | None = None) -> Facts:  # noqa: B008
    """Commits, changed files, diffs, snippets and monthly activity of all authors, or of some, in all repositories.

    Git runs once for each table: log, changes, then diffs. With ``folder`` (which driver and executors share) these are
    written there, and a run that finds one whole reads it instead of running git again.
    """
    steps = Steps(folder)
    lines = steps.once("log", G.log(repos, months, authors or ()))
    commits = A.allowed(A.active_authors(A.by_authors(A.parse_commits(lines.filter("error is null").drop("error")), authors), config), allow)
    return facts_of(commits, lines.filter("error is not null").select("repo_path", "repo", "error"), steps, config, compat)


def facts_of(commits: DataFrame, unread: DataFrame, steps: Steps, config: Config = Config(), compat: bool = False) -> Facts:  # noqa: B008
    """The tables of a run over ``commits`` (repo_path, repo, author, ts, commit_id); ``unread`` (repo_path, repo, error) has no log."""
    numbers = steps.once("numstat", G.numstat(commits))
    stats = A.supported_changes(A.valid_changes(numbers.filter("error is null").drop("error")))
    changes = A.without_huge_commits(stats, config.huge_commit_lines).join(commits.select("repo_path", "repo", "commit_id", "author", "ts"), ["repo_path", "repo", "commit_id"])
    changes = steps.once("changes", changes.withColumn("ym", S.year_month("ts")))
    wanted = A.analysed_files(changes, config)
    src, dst = G.prefixes()
    shows = steps.once("shows", G.shows(wanted, src, dst).withColumns({"src": F.lit(src), "dst": F.lit(dst)}))
    diffs = SN.file_diffs(shows.filter("error is null").drop("error"), "src", "dst", compat).drop("src", "dst").join(wanted.select("repo_path", "commit_id", "path", "author", "ext", "ym", "added"), ["repo_path", "commit_id", "path"])
    diffs = steps.once("diffs", diffs.withColumn("verdict", SN.verdict(F.col("added"), F.col("segment"), F.col("body"), config)))
    keys = ["repo_path", "repo", "commit_id", "path", "author", "ext", "ym"]
    snippets = SN.added_runs(diffs.filter("verdict = 'analysed'"), keys, "body", config.min_snippet_lines)
    seen = diffs.select("repo_path", "commit_id", "path", (F.col("verdict") == "reformat").alias("reformat"), (F.col("verdict") == "2big").cast("bigint").alias("too_big"))
    counted = changes.join(seen, ["repo_path", "commit_id", "path"], "left")
    big = counted.groupBy("repo", "author", F.col("ext").alias("lang"), "ym").agg(F.coalesce(F.sum("too_big"), F.lit(0)).alias("too_big"))
    runs = snippets.groupBy("repo", "author", F.col("ext").alias("lang"), "ym").agg(F.count(F.lit(1)).alias("sig_cont"))
    on = ["repo", "author", "lang", "ym"]
    activity = A.monthly(counted, F.col("reformat")).join(big, on, "left").join(runs, on, "left").na.fill(0, ["sig_cont", "too_big"])
    failed = [unread.select("repo_path", "repo", F.lit("log").alias("step"), F.lit(None).cast("string").alias("commit_id"), "error")]
    failed += [t.filter("error is not null").select("repo_path", "repo", F.lit(n).alias("step"), "commit_id", "error") for t, n in ((numbers, "numstat"), (shows, "show"))]
    return Facts(commits, changes, diffs, snippets, activity, A.spans(changes, config), failed[0].union(failed[1]).union(failed[2]))


def active_languages(f: Facts, config: Config = Config()) -> DataFrame:  # noqa: B008
    """repo, author, lang of languages that have snippets and months of activity enough; an author without one isn't scored."""
    months = f.activity.groupBy("repo", "author", "lang").agg(F.count_distinct("ym").alias("m")).filter(F.col("m") >= config.min_months)
    return months.join(f.snippets.select("repo", "author", F.col("ext").alias("lang")).distinct(), ["repo", "author", "lang"], "left_semi").drop("m")


def scored(f: Facts, loaders: dict[str, SC.Loader], vocabularies: dict[str, list[str]], labels: DataFrame | None = None, config: Config = Config(), libraries: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Scores of all chunks under each model (``kind::name``): the skill models' best ten, the quality models' best three.

    Only languages of enough months are scored. Models of the kind ``i2s`` read a file's libraries instead of the
    chunk: ``libraries`` has repo, path, libs; a file without has the empty text.
    """
    enough = active_languages(f, config).withColumnRenamed("lang", "ext")
    chunks = SN.chunked(f.snippets.join(enough, ["repo", "author", "ext"], "left_semi"), "ext", config)
    if libraries is None:
        chunks = chunks.withColumn("libs", F.lit(""))
    else:
        chunks = chunks.join(libraries.select("repo", "path", "libs").dropDuplicates(["repo", "path"]), ["repo", "path"], "left").na.fill("", ["libs"])
    chunks = SN.labelled(chunks, labels) if labels is not None else chunks.withColumn("is_labeled", F.lit(0))
    keys = ["repo", "author", "ext", "ym", "commit_id", "path", "run_id", "chunk_no", "line_count", "doc_lines", "is_labeled"]
    out = None
    for tag, loader in loaders.items():
        k = config.top_quality if tag.startswith("life_of_py") else config.top_skills
        text = "libs" if tag.startswith("i2s") else "chunk"
        part = SC.best(chunks, loader, vocabularies[tag], keys, k, config.batch_rows, text).withColumn("model", F.lit(tag))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("ext", "lang")


def profiles(f: Facts, scores: DataFrame, timestamp: int, config: Config = Config(), version: str = "1") -> DataFrame:  # noqa: B008
    """One record per repository and author with a language of enough months, filtered by score, nested only here."""
    stats, totals = K.filter_skills(K.skill_months(scores), K.skill_totals(scores), config.min_scores)
    months = f.activity.groupBy("repo", "author", "lang").agg(F.array_sort(F.collect_list(F.struct("ym", "added", "deleted", "sig_cont", "too_big"))).alias("months"))
    langs = months.join(f.spans, ["repo", "author", "lang"], "left").groupBy("repo", "author").agg(F.array_sort(F.collect_list(F.struct("lang", "st", "et", "months"))).alias("langs"))
    each = [c for c in stats.columns if c not in ("repo", "author")]
    stats = stats.groupBy("repo", "author").agg(F.array_sort(F.collect_list(F.struct(*each))).alias("stats"))
    totals = totals.groupBy("repo", "author").agg(F.array_sort(F.collect_list(F.struct("skill", "code_lines"))).alias("skills"))
    paths = f.commits.groupBy("repo", "author").agg(F.min("repo_path").alias("repo_path"))
    langs = langs.join(active_languages(f, config).select("repo", "author").distinct(), ["repo", "author"], "left_semi")
    out = langs.join(paths, ["repo", "author"]).join(stats, ["repo", "author"], "left").join(totals, ["repo", "author"], "left")
    return out.select(F.lit(version).alias("version"), F.lit(timestamp).cast("bigint").alias("timestamp"), "repo_path", "repo", "author", "langs", "stats", "skills")
