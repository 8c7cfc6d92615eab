"""Activity of authors: joins, gates and monthly sums over commits and the files they change.

``commits``: repo, author, commit_id, ts (seconds). ``changes``: repo, commit_id, path, added, deleted
(numbers as git prints them, or already integers). All functions are DataFrame to DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import scalars as S

_DEFAULT = Config()


def parse_commits(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of a git log, ``email 0x01 seconds 0x01 hash``, as rows; the e-mail in lower case. Other columns stay."""
    part = F.split(F.col(line), "\x01")
    out = lines.filter(F.size(part) == 3).select(*[c for c in lines.columns if c != line], S.email_key(part[0]).alias("author"), part[1].try_cast("bigint").alias("ts"), S.strip(part[2]).alias("commit_id"))
    return out.filter("author <> '' and ts is not null")


def by_time(commits: DataFrame) -> DataFrame:
    """Commits from the oldest to the newest, those of one second by hash."""
    return commits.orderBy("ts", "commit_id")


def by_authors(commits: DataFrame, authors: Iterable[str] | DataFrame | None) -> DataFrame:
    """Commits of the given authors, compared exactly in lower case; all where none are given."""
    if authors is None:
        return commits
    if isinstance(authors, DataFrame):
        return commits.join(authors.select(F.lower(F.col(authors.columns[0])).alias("author")).distinct(), "author", "left_semi")
    wanted = [a.strip().lower() for a in authors]
    return commits.filter(F.col("author").isin(wanted)) if wanted else commits


def active_authors(commits: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """Commits of authors with at least ``min_months`` distinct months in the repository."""
    months = commits.groupBy("repo", "author").agg(F.count_distinct(S.year_month("ts")).alias("months"))
    return commits.join(months.filter(F.col("months") >= config.min_months).select("repo", "author"), ["repo", "author"], "left_semi")


def allowed(rows: DataFrame, allow: DataFrame | None, repo: str = "repo", author: str = "author") -> DataFrame:
    """Rows whose (repo, author) is in the allow list; all where the list is missing or empty."""
    if allow is None or allow.isEmpty():
        return rows
    return rows.join(allow.select(F.col("repo").alias(repo), F.col("user").alias(author)).distinct(), [repo, author], "left_semi")


def valid_changes(changes: DataFrame) -> DataFrame:
    """Changes with both numbers (binary files have none) and not both 0, paths after renames, extensions added."""
    digits = F.col("added").cast("string").rlike("^[0-9]+$") & F.col("deleted").cast("string").rlike("^[0-9]+$")
    out = changes.filter(digits).withColumns({"added": F.col("added").try_cast("bigint"), "deleted": F.col("deleted").try_cast("bigint"), "path": S.renamed_to("path")})
    return out.filter("added + deleted <> 0").withColumn("ext", S.file_extension("path"))


def supported_changes(changes: DataFrame) -> DataFrame:
    return changes.filter(S.is_supported("ext"))


def per_commit(value: str | Column, keys: tuple[str, ...] = ("repo", "commit_id")) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys))


def without_huge_commits(changes: DataFrame, limit: int = _DEFAULT.huge_commit_lines, keys: tuple[str, ...] = ("repo", "commit_id")) -> DataFrame:
    """Changes of commits that add and delete at most ``limit`` lines each; a larger commit contributes nothing."""
    sums = changes.withColumns({"_a": per_commit("added", keys), "_d": per_commit("deleted", keys)})
    return sums.filter((F.col("_a") <= limit) & (F.col("_d") <= limit)).drop("_a", "_d")


def significant_files(changes: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    return changes.filter(F.col("added") > config.min_file_lines)


def analysed_files(changes: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """Significant files of commits whose significant files add fewer than ``max_commit_lines``: only their diffs are read."""
    files = significant_files(changes, config).withColumn("_a", per_commit("added"))
    return files.filter(F.col("_a") < config.max_commit_lines).drop("_a")


def monthly(changes: DataFrame, reformat: Column | None = None) -> DataFrame:
    """repo, author, lang, ym, added, deleted, commits. Retracted (reformat-only) changes add 0 but keep their month."""
    kept = F.lit(True) if reformat is None else ~F.coalesce(reformat, F.lit(False))
    counted = lambda c: F.sum(F.when(kept, F.col(c)).otherwise(0)).cast("bigint").alias(c)
    return changes.groupBy("repo", "author", F.col("ext").alias("lang"), "ym").agg(counted("added"), counted("deleted"), F.count_distinct("commit_id").alias("commits"))


def spans(changes: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """First and last month with a significant file; languages without one have no row."""
    return significant_files(changes, config).groupBy("repo", "author", F.col("ext").alias("lang")).agg(F.min("ym").alias("st"), F.max("ym").alias("et"))


def file_quarters(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo", S.quarter("ym").alias("qtr"), "path").agg(F.sum("added").cast("bigint").alias("lines"))


def big_commits(changes: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    return changes.groupBy("repo", "commit_id").agg(F.sum("added").cast("bigint").alias("lines")).filter(F.col("lines") > config.big_commit_lines)


def author_ranking(commits: DataFrame, by: str = "repos", first: str | None = None, most: int = 20) -> DataFrame:
    """Authors by the number of repositories or of commits, the most first; ``first`` leads, even without a commit.

    By repositories each raw spelling counts once in each; spellings that differ in case or in white space at their
    ends are one author, and empty ones none.
    """
    if by == "repos":
        raw = F.col("raw_author" if "raw_author" in commits.columns else "author").cast("string")
        counts = commits.select("repo", raw.alias("raw")).filter("raw <> ''").distinct().groupBy(S.email_key("raw").alias("author")).count()
    else:
        counts = commits.groupBy(F.col("author").cast("string").alias("author")).count()
    lead = []
    if first:
        counts = counts.union(commits.sparkSession.createDataFrame([(first, 0)], "author string, count bigint")).groupBy("author").agg(F.sum("count").alias("count"))
        lead = [F.when(F.col("author") == F.lit(first), 0).otherwise(1)]
    return counts.orderBy(*lead, F.desc("count"), "author").limit(most)
