"""Merging and reporting: summaries, quarters, path prefixes, labels of groups of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import scalars as S

_DEFAULT = Config()


def merge_summary(activity: DataFrame, totals: DataFrame, repos: int | Column | None = None) -> DataFrame:
    """One row: users, months, languages, skills, lines added, repositories."""
    a = activity.agg(F.count_distinct("author").alias("users"), F.count_distinct("ym").alias("months"), F.count_distinct("lang").alias("languages"), F.sum("added").cast("bigint").alias("lines"), F.count_distinct("repo").alias("repos"))
    t = totals.agg(F.count_distinct("skill").alias("skills"))
    out = a.crossJoin(t)  # one row each
    return out if repos is None else out.withColumn("repos", F.lit(repos) if isinstance(repos, int) else repos)


def repo_quarters(files: DataFrame) -> DataFrame:
    return files.groupBy("repo", "qtr").agg(F.sum("lines").cast("bigint").alias("lines"))


def language_quarters(activity: DataFrame, compat: bool = False) -> DataFrame:
    """Lines by language and quarter. With ``compat`` a quarter has the lines of its last month only, as an old report had."""
    rows = activity.withColumn("qtr", S.quarter("ym"))
    pick = (lambda c: F.max_by(c, "ym")) if compat else F.sum
    if compat:
        rows = rows.groupBy("lang", "qtr", "ym").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return rows.groupBy("lang", "qtr").agg(pick("added").cast("bigint").alias("added"), pick("deleted").cast("bigint").alias("deleted"))


def gap_filled(rows: DataFrame, keys: list[str], first: str, last: str, values: list[str]) -> DataFrame:
    """A row for every quarter from ``first`` to ``last`` (dates) and every key that occurs; missing values are 0."""
    spine = rows.select(*keys).distinct().select("*", F.explode(F.sequence(F.trunc(F.to_date(F.lit(first)), "quarter"), F.trunc(F.to_date(F.lit(last)), "quarter"), F.expr("interval 3 months"))).alias("_d"))
    spine = spine.withColumn("qtr", S.quarter(S.month_of("_d"))).drop("_d")
    return spine.join(rows, [*keys, "qtr"], "left").na.fill(0, values)


def path_prefixes(files: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """repo, qtr, depth, prefix, lines, of prefixes of one and of two names; both summed in one pass over the files.

    A file at the top is its own prefix of one name, and one a folder below it its own of two.
    """
    parts = F.filter(F.split("path", "/"), lambda x: (x != "") & (x != "."))
    level = lambda n: F.struct(F.lit(n).alias("depth"), S.truncated(F.array_join(F.slice(parts, 1, n), "/"), config.path_chars).alias("prefix"))
    both = F.when(F.size(parts) >= 2, F.array(level(1), level(2))).when(F.size(parts) == 1, F.array(level(1)))
    out = files.select("repo", "qtr", "lines", F.explode(both).alias("p"))
    return out.groupBy("repo", "qtr", "p.depth", "p.prefix").agg(F.sum("lines").cast("bigint").alias("lines"))


def top_prefixes(prefixes: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    """The best three of every repository, quarter and depth; then those of more than 50 lines."""
    order = Window.partitionBy("repo", "qtr", "depth").orderBy(F.desc("lines"), "prefix")
    return prefixes.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= config.report_dirs) & (F.col("lines") > config.report_dir_lines))


def top_commits(commits: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    order = Window.partitionBy("repo").orderBy(F.desc("lines"), "commit_id")
    return commits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.report_commits)


def relevant_totals(totals: DataFrame, not_relevant: DataFrame) -> DataFrame:
    """Skill totals over all profiles without the given skills, largest first."""
    out = totals.join(not_relevant.select("skill").distinct(), "skill", "left_anti").groupBy("skill").agg(F.sum("code_lines").cast("bigint").alias("lines"))
    return out.orderBy(F.desc("lines"), "skill")


def top_skills(sums: DataFrame, config: Config = _DEFAULT) -> DataFrame:
    return sums.orderBy(F.desc("lines"), "skill").limit(config.report_skills)


def skill_names(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds display_name: the vocabulary's, else the skill with capital letters."""
    return rows.join(vocabulary.select("skill", "display_name"), "skill", "left").withColumn("display_name", F.coalesce("display_name", S.title_name("skill")))


def quarters_descending(rows: DataFrame, *then: str) -> DataFrame:
    """Rows by quarter, the last first, and by ``then`` within one."""
    return rows.orderBy(F.desc("qtr"), *then)


def report_facts(changes: DataFrame, author: str, config: Config = _DEFAULT) -> DataFrame:
    """What one person's report is drawn from, as rows: repo, kind (``file`` or ``big_commit``), qtr, name, lines."""
    from quern.operators import activity as A

    own = changes.filter(F.col("author") == author.strip().lower())
    files = A.file_quarters(own).select("repo", F.lit("file").alias("kind"), "qtr", F.col("path").alias("name"), "lines")
    big = A.big_commits(own, config).select("repo", F.lit("big_commit").alias("kind"), F.lit(None).cast("string").alias("qtr"), F.col("commit_id").cast("string").alias("name"), "lines")
    return files.unionByName(big)


def user_label(users: DataFrame, author: str = "author", most: int = 255, team: str | None = None) -> DataFrame:
    """One row ``label``: a single user as is, else users by domain in order, those of one domain in brackets; ``team`` where there are none.

    Each string and its comma take a character at least, so the first ``most + 2`` users of a domain, and domains,
    are all that the label can show; no more are gathered.
    """
    rows = users.select(F.col(author).alias("u")).distinct().withColumn("d", F.element_at(F.split("u", "@"), 2))
    rows = rows.withColumn("_no", F.row_number().over(Window.partitionBy("d").orderBy("u"))).filter(F.col("_no") <= most + 2)
    groups = rows.groupBy("d").agg(F.array_join(F.array_sort(F.collect_list("u")), ",").alias("us"), F.count(F.lit(1)).alias("n"))
    shown = F.when(F.col("n") == 1, F.col("us")).otherwise(F.concat(F.lit("("), F.col("us"), F.lit(")@"), F.col("d")))
    groups = groups.select("d", shown.alias("s")).orderBy("d").limit(most + 2)
    out = groups.agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("g")).select(F.array_join(F.transform("g", lambda x: x["s"]), ",").alias("label"))
    label = F.when(F.length("label") > most, F.concat(F.substring("label", 1, most - 3), F.lit("..."))).otherwise(F.col("label"))
    return out.select(F.when(F.col("label") == "", F.lit(team)).otherwise(label).alias("label"))


def anonymous(profiles: DataFrame, keep_names: bool) -> DataFrame:
    """Hides repository names and paths unless they may be kept; a remote counts only if it contains the repository's name.

    A hidden path is the hash of the remote, or of the name where there is no such remote: the key by which copies of a
    repository at different paths are known as one.
    """
    from quern.functions.text import mask_of

    remote = F.when(F.col("remote").contains(F.col("repo")), F.col("remote"))
    if keep_names:
        return profiles.withColumn("repo_path", F.coalesce(remote, "repo_path"))
    return profiles.withColumns({"repo_path": S.sha256(F.coalesce(remote, "repo")), "repo": mask_of("repo")})


def public_only(profiles: DataFrame) -> DataFrame:
    """Without snippets and libraries."""
    return profiles.drop("sig_code_snippets", "libs")
