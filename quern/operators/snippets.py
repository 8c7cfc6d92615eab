"""Diffs to snippets: splitting by file, gates, runs of added lines, retraction of reformats, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import scalars as S
from quern.functions.text import chunks_udf, documentation_lines_udf

_DEFAULT = Config()


def file_diffs(shows: DataFrame, src: str = "src", dst: str = "dst", compat: bool = False) -> DataFrame:
    """One row per file of each ``git show`` output: path, segment (header and body), body.

    ``show`` is split at ``diff --git <src>/``; the prefixes are texts, or the names of columns that hold them. The body begins at the first hunk; with ``compat`` it is what
    follows the fifth line, so a longer header (a mode change) leaks into it.
    """
    src, dst = (F.col(x) if x in shows.columns else F.lit(x) for x in (src, dst))
    mark = F.concat(F.lit("\\Qdiff --git "), src, F.lit("/\\E"))
    parts = F.posexplode(F.split(F.col("show"), mark))
    out = shows.select(*[c for c in shows.columns if c != "show"], parts.alias("file_no", "segment")).filter("file_no > 0")
    lines = F.split(F.col("segment"), "\n")
    path = F.call_function("regexp_extract", F.element_at(lines, 1), F.concat(F.lit(" \\Q"), dst, F.lit("/\\E(.*)$")), F.lit(1))
    fifth = F.array_join(F.slice(lines, 6, 2**30), "\n")
    hunk = F.regexp_extract(F.col("segment"), r"(?s)\n(@@ .*)$", 1)
    return out.select("*", path.alias("path"), (fifth if compat else hunk).alias("body"))


def verdict(added: Column, segment: Column, body: Column, config: Config = _DEFAULT) -> Column:
    """What becomes of a file's diff: ``2big``, ``small``, ``reformat`` or ``analysed``; cheap tests come first, and the edit distance is counted no further than the limit."""
    reformat = S.distance_below(*S.changed_sides(body), config.reformat_chars)
    return F.when(F.length(segment) > config.max_diff_chars, "2big").when(added < config.min_diff_lines, "small").when(reformat, "reformat").otherwise("analysed")


def added_runs(rows: DataFrame, keys: list[str], text: str = "body", least: int = _DEFAULT.min_snippet_lines, is_added: Callable[[Column], Column] | None = None) -> DataFrame:
    """Runs of at least ``least`` consecutive added lines: keys, run_id, snippet, n_lines.

    Works inside each row with array functions, so nothing is shuffled and rows with equal keys stay apart: a run
    begins at an added line after one that isn't, and ends before the next that isn't. ``run_id`` is the run's
    first line. ``is_added`` says which lines count, given a line, if not those that begin with a plus sign.
    """
    added = is_added or (lambda x: x.startswith("+"))
    at = rows.withColumn("_lines", F.split(F.col(text), "\n"))
    at = at.withColumn("_plus", F.transform("_lines", lambda x: F.coalesce(added(x), F.lit(False))))
    shift = lambda c, a, b: F.concat(a, F.slice(c, b, F.size(c) - 1))
    no = F.array(F.lit(False))
    at = at.withColumns({"_before": shift("_plus", no, F.lit(1)), "_after": F.concat(F.slice("_plus", F.lit(2), F.size("_plus") - 1), no)})
    places = lambda c: F.filter(F.transform(F.arrays_zip(F.col("_plus").alias("p"), F.col(c).alias("o")), lambda x, i: F.when(x["p"] & ~x["o"], i)), lambda i: i.isNotNull())
    at = at.withColumns({"_first": places("_before"), "_last": places("_after")})
    runs = F.filter(F.arrays_zip(F.col("_first").alias("a"), F.col("_last").alias("b")), lambda r: r["b"] - r["a"] + 1 >= least)
    out = at.select(*keys, "_lines", F.explode(runs).alias("_r")).withColumn("n_lines", (F.col("_r.b") - F.col("_r.a") + 1).cast("bigint"))
    found = F.slice("_lines", F.col("_r.a") + 1, F.col("n_lines").cast("int"))
    shown = F.transform(found, lambda x: F.substring(x, 2, 2**31 - 1)) if is_added is None else found
    return out.select(*keys, F.col("_r.a").alias("run_id"), F.array_join(shown, "\n").alias("snippet"), "n_lines")


def snippet_lines(snippets: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """How many lines the snippets of each repository have: what a run will show its progress against."""
    return snippets.groupBy(*keys).agg(F.sum("n_lines").cast("bigint").alias("snippet_lines"))


def snippet_lists(snippets: DataFrame, keys: tuple[str, ...] = ("repo", "author", "ext", "ym")) -> DataFrame:
    """Per key the files' snippets in the order of their commits: an array of (ts, commit_id, path, run_id, snippet)."""
    entry = F.struct("ts", "commit_id", "path", "run_id", "snippet")
    return snippets.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("snippets"))


def library_lists(rows: DataFrame, keys: tuple[str, ...] = ("repo", "author", "ext", "kind", "ym")) -> DataFrame:
    """Per author, language, kind of import and month the libraries that changes brought in: one list each, in the order of the commits."""
    got = F.array_sort(F.collect_list(F.struct("ts", "commit_id", "libs")))
    return rows.groupBy(*keys).agg(got.alias("_l")).select(*keys, F.transform("_l", lambda x: x["libs"]).alias("libs"))


def chunked(snippets: DataFrame, ext: str = "ext", config: Config = _DEFAULT) -> DataFrame:
    """One row per chunk: chunk_no, chunk, line_count, doc_lines. Snippets of unsupported languages give none."""
    parts = chunks_udf(F.col("snippet"), S.separator(ext), F.lit(config.chunk_chars), F.lit(config.min_chunk_chars))
    out = snippets.select("*", F.posexplode(parts).alias("chunk_no", "chunk"))
    return out.withColumns({"line_count": F.size(F.split("chunk", "\n")), "doc_lines": documentation_lines_udf("chunk", F.col(ext))})


def labelled(rows: DataFrame, labels: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """Adds is_labeled: 1 where (repo, file) is among the labels, else 0."""
    marks = labels.dropna(subset=["repo", "file"]).select(F.col("repo").alias(repo), F.col("file").alias(path)).distinct().withColumn("is_labeled", F.lit(1))
    return rows.join(marks, [repo, path], "left").withColumn("is_labeled", F.coalesce("is_labeled", F.lit(0)))
