"""Runs that go on: a stream of new commits, merged into what earlier runs have found.

A batch has the commits that came since the last one, each read, counted and diffed once. Its months are added to the
written ones by key, so no earlier commit is looked at again. What depends on all commits of an author (the months an
author must have been active) is decided when results are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import scalars as S
from quern.operators import activity as A
from quern.plans.profile import Facts, Steps, facts_of
from quern.sources import git as G

#: How the rows of a key are merged: what grows by adding, what is the least and the largest.
_ACTIVITY = {c: F.sum for c in ("added", "deleted", "commits", "too_big", "sig_cont")}
_TABLES = {
    "activity": (["repo", "author", "lang", "ym"], _ACTIVITY),
    "spans": (["repo", "author", "lang"], {"st": F.min, "et": F.max}),
    "months": (["repo", "author", "ym"], {}),
}


def merged(rows: DataFrame, table: str) -> DataFrame:
    """One row per key of rows that several batches give."""
    keys, how = _TABLES[table]
    return rows.groupBy(*keys).agg(*[f(c).cast(rows.schema[c].dataType).alias(c) for c, f in how.items()]) if how else rows.select(*keys).distinct()


class State:
    """Tables of a run below ``folder``: of each batch what git gave and the snippets, and a version of every merged table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The batches that are merged whole, in their order."""
        found = self._fs.globStatus(self._path(f"{self.folder}/merged/batch=*/_SUCCESS"))
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or ())

    def commits(self, batches: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/batch-{b}/commits" for b in batches]) if batches else None

    def at(self, table: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}/batch={batch}")

    def take(self, rows: DataFrame, batch: int, config: Config) -> None:
        """Merges a batch of ``git_log`` rows. A batch that comes again after a failure is made again from the same version."""
        done = self.batches()
        if batch in done:
            return
        before = [b for b in done if b < batch]
        steps = Steps(f"{self.folder}/batch-{batch}")
        known = self.commits(before)
        if known is not None:  # a rewritten history is read from its beginning
            rows = rows.join(known.filter("error is null").select("repo_path", "commit_id"), ["repo_path", "commit_id"], "left_anti")
        rows = steps.once("commits", rows.select("repo_path", "repo", "author", "ts", "commit_id", "error"))
        f = facts_of(rows.filter("error is null").drop("error"), rows.filter("error is not null"), steps, config)
        steps.once("snippets", f.snippets)
        steps.once("errors", f.errors)
        new = {"activity": f.activity, "spans": f.spans, "months": f.commits.select("repo", "author", S.year_month("ts").alias("ym"))}
        for table, part in new.items():
            both = self.at(table, before[-1]).unionByName(part) if before else part
            merged(both, table).write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/merged/batch={batch}")


def advance(spark: SparkSession, paths: Iterable[str], folder: str, config: Config = Config(), commits: int = 20_000) -> State:  # noqa: B008
    """Reads what is new in the repositories since the last call with this ``folder`` and merges it.

    ``folder`` is one that driver and executors share. Commits that a rewritten history has dropped stay counted.
    Repositories are told apart by name in the results, so names should differ; paths may be added from run to run.
    """
    G.register(spark)
    state = State(spark, folder)
    rows = spark.readStream.format("git_log").option("paths", ",".join(paths)).option("commits", commits).load()
    q = rows.writeStream.foreachBatch(lambda df, batch: state.take(df, batch, config)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return state


def results(state: State, config: Config = Config(), allow: DataFrame | None = None) -> Facts | None:  # noqa: B008
    """What a run over all commits read so far gives, gates included; nothing before the first batch."""
    done = state.batches()
    if not done:
        return None
    spark, last = state.spark, done[-1]

    def every(name: str) -> DataFrame:
        return spark.read.parquet(*[f"{state.folder}/batch-{b}/{name}" for b in done])

    active = state.at("months", last).groupBy("repo", "author").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= config.min_months).select("repo", "author")
    active = A.allowed(active, allow)
    held = lambda df: df.join(active, ["repo", "author"], "left_semi")
    diffs = every("diffs")
    return Facts(held(every("commits").filter("error is null").drop("error")), held(every("changes")), held(diffs), held(every("snippets")), held(state.at("activity", last)), held(state.at("spans", last)), every("errors"))
