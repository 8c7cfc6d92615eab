"""Connected components of an edge table, without collecting edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs), component being its smallest node.

    Alternates the large-star and small-star steps: a node's larger neighbours, then its smaller ones, are
    linked to the smallest of its neighbourhood, until every node hangs on the smallest of its component.
    Both are a minimum by key, which is summed up before the shuffle, and a join with it. Each round is
    written to the shared folder, so a lost executor repeats one round at most.
    """

    def tally(df):
        x = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(x)

    def star(edges, large):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(low, "u")
        if large:
            met = met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            met = met.filter("v < u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.filter("m < u").select(F.col("m").alias("a"), F.col("u").alias("b")))
        return met.filter("a < b").distinct()

    now = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{name}-0")
    before = tally(now)
    for k in range(1, most + 1):
        if not before[0]:
            break
        middle = scratch.keep(star(now, True), f"{name}-{k}-large")
        now = scratch.keep(star(middle, False), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large")
        scratch.drop(f"{name}-{k - 1}")
        after = tally(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components have not settled")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
