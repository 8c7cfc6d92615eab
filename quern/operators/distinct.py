"""Exact distinct counts that merge: bitmaps over dense codes, kept by repository.

A value of a kind (a user, a month, a skill) has a code in a dictionary that only grows; what a repository has of a kind
is a set of bits. Counts over any repositories are the bits of the union, and raw rows are never read again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.numbering import ROWS, numbered


def codes(values: DataFrame, known: DataFrame | None = None, rows_a_range: int = ROWS) -> DataFrame:
    """kind, value, code of all distinct ``values`` (kind, value) and of those ``known``, whose codes stay. Nulls have none."""
    new = values.select("kind", "value").dropna().distinct()
    start = 0
    if known is not None:
        new = new.join(known.select("kind", "value"), ["kind", "value"], "left_anti")
        start = (known.agg(F.max("code")).first()[0] or -1) + 1 if known.take(1) else 0
    new = numbered(new, "kind", "value", into="code", rows_a_range=rows_a_range).withColumn("code", F.col("code") + start)
    return new if known is None else known.select("kind", "value", "code").unionByName(new)


def bitmaps(rows: DataFrame, codes_: DataFrame, keys: Iterable[str] = ("repo",)) -> DataFrame:
    """keys, kind, bucket, bits: the values that each key has of each kind; ``rows`` are keys, kind, value."""
    coded = rows.join(codes_, ["kind", "value"])
    return coded.groupBy(*keys, "kind", F.bitmap_bucket_number("code").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))


def merged(bits: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """The union of bitmaps over what isn't among ``keys``."""
    return bits.groupBy(*keys, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(bits: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """keys, kind, n: how many distinct values there are."""
    return merged(bits, keys).groupBy(*keys, "kind").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def summary_values(activity: DataFrame, totals: DataFrame) -> DataFrame:
    """repo, kind, value of all that a summary counts, from monthly rows and skill totals by repository."""
    columns = {"users": "author", "months": "ym", "languages": "lang", "repos": "repo"}
    out = totals.select("repo", F.lit("skills").alias("kind"), F.col("skill").cast("string").alias("value"))
    for kind, c in columns.items():
        out = out.unionByName(activity.select("repo", F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")))
    return out


def merged_summary(bits: DataFrame, lines: DataFrame) -> DataFrame:
    """One row as :func:`quern.operators.report.merge_summary` has it, from bitmaps and ``lines`` (repo, lines) by repository."""
    n = counted(bits)
    kinds = ("users", "months", "languages", "repos", "skills")
    row = n.agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0).cast("bigint")).alias(k) for k in kinds])
    return row.crossJoin(lines.agg(F.sum("lines").cast("bigint").alias("lines")))  # one row each
