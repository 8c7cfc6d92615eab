"""The driver's tables in the roles of the engine's facts: orders as commits, line items as file changes.

A customer is an author, an order a commit, a line item a changed file: its quantity the added lines, its
line number the deleted ones, its return flag the language, its supplier the repository. An order's priority
is a skill, its clerk-less status a model, a page's URL a file path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S

#: Rows of the larger table that a task of a join should have, and those it may have at most.
ROWS, MOST = 500_000, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in smaller Arrow batches than the default: a Python worker holds a few batches of whole texts at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return table(spark, sf_dir, "documents")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to four tasks a core: for work that is dear by row, where a small file would be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def joined(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``others``; where ``rows`` are many both are dealt by the key, to tasks of about ``ROWS`` of them.

    Left to itself adaptive execution makes few tasks of up to 64 compressed MB each, whose sorts and groups take over 1,000 MB.
    To at most 200 tasks Spark's shuffle writes rows as they come; to more it holds what a task writes, to sort it. So there
    are more only where a task would get over ``MOST`` rows, and fewer than ``spark.sql.shuffle.partitions`` are raised to that.
    """
    n = rows.count()
    n = max(min(200, -(-n // ROWS)), -(-n // MOST))
    if n > rows.sparkSession.sparkContext.defaultParallelism:
        rows, others = rows.repartition(n, key), others.repartition(n, key)
    return rows.join(others, key)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("repo"), F.col("o_orderdate").alias("at"), S.month_of("o_orderdate").alias("ym"), "o_orderpriority", "o_totalprice")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per changed file with its commit's author and month."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_returnflag").alias("ext"), F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"), "l_linestatus", "l_discount", "l_tax",
    )
    return joined(li, commits(spark, sf_dir), "commit_id")
