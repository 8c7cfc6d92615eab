"""Places in an order, without a task that sees all rows."""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range should have.
ROWS = 500_000


def numbered(rows: DataFrame, *order: str, into: str = "no", rows_a_range: int = ROWS) -> DataFrame:
    """``rows`` with their places from 0 in the order of the columns ``order``, nulls first; equal rows come in any order.

    Spark deals the rows to ranges of about ``rows_a_range``, by bounds that it samples and searches in halves; the ranges
    are kept (on disk), counted, and each is numbered on its own from where those before it end. The driver holds a count
    for each range, never rows. ``rows`` are computed three times: write what is dear, and let it be the same each time.
    """
    n = -(-rows.count() // rows_a_range)
    dealt = rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY) if n > 1 else rows.withColumn("__range", F.lit(0))
    counts = {r["__range"]: r["count"] for r in dealt.groupBy("__range").count().collect()}
    starts = list(itertools.accumulate((counts.get(r, 0) for r in range(max(counts, default=0))), initial=0))
    before = F.element_at(F.split(F.lit(",".join(map(str, starts))), ","), F.col("__range") + 1).cast("bigint")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(into, before + own - 1).drop("__range")
