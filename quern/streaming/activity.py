"""Monthly activity over a stream of commits: an extension, the batch operators need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_events(events: DataFrame, late: str = "1 day", ts: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by day window and keys; rows later than the watermark allows are left out, and state ends with it."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp"))
    out = rows.withWatermark("_at", late).groupBy(F.window("_at", "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("day"), *keys, "n", "total")
