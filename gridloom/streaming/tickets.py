"""A stream of revisions: only the newest revision of each task counts. An extension; batch queries use ``latest_tickets``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_revisions(stream: DataFrame, task: str, revision: str) -> DataFrame:
    """Running greatest revision of each task; write in update mode. Stale revisions change nothing."""
    return stream.groupBy(task).agg(F.max(revision).alias("revision"))


def usage_by_window(stream: DataFrame, time: str, color: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Beads placed per colour and window; events later than ``late`` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), color).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), color, "n")
