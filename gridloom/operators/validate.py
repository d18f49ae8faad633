"""Rules as queries that return their violations, and review summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def palette_violations(palette: DataFrame) -> DataFrame:
    """(rule, value): repeated ids, repeated codes, channels outside 0..255."""
    twice = lambda c, rule: palette.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("value"))
    bad = palette.where("NOT (r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255)")
    return twice("id", "repeated id").unionByName(twice("code", "repeated code")).unionByName(bad.select(F.lit("channel out of range").alias("rule"), F.col("id").alias("value")))


def run_violations(runs: DataFrame, key: str, size: int) -> DataFrame:
    """Runs that are empty, out of bounds, or begin before the previous one ends."""
    before = F.lag(F.col("start") + F.col("length")).over(Window.partitionBy(key).orderBy("start", "length"))
    rule = F.when(F.col("length") < 1, "empty").when((F.col("start") < 0) | (F.col("start") + F.col("length") > size), "out of bounds").when(before > F.col("start"), "overlap")
    return runs.withColumn("rule", rule).where("rule IS NOT NULL")


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """(grid_id, idx, colors): cells locked to more than one colour, or both to a colour and to be empty (null)."""
    value = F.coalesce("color", F.lit("(empty)"))
    return locks.groupBy("grid_id", "idx").agg(F.sort_array(F.collect_set(value)).alias("c")).where(F.size("c") > 1).select("grid_id", "idx", F.concat_ws(",", "c").alias("colors"))


def review_summary(ratings: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(metric, mean, groups): the mean of group means, so that each group counts alike."""
    per = ratings.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("p")
    return per.select(pairs).select("p.*").groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("groups"))


def bill_differences(cells: DataFrame, bill: DataFrame) -> DataFrame:
    """(grid_id, color, counted, stated): colours whose stated number isn't that of the cells; either side may lack one."""
    counted = cells.where("color IS NOT NULL").groupBy("grid_id", "color").agg(F.count(F.lit(1)).alias("counted"))
    both = counted.join(bill.select("grid_id", "color", F.col("n").alias("stated")), ["grid_id", "color"], "full")
    return both.where(~F.col("counted").eqNullSafe(F.col("stated")))
