"""Counts, rates, calendars and follow-ups over applications, logs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(df: DataFrame, status: str, alias: dict[str, str], missing: str) -> DataFrame:
    """Rows by status after aliases and a name for null."""
    named = F.coalesce(F.col(status), F.lit(missing))
    for old, new in alias.items():
        named = F.when(named == old, new).otherwise(named)
    return df.groupBy(named.alias("status")).agg(F.count("*").alias("n"))


def rate(part: Column, whole: Column, digits: int = 0) -> Column:
    """A percentage, half to even; null without a whole."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def pipeline_stats(df: DataFrame, status: str, saved: str, answered: list[str]) -> DataFrame:
    agg = df.agg(F.count("*").alias("total"), F.count_if(F.col(status) == saved).alias("saved"), F.count_if(F.col(status).isin(answered)).alias("answered"))
    return agg.select("total", "saved", "answered", (F.col("total") - F.col("saved")).alias("submitted"), rate(F.col("answered"), F.col("total") - F.col("saved"), 1).alias("response_rate"))


def calendar(df: DataFrame, ts: str, kind: str, kinds: list[str]) -> DataFrame:
    """Per day: all rows and rows of each kind."""
    return df.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count("*").alias("total"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def due(df: DataFrame, key: str, ts: str, kind: str, opened: str, closed: str, bad: str, as_of: str, days: int, most_bad: int) -> DataFrame:
    """Keys that opened at least `days` ago, never closed, and had fewer than most_bad bad rows; one pass with partial sums."""
    agg = df.groupBy(key).agg(F.min(F.when(F.col(kind) == opened, F.col(ts))).alias("opened"), F.count_if(F.col(kind) == closed).alias("c"), F.count_if(F.col(kind) == bad).alias("b"))
    waiting = F.datediff(F.lit(as_of).cast("date"), F.col("opened").cast("date"))
    return agg.where(F.col("opened").isNotNull() & (F.col("c") == 0) & (F.col("b") < most_bad) & (waiting >= days)).select(key, waiting.alias("waiting"))


def running_count(df: DataFrame, key: str, ts: str, tie: str, quota: int) -> DataFrame:
    """Each row's number within its key and day, and whether the quota still allows it."""
    w = Window.partitionBy(key, F.col(ts).cast("date")).orderBy(ts, tie)
    return df.select(key, tie, F.row_number().over(w).alias("nth")).withColumn("allowed", F.col("nth") <= quota)


def skill_gap(df: DataFrame, skills: Column, fit: Column, owner: Column, top: int = 14) -> DataFrame:
    """Skills by weight: clamp((100 - fit) / 100, .15, 1) summed, .45 where the fit is unknown, the number of rows and of owners."""
    weight = F.when(fit.isNull(), 0.45).otherwise(F.greatest(F.lit(0.15), F.least(F.lit(1.0), (100 - fit) / 100)))
    rows = df.select(F.explode(F.array_distinct(skills)).alias("skill"), weight.cast("decimal(10,4)").alias("w"), owner.alias("owner"))
    agg = rows.groupBy("skill").agg(F.round(F.sum("w").cast("double"), 2).alias("weight"), F.count("*").alias("n"), F.countDistinct("owner").alias("n_owners"))
    return agg.orderBy(F.desc("weight"), F.desc("n"), "skill").limit(top)
