"""Digests: for each user the best new postings since the last one, and what has been sent before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a key's rows are ranked in first, so that a user with a large share of all rows is no task of its own.
SALTS = 16


@dataclass(frozen=True)
class Rules:
    """How many postings a digest has; how many fresh ones make those sent before needless; from which score on, and how many of these, others are left out; how many sent ones are remembered; hours between digests."""

    size: int = 5
    enough_fresh: int = 3
    good: int = 80
    enough_good: int = 3
    remembered: int = 50
    spacing_h: float = 23


def best_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their `rank`, ranked in SALTS parts first, so that k rows of each part are all that meet."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(SALTS))
    some = df.withColumn("part_", spread).withColumn("rank_", F.row_number().over(Window.partitionBy(key, "part_").orderBy(*order))).where(F.col("rank_") <= k).drop("part_", "rank_")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def digests(candidates: DataFrame, seen: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(user, rank, url, score, fresh) from candidates (user, seq, url, score) and what was sent before, seen (user, url, at).

    A URL counts once, where it comes first (the smallest seq). If a user has enough fresh candidates, those sent before are left out; if enough of the rest are good, the others are. Then the best scores come first, on ties fresh
    ones and then those that came first. Null scores count zero; rows without user or URL are no candidates.
    """
    rows = candidates.where("user IS NOT NULL AND url IS NOT NULL").groupBy("user", "url").agg(F.min("seq").alias("seq"), F.min_by(F.coalesce("score", F.lit(0)), "seq").alias("score"))
    known = seen.select("user", "url").distinct().withColumn("known_", F.lit(True))
    rows = rows.join(known, ["user", "url"], "left").withColumn("fresh", F.col("known_").isNull()).drop("known_")
    good = F.col("score") >= rules.good
    counts = rows.groupBy("user").agg(F.count_if("fresh").alias("n_fresh"), F.count_if(F.col("fresh") & good).alias("fresh_good"), F.count_if(good).alias("all_good"))
    alone = F.col("n_fresh") >= rules.enough_fresh
    picky = F.when(alone, F.col("fresh_good")).otherwise(F.col("all_good")) >= rules.enough_good
    rows = rows.join(counts, "user").where((~alone | F.col("fresh")) & (~picky | good)).select("user", "url", "seq", "score", "fresh")
    return best_per_key(rows, "user", [F.desc("score"), F.desc("fresh"), F.asc("seq")], rules.size).select("user", "rank", "url", "score", "fresh")


def remembered(seen: DataFrame, sent: DataFrame, no: int, rules: Rules = Rules()) -> DataFrame:
    """seen (user, url, at) after the digest `no`: its new URLs behind the others, the last ones of each user kept."""
    new = sent.where("fresh").select("user", "url", (F.lit(no).cast("long") * 1000 + F.col("rank")).alias("at"))
    return best_per_key(seen.unionByName(new), "user", [F.desc("at")], rules.remembered).drop("rank")
