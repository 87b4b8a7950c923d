"""Posts as tables: order of results, marks of known keys, unions of searches, watchlists, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders of results by what is sorted on first; ties go to company, title, address, ascending.
NO_AGE, NO_TIER = 9999.0, 99


def ranked_posts(df: DataFrame, by: str, most: int) -> DataFrame:
    """The first `most` posts by score, newest or emails, over score, has_email, tier, hours, n_emails, company, title, url. A top-k: no global sort."""
    score, tier, hours = F.coalesce("score", F.lit(0)), F.coalesce("tier", F.lit(NO_TIER)), F.coalesce("hours", F.lit(NO_AGE))
    mail = F.coalesce("has_email", F.lit(False))
    orders = {"score": [score.desc(), mail.desc(), tier.asc(), hours.asc()], "newest": [hours.asc(), score.desc()], "emails": [mail.desc(), tier.asc(), F.coalesce("n_emails", F.lit(0)).desc(), score.desc()]}
    ties = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("company", "title")] + [F.coalesce("url", F.lit(""))]
    return df.orderBy(*orders[by], *ties).limit(most)


def marked(df: DataFrame, key: str, keys: str, known: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Each row with one boolean per kind: whether any of its keys is in known (key, kind). Known keys are made distinct first, so no key multiplies rows.

    Only (key, one known key) pairs are shuffled; marks are summed per row before they are joined back.
    """
    pairs = df.select(F.col(key).alias("_row_key"), F.explode(F.array_distinct(keys)).alias("key"))
    flags = known.groupBy("key").agg(*[F.max(F.col("kind") == k).alias(k) for k in kinds])
    found = pairs.join(flags, "key").groupBy("_row_key").agg(*[F.max(k).alias(k) for k in kinds])
    return df.join(found, df[key] == found["_row_key"], "left").drop("_row_key").fillna(False, list(kinds))


def first_found(df: DataFrame, batch: str, position: str, url: str, most: int) -> DataFrame:
    """Addresses that several searches found, each once, in the order of searches and of places in them; the first `most`."""
    return df.groupBy(url).agg(F.min(F.struct(batch, position)).alias("at")).orderBy("at", url).limit(most).select(url, f"at.{batch}", f"at.{position}")


def watched(posts: DataFrame, lists: DataFrame, id_: str, text: Column, score: Column, newest: Column, latest: int = 150, shown: int = 15) -> DataFrame:
    """Matches of watchlists (watch, role, least) among the latest posts: a post holds any word of the role and scores enough. The newest `shown` of each, with the count of all.

    Only `latest` posts meet the lists, which bounds the side that is broadcast; lists are spread.
    """
    recent = posts.select(F.col(id_).alias("post"), F.lower(F.coalesce(text, F.lit(""))).alias("said"), score.alias("score"), newest.alias("at")).orderBy(F.desc("at"), "post").limit(latest)
    words = F.filter(F.split(F.lower(F.trim("role")), r"\s+"), lambda w: F.char_length(w) >= 2)
    hit = (F.size("words") == 0) | F.exists("words", lambda w: F.contains(F.col("said"), w))
    both = lists.withColumn("words", words).join(F.broadcast(recent), hit & (F.col("score") >= F.col("least")))
    place = Window.partitionBy("watch").orderBy(F.desc("at"), "post")
    return both.select("watch", "post", "score", F.row_number().over(place).alias("rank"), F.count("*").over(Window.partitionBy("watch")).alias("n")).where(F.col("rank") <= shown)


def mail_counters(df: DataFrame, owner: str, status: Column, template: Column) -> DataFrame:
    """Messages of each owner that were sent, came back, and followed up."""
    return df.groupBy(owner).agg(F.count_if(status == "sent").alias("sent"), F.count_if(status == "bounced").alias("bounced"), F.count_if(template == "follow_up").alias("follow_ups"))


def opening_day(df: DataFrame, owner: str, ts: str, today: Column) -> DataFrame:
    """The day that an owner's calendar opens on: today if anything happened then, else the latest day with something."""
    day = F.to_date(ts)
    return df.groupBy(owner).agg(F.coalesce(F.max(F.when(day == today, day)), F.max(day)).alias("day"))


def strongest(df: DataFrame, skill: Column, most: int = 8) -> DataFrame:
    """The skills that most rows match, ties by name."""
    return df.groupBy(skill.alias("skill")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(most)
