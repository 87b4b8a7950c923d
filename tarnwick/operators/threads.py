"""Messages and posts that belong together over time: threads, applications without an answer, posts that come again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auto_closed(df: DataFrame, key: str, ts: str, follow_up: Column, noted_reply: Column, real_reply: Column, as_of: Column, days: int) -> DataFrame:
    """Applications whose last follow-up is `days` old or older, without a reply noted since and without any real reply. One partial aggregation; nothing is changed."""
    got = df.groupBy(key).agg(F.max(F.when(follow_up, F.col(ts))).alias("last_follow_up"), F.max(F.when(noted_reply, F.col(ts))).alias("noted"), F.coalesce(F.bool_or(real_reply), F.lit(False)).alias("alive"))
    old = as_of.cast("timestamp").cast("double") - F.col("last_follow_up").cast("timestamp").cast("double")
    open_ = (old >= days * 86400) & ~F.coalesce(F.col("noted") >= F.col("last_follow_up"), F.lit(False)) & ~F.col("alive")
    return got.where(open_).select(key, "last_follow_up", F.bround(old / 86400, 1).alias("days"))


def threads(logs: DataFrame, notes: DataFrame, key: str, ts: str, tie: str, inbound: Column) -> DataFrame:
    """Each application's messages in order of time: its log, and the replies in its notes only if its log has no reply. Both sides are (key, ts, tie, ...)."""
    sent = logs.select(key, ts, tie, F.when(inbound, "inbound").otherwise("outbound").alias("direction"))
    answered = sent.where("direction = 'inbound'").select(key).distinct()
    noted = notes.join(answered, key, "left_anti").select(key, ts, tie, F.lit("inbound").alias("direction"))
    place = Window.partitionBy(key).orderBy(ts, tie)
    return sent.unionByName(noted).select(key, tie, "direction", F.row_number().over(place).alias("place"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str, filled: list[str], text: str, fit: str, default_fit: int = 75) -> DataFrame:
    """Known posts with what a batch says of them, and the batch's other posts. The first of a batch's rows for a key counts; its non-empty fields and a longer
    text replace the known ones, and the better fit stays. Both sides are shuffled once, by key, after the batch is reduced to one row a key."""
    first = new.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.min_by(F.struct(*filled, text, fit), order).alias("_new"))
    known = old.select(F.col(key), F.struct(*filled, text, fit).alias("_old"))
    both = known.join(first, key, "full")
    said = lambda c: F.nullif(F.col(f"_new.{c}"), F.lit(""))
    longer = F.char_length(F.coalesce(F.col(f"_new.{text}"), F.lit(""))) > F.char_length(F.coalesce(F.col(f"_old.{text}"), F.lit("")))
    better = F.when(F.col("_old").isNull(), F.coalesce(F.nullif(F.col(f"_new.{fit}"), F.lit(0)), F.lit(default_fit))).otherwise(F.greatest(F.coalesce(F.col(f"_old.{fit}"), F.lit(0)), F.coalesce(F.col(f"_new.{fit}"), F.lit(0))))
    return both.select(key, *[F.coalesce(said(c), F.col(f"_old.{c}")).alias(c) for c in filled], F.when(longer, F.col(f"_new.{text}")).otherwise(F.coalesce(F.col(f"_old.{text}"), F.lit(""))).alias(text), better.alias(fit))
