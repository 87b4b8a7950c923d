"""What goes with blocked addresses: applications that name them, and whatever hangs on rows that go. Nothing is deleted here; the rows are told."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.urls import emails
from tarnwick.session import settled


def blocked_for(blacklist: DataFrame) -> DataFrame:
    """(user, email): whom each blocked address concerns, null for everyone. Entries that a user made by hand (source manual) concern that user only."""
    own = F.col("user").isNotNull() & F.coalesce(F.col("source") == "manual", F.lit(False))
    known = blacklist.where("trim(coalesce(email, '')) <> ''")
    return known.select(F.when(own | F.col("user").isNull(), F.col("user")).alias("user"), F.lower(F.trim("email")).alias("email")).distinct()


def dead_applications(apps: DataFrame, logs: DataFrame, blacklist: DataFrame) -> DataFrame:
    """(app, user, by_log, by_notes, by_url) of the applications (app, user, notes, url) that name an address blocked for their user: in a mail sent for them (logs: app, user, to_email), in their notes, or in their URL.

    All addresses that an application names are met with the blocked ones in one join of equal addresses; an address that stands inside a longer word is not found.
    """
    told = apps.select("app", "user", F.explode(F.array(F.struct(F.lit("notes").alias("kind"), emails(F.col("notes")).alias("named")), F.struct(F.lit("url").alias("kind"), emails(F.col("url")).alias("named")))).alias("x"))
    told = told.select("app", "user", "x.kind", F.explode("x.named").alias("email"))
    sent = logs.where("app IS NOT NULL").select("app", "user", F.lit("log").alias("kind"), F.lower(F.trim("to_email")).alias("email"))
    sent = sent.join(apps.select("app"), "app", "left_semi")
    hit = told.unionByName(sent).join(blocked_for(blacklist).withColumnRenamed("user", "whose"), "email").where("whose IS NULL OR whose = user")
    any_of = lambda kind: F.bool_or(F.col("kind") == kind).alias(f"by_{kind}")
    return hit.groupBy("app", "user").agg(any_of("log"), any_of("notes"), any_of("url"))


def cascade(tables: dict[str, tuple[DataFrame, str]], links: Sequence[tuple[str, str, str]], doomed: dict[str, DataFrame], rounds: int = 100) -> dict[str, DataFrame]:
    """The keys of the rows that go, by table: those of `doomed` (one column of keys) and, along the links, whatever refers to a row that goes.

    tables gives each table and its key; a link (child, column, parent) says that a child's column holds a key of parent. Links may form circles, also of a table with itself. In each round
    only rows that went in the last one are followed, until none is new; every step is a semi join of a written table, so no graph is collected. Null references hold nothing.
    """
    gone = {name: settled(doomed[name].toDF("key").where("key IS NOT NULL").distinct()) if name in doomed else None for name in tables}
    fresh = {name: df for name, df in gone.items() if df is not None}
    for _ in range(rounds):
        found: dict[str, DataFrame] = {}
        for child, column, parent in links:
            if parent in fresh:
                df, key = tables[child]
                hit = df.select(F.col(key).alias("key"), F.col(column).alias("ref")).join(fresh[parent].withColumnRenamed("key", "ref"), "ref", "left_semi").select("key")
                found[child] = found[child].unionByName(hit) if child in found else hit
        fresh = {}
        for child, hit in found.items():
            new = hit.distinct() if gone[child] is None else hit.distinct().join(gone[child], "key", "left_anti")
            new = settled(new)
            if not new.isEmpty():
                fresh[child] = new
                gone[child] = new if gone[child] is None else gone[child].unionByName(new)
        if not fresh:
            return {name: df for name, df in gone.items() if df is not None}
    raise RuntimeError(f"the cascade went on for more than {rounds} rounds")
