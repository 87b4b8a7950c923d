"""Key phrases of postings and how many postings have them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import phrases as P


def phrase_counts(df: DataFrame, key: str, text: Column, title: Column, tools: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """(key, phrase, n, place, words): each telling phrase of a row of df in lower case, how often it comes, the place where it first does, and its words as they stand there.

    Texts are dealt by their key, once: they are smaller than the phrases, and neither the counts nor what ranks them by key is shuffled again.
    """
    rows = df.select(F.col(key), title.alias("title_"), text.alias("text_")).repartition(key)
    runs = rows.select(key, "title_", F.posexplode(P.phrase_runs(F.col("text_"))).alias("place", "words")).where(P.telling(F.col("words"), F.col("title_"), tools, exclude))
    phrase = F.array_join(F.transform("words", F.lower), " ")
    return runs.select(key, phrase.alias("phrase"), "place", "words").groupBy(key, "phrase").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.min_by("words", "place").alias("words"))


def key_phrases(counts: DataFrame, key: str, most: int = 10, spelled: Mapping[str, str] | None = None) -> DataFrame:
    """(key, rank, phrase, shown) of the phrases of phrase_counts() that tell most: the most frequent first, then the earliest, without those that hold or are held by a better one."""
    one = F.struct((-F.col("n")).alias("n"), "place", "phrase", "words")
    rows = counts.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("all_"))
    rows = rows.select(key, "all_", F.posexplode(P.unnested(F.transform("all_", lambda x: x["phrase"]), most)).alias("rank", "phrase"))
    words = F.get(F.filter("all_", lambda x: x["phrase"] == F.col("phrase")), F.lit(0))["words"]
    return rows.select(key, (F.col("rank") + 1).alias("rank"), "phrase", P.shown(words, spelled).alias("shown"))


def phrase_spread(counts: DataFrame, least: int = 2) -> DataFrame:
    """(phrase, n_rows, n): in how many rows each phrase comes, and how often, from `least` rows on."""
    return counts.groupBy("phrase").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n")).where(F.col("n_rows") >= least)
