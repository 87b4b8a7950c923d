"""Steps that several queries share: each text is read once, whatever the number of rules that ask about it."""

import math
import re
import time

from pyspark.sql import functions as F

from tarnwick.functions import posts, relevance, rules, urls
from tarnwick.functions.lexicon import SHORT
from tarnwick.operators import entity, match, scoring
from tarnwick.plans import matching
from tarnwick.plans import posts as matching_posts

PROSE = "tionan ererly build of a thand edtion, in 2020; we ship (often) and test. " * 270


def _texts(spark, n, before=""):
    return spark.range(n).repartition(4).select("id", F.concat(F.lit(before), F.lit(PROSE), F.col("id").cast("string")).alias("text"))


def _seconds(df):
    start = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


def test_candidates_do_not_repeat_the_posting(spark):
    people = _texts(spark, 600, "Python. Location: Paris\n").select("id", F.lit("Senior engineer").alias("headline"), F.col("text").alias("snippet"))
    out = match.candidate_match(people, matching.JOB_TEXT, matching.JOB_TITLE, "Paris", SHORT, matching.PLACES)
    assert _seconds(out) < 25
    row = out.where("id = 7").first()
    assert (row.place_score, row.seniority_gap, row.available) == (100, False, False)


def test_addresses_that_follow_each_other(spark):
    cases = {
        "ab at cd dot dot com": ["ab@cd..com"], "ann@b.com1x@yy.de": ["ann@b.com", "1x@yy.de"], "a@b.abcdefghijklmno@xx.com": ["klmno@xx.com"], "ab\x0b@cd.com": [], "ab\x0bat cd.com": [], "foo@at at bar.com": [], "jo at cd dot com at ef dot org": ["jo@cd.com"],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", urls.emails(F.col("t")).alias("e"))
    assert {r.t: r.e for r in rows.collect()} == cases


def test_links_of_a_hot_value(spark):
    left, right = (spark.range(20_000).select(F.col("id").alias(c), F.lit("hot").alias(f"{c}_a"), (F.col("id") % n).alias(f"{c}_b")) for c, n in (("l", 7000), ("r", 5000)))
    links = entity.scored_links(left, right, "l", "r", [(F.col("l_a"), F.col("r_a"), 45), (F.col("l_b"), F.col("r_b"), 30)], 30)
    assert _seconds(links) < 20
    got = {r.l: (r.r, r.score) for r in links.where("l in (3, 4999, 5000, 6999, 7003)").collect()}
    assert got == {3: (3, 75), 4999: (4999, 75), 5000: (0, 45), 6999: (0, 45), 7003: (3, 75)}


def test_nearest_in_a_hot_bin(spark):
    left, right = (spark.range(40_000).select(F.col("id").alias(c), F.lit(1).alias("nation"), (F.col("id") % n / 100).alias("value")) for c, n in (("x", 30_000), ("y", 20_000)))
    near = entity.nearest(left, right, "x", "y", 1000)
    assert _seconds(near) < 20
    assert {r.x: (r.y, r.gap) for r in near.where("x in (5, 19999, 20010, 30005)").collect()} == {5: (5, 0.0), 19999: (19999, 0.0), 20010: (19999, 0.11), 30005: (5, 0.0)}


def test_texts_are_read_once(spark):
    rows = _texts(spark, 600).select("text", F.lit("Go Engineer").alias("title"))
    text, title, day = F.col("text"), F.col("title"), F.lit("2026-01-15").cast("date")
    each = {
        "relevance": relevance.best_relevance(["Senior Full Stack Engineer", "data analyst", "golang"], title, text, relevance.SearchWords()), "deadline": rules.deadline(title, text, day),
        "gate": posts.language_gate(title, text, title), "hiring": posts.hiring_intent(text, title, matching_posts.PARAMS_AGAINST, matching_posts.PARAMS_FOR, matching_posts.PARAMS_WORDS),
    }
    took = {name: _seconds(rows.select(c.alias("x"))) for name, c in each.items()}
    assert max(took.values()) < 12, took


def test_greedy_merge_of_many_and_of_long_chains(spark):
    alone = spark.range(1000, 31_000).select(F.col("id").alias("seq"), F.array(F.concat(F.lit("own"), "id")).alias("keys"))
    chain = spark.range(300).select(F.col("id").alias("seq"), F.array(F.concat(F.lit("k"), "id"), F.concat(F.lit("k"), F.col("id") + 1)).alias("keys"))
    start = time.monotonic()
    got = {r.seq: r.cluster for r in entity.greedy_merge(alone.union(chain), "seq", "keys").collect()}
    assert got == {n: n for n in range(1000, 31_000)} | dict.fromkeys(range(300), 0)
    assert time.monotonic() - start < 60


def test_postings_words_are_not_shuffled(spark):
    cvs = spark.createDataFrame([("c", "python and python and kafka"), ("none", "")], "cv_id string, cv_text string")
    jobs = spark.createDataFrame([(1, "", "kafka python kafka python"), (2, "", ""), (3, "", "soup")], "job_id long, title string, text string")
    out = match.cv_match(cvs, jobs, SHORT)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.cv_id, r.job_id): r.semantic_score for r in out.collect()}
    assert got[("c", 1)] > 0 and all(n == 0 for k, n in got.items() if k != ("c", 1))
    counted = spark.createDataFrame([(["b", "a", "b", "a"],), ([],), (["x"],)], "w array<string>").select(match.counted_terms(F.col("w")).alias("f")).select("f.*").collect()
    assert [dict(zip(r.terms, r.counts, strict=True)) for r in counted] == [{"a": 2, "b": 2, "a b": 1, "b a": 2}, {}, {"x": 1}]


def test_best_document_across_small_batches(spark):
    words = [["a", "b", "a"], [], ["b"], ["c", "c", "c", "a"], ["b"], ["a", "a", "b"], ["z"]]
    docs = spark.createDataFrame([(n, w) for n, w in enumerate(words)] + [(None, ["c"])], "doc long, tokens array<string>").coalesce(1)
    asked = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", "b"), ("z", "c"), ("none", "q")], "item string, token string")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = scoring.bm25_best(asked, docs, "item", "doc")
        got = {r.item: (r.doc, r.bm25) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert not re.search(r"hashpartitioning\((item|q)#\d+L?, (doc|d)#", out._jdf.queryExecution().executedPlan().toString())

    def score(item, w):
        mine = {t for i, t in (("x", "a"), ("x", "b"), ("y", "b"), ("z", "c")) if i == item}
        return round(min(1.0, sum(math.log(4) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / 150)) for t in mine if t in w) / (len(mine) * math.log(2) * 2.5)), 6)

    assert got == {i: min(((n, score(i, w)) for n, w in enumerate(words)), key=lambda x: (-x[1], x[0])) for i in ("x", "y", "z")}
