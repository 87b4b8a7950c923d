"""Phrases and tools: single rules, and time on long texts."""

import time

from pyspark.sql import functions as F

from tarnwick.functions import phrases as P
from tarnwick.operators import phrases as O

RUNS = {
    "Design scalable ETL pipelines and data models; maintain data quality": ["scalable ETL pipelines", "data models", "data quality"], "a degree in data science. customer inquiries": ["customer inquiries"], "of the data of the web": [],
    "house of cards": ["house of cards"], "one two three four five six": ["three four five six"], "the the data model": ["the data model"][1:] or ["data model"], "build the data model": ["data model"], "chef de cuisine, cave à vin": ["chef de cuisine", "cave à vin"], "word": [], "": [], None: [],
    "ouvrir une cave": ["ouvrir"][1:], "back-end APIs - front-end work": ["back-end APIs"],
}


def test_runs(spark):
    df = spark.createDataFrame([(t,) for t in RUNS], "t string")
    got = {r.t: [" ".join(w) for w in r.r] for r in df.select("t", P.phrase_runs(F.col("t")).alias("r")).collect()}
    assert got == RUNS


def test_what_tells(spark):
    rows = ["data scientists", "python etl", "etl rest api", "english german", "data engineer", "engineer data", "5+ years", "data models", "left out"]
    df = spark.createDataFrame([(r.split(),) for r in rows], "w array<string>")
    got = [" ".join(r.w) for r in df.select("w", P.telling(F.col("w"), F.lit("Data Engineer"), ("python", "etl"), ("left out",)).alias("ok")).where("ok").collect()]
    assert sorted(got) == ["data models", "etl rest api"]


def test_nested_phrases_and_spread(spark):
    df = spark.createDataFrame([(1, "data models. data models. design data models. big data models, data quality"), (2, "ETL data quality. iOS apps"), (3, None)], "no int, t string")
    counts = O.phrase_counts(df, "no", F.col("t"), F.lit(None).cast("string"))
    got = sorted((r.no, r["rank"], r.shown) for r in O.key_phrases(counts, "no").collect())
    assert got == [(1, 1, "Data Models"), (1, 2, "Data Quality"), (2, 1, "ETL Data Quality"), (2, 2, "iOS Apps")]
    assert {(r.phrase, r.n_rows, r.n) for r in O.phrase_spread(counts).collect()} == set() | {(r.phrase, r.n_rows, r.n) for r in O.phrase_spread(counts, 2).collect()}
    assert O.key_phrases(O.phrase_counts(df.limit(0), "no", F.col("t"), F.col("t")), "no").count() == 0


def test_tools(spark):
    cases = {
        "We use Zendesk and GitLab. Kafka is used; so is kafka": ["Zendesk", "GitLab"], "Know SQL, AWS, IT and HR": ["SQL", "AWS"], "use Salesforce, SALESFORCE": ["Salesforce"], "Monday with Acme Cooks in French": [], "at\nRedis": ["Redis"], "(Redis) or Redis": ["Redis"],
        "A.B/C and the Node.js": ["A.B/C"][1:] + ["Node.js"], "": [], None: [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.x for r in df.select("t", P.named_tools(F.col("t"), F.lit("kafka-like things, notsql"), F.lit("Cooks"), F.lit("Acme")).alias("x")).collect()}
    assert got == cases


def test_long_texts_take_linear_time(spark):
    odd = ["the " * 250_000, "data model " * 100_000, "x" * 1_000_000, "A.B/" * 250_000, "Kafka " * 150_000, ", " * 400_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "no int, t string")
    start = time.monotonic()
    df.select(F.size(P.phrase_runs(F.col("t"))), F.size(P.named_tools(F.col("t"), F.lit("cv"), F.lit("x"), F.lit("y")))).collect()
    assert time.monotonic() - start < 60


def test_only_texts_are_shuffled(spark):
    """Counting by row and phrase, and ranking by row, go on where the texts were dealt; rows that share a key are counted together."""
    df = spark.createDataFrame([(1, "data models. web data"), (1, "data models. the cloud of clouds"), (None, "data models")], "no int, t string")
    ranked = O.key_phrases(O.phrase_counts(df, "no", F.col("t"), F.lit("x")), "no")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1, plan
    got = sorted((r.no or 0, r["rank"], r.phrase) for r in ranked.collect())
    assert got == [(0, 1, "data models"), (1, 1, "data models"), (1, 2, "cloud of clouds"), (1, 3, "web data")]
