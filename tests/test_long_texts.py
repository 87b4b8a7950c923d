"""Text functions on hostile texts of a megabyte: each must end in linear time."""

import time

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import mail, profile, text, urls
from tarnwick.functions.lexicon import SHORT

ODD = ["<" * 1_000_000, "<script>" * 120_000, "<script" * 140_000, "</script>" * 110_000, "<style>a</style>" * 60_000, "&" * 1_000_000, "&amp;" * 200_000, "a\n" * 500_000, "skills\nx\n" * 110_000, "must have " * 100_000, "required. " * 100_000, "a" * 1_000_000, " " * 1_000_000, "> " * 400_000, "a@b.cc " * 140_000]
FUNCTIONS = {
    "plain_html": text.plain_html, "cleaned": text.cleaned, "csv_safe": text.csv_safe, "required": lambda c: F.size(profile.required_terms(c, SHORT, SHORT.tech[:5])), "sections": lambda c: F.concat(*profile.section_texts(c, SHORT).values()),
    "years": profile.years, "emails": lambda c: F.size(urls.emails(c)), "own_text": mail.own_text, "unconditional": mail.unconditional, "meeting": mail.meeting_link,
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_long(spark, name):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").repartition(4)
    start = time.monotonic()
    df.select(FUNCTIONS[name](F.col("t")).alias("x")).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - start < 60


def test_tags_and_scripts(spark):
    cases = {
        "a<script>x</script>b<style>y</style>c": "a b c", "a<script>b": "a b", "a</script>b": "a b", "a<b": "a<b", "a<b>c<d": "a c<d", "<p>1 &lt; 2</p><p>3": "1 3", "<SCRIPT type=x>no</Script>yes": "yes", "<script>a<script>b</script>c</script>d": "c d", "": "", "a > b < c": "a > b < c",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.x for r in df.select("t", text.plain_html(F.col("t")).alias("x")).collect()} == cases
