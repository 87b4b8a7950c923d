"""Structured data of landed pages: nested, malformed and hostile ones; dates of many languages."""

import datetime as dt
import json
import time
from pathlib import Path

from pyspark.sql import functions as F

from tarnwick.functions.dates import posted_date
from tarnwick.sources import structured as S

FIXTURES = str(Path(__file__).parent / "fixtures" / "pages")
TODAY = dt.date(2026, 1, 15)
DATES = {
    "2026-01-03T10:00:00Z": dt.date(2026, 1, 3), "1767225600": dt.date(2026, 1, 1), "1767225600000": dt.date(2026, 1, 1), "3.2.2025": dt.date(2025, 2, 3), "31-12-2024": dt.date(2024, 12, 31), "31.2.2025": None, "2025-13-01": None, "Heute": TODAY, "ieri": dt.date(2026, 1, 14),
    "3 days ago": dt.date(2026, 1, 12), "il y a 2 jours": dt.date(2026, 1, 13), "vor 5 Tagen": dt.date(2026, 1, 10), "hace 3 días": dt.date(2026, 1, 12), "acum 2 zile": dt.date(2026, 1, 13), "před 3 dny": dt.date(2026, 1, 12), "2 gün önce": dt.date(2026, 1, 13),
    "30+ days": dt.date(2025, 12, 16), "5 Stunden": TODAY, "2 weeks": dt.date(2026, 1, 1), "1 month ago": dt.date(2025, 12, 16), "2 Jahre": dt.date(2024, 1, 16), "soon": None, "": None, None: None, "7": None, "99999999999 days": None,
}


def test_posted_dates(spark):
    df = spark.createDataFrame(list(DATES.items()), "raw string, want date")
    got = df.select("raw", "want", posted_date(F.col("raw"), F.lit(TODAY)).alias("got")).collect()
    assert [(r.raw, r.got) for r in got if r.got != r.want] == []


def test_landed_pages(spark):
    pages = S.read_pages(spark, FIXTURES)
    assert pages.count() == 2  # an empty file is no page
    rows = S.posting_rows(S.linked_nodes(pages, "path"), "path", "Peru", F.lit(TODAY)).collect()
    assert sorted((r.title, r.url, r.place, r.remote) for r in rows) == [
        ("Below a posting", "https://x.example/3", "Remote, Peru", True), ("Inner", "https://x.example/1", "Peru", False), ("Listed é", "https://x.example/2", "Peru", False), ("sound", "https://x.example/4", "Peru", False),
    ]


def test_depth_and_hostile_pages(spark):
    """A node forty levels down is found; unclosed scripts, broken and huge ones give nothing and take linear time; empty tables give empty results."""
    node = {"@type": "JobPosting", "title": "deep", "url": "u"}
    for n in range(20):
        node = {"item": [node]} if n % 2 else {"mainEntity": node}
    odd = ["<script type=application/ld+json>" + x + "</script>" for x in (json.dumps(node), "{" * 500_000, '{"a":' * 900, "[1,", "", "null", '"text"', "[" + "1," * 200_000 + "2]")]
    odd += ["<script" * 150_000, "<script type=application/ld+json>" * 30_000, None, "</script>" * 100_000, "<script id=\"__NEXT_DATA__\">{}</script>"]
    df = spark.createDataFrame(list(enumerate(odd)), "no int, html string")
    start = time.monotonic()
    assert [(r.no, r.place.count("/")) for r in S.linked_nodes(df, "no").select("no", "place").collect()] == [(0, 30)]
    states = df.select("no", S.next_data(F.col("html")).isNotNull().alias("a"), S.json_after(F.col("html"), "ld+json>").isNotNull().alias("b")).collect()
    assert [r.no for r in states if r.a] == [12] and {r.no for r in states if r.b} == {0, 5, 6, 7}
    assert time.monotonic() - start < 60
    assert S.linked_nodes(df.limit(0), "no").count() == 0
