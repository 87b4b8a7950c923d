"""Facets against brute force, and ages by what labels say."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tarnwick.functions import facets as A
from tarnwick.operators import facets as O

#: Label: ages that it passes.
LABELS = {
    "2 hours ago": "3h 6h 24h week month", "1h": "1h 3h 6h 24h week month", "25 hrs ago": "week month", "just now": "1h 3h 6h 24h week month", "12 min ago": "1h 3h 6h 24h week month", "yesterday": "24h week month", "Hier": "24h week month", "1 day ago": "24h week month",
    "7 jours": "week month", "8d": "month", "31 days ago": "", "a week ago": "week month", "2w": "month", "5 weeks": "", "un mois": "month", "1mo ago": "month", "2 months": "", "2 years ago": "", "a year": "", "un an": "", "Recently": "", "N/A": "", "": "", "soon": "",
    "2026-01-15": "24h week month", "2026-01-14T00:30:00": "24h week month", "2026-01-14 23:55:00": "24h week month", "2026-01-15 11:30:00": "1h 3h 6h 24h week month", "2026-01-10": "week month", "2025-12-01": "", "2026-13-45": "",
}


def test_ages_by_label(spark):
    df = spark.createDataFrame([(x,) for x in LABELS] + [(None,)], "label string")
    now, none = F.lit("2026-01-15 12:00:00").cast("timestamp"), F.lit(None)
    rows = df.select("label", *[A.of_age(none.cast("boolean"), none.cast("double"), none.cast("boolean"), F.col("label"), w, now).alias(w) for w in A.AGES]).collect()
    assert {r.label: " ".join(w for w in A.AGES if r[w]) for r in rows if r.label is not None} == LABELS
    assert not any(r[w] for r in rows if r.label is None for w in A.AGES)


def test_ages_by_hours_and_marks(spark):
    df = spark.createDataFrame([(True, 0.5, None), (None, 0.5, None), (False, 24.0, None), (None, None, True), (None, 800.0, True), (None, 2161.0, None), (None, None, None)], "closed boolean, hours double, new boolean")
    own = lambda w: A.of_age(F.col("closed"), F.col("hours"), F.col("new"), F.lit(None).cast("string"), w, F.lit("2026-01-15").cast("timestamp"))
    rows = df.coalesce(1).select(own("1h").alias("a"), own("24h").alias("b"), own("month").alias("c"), own(None).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(False, False, False, False), (True, True, True, True), (False, True, True, True), (False, True, False, True), (False, False, False, True), (False, False, False, False), (False, False, False, True)]


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    some = lambda values: None if rng.random() < 0.1 else rng.choices(values, k=rng.randrange(4))
    rows = [(i, some("abc"), some("xyz"), some("12")) for i in range(400)] + [(1000 + i, ["a"], ["x"], ["1"]) for i in range(300)]
    df = spark.createDataFrame(rows, "no int, p array<string>, q array<string>, r array<string>").withColumns({"failed_": F.lit("x"), "value": F.lit("x"), "facet": F.lit("x")})
    values = {"p": F.col("p"), "q": F.col("q"), "r": F.col("r")}
    for chosen in ({}, {"p": ["a"]}, {"p": ["a", "b"], "q": ["x"], "r": []}, {"p": ["c"], "q": ["y", "z"], "r": ["2"]}, {"p": ["nothing"]}):
        want, kept = Counter(), []
        for no, *own in rows:
            row = dict(zip("pqr", own, strict=True))
            failed = {f for f, w in chosen.items() if w and not set(row[f] or []) & set(w)}
            for f in "pqr":
                want.update((f, v) for v in set(row[f] or []) if not failed - {f})
            kept += [no] if not failed else []
        assert {(r.facet, r.value): r.n for r in O.facet_counts(df, values, chosen).collect()} == dict(want)
        assert sorted(r.no for r in O.faceted(df, values, chosen, F.lit(None).cast("int"), F.lit(None).cast("double"), "no").collect()) == sorted(kept)
    assert O.facet_counts(df.limit(0), values, {"p": ["a"]}).count() == 0
