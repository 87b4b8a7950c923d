"""Replies: single rules, batch against stream, late rows and replays."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tarnwick.operators import inbox as I
from tarnwick.session import shared_path
from tarnwick.streaming import events as streams
from tarnwick.streaming import inbox as live

CASES = [
    ("We are pleased to offer you the job.", "", "offer"), ("We are pleased to offer you a call should you be selected.", "", None), ("Unfortunately, we chose others. Let's schedule a call.", "", "rejected"), ("Let's schedule a call", "", "interview"),
    ("hello", "Automatic reply: x", "auto_reply"), ("earn money", "", "ignore"), ("earn money, thank you for applying", "", "review"), ("hi", "Interview tomorrow", "interview"), ("hi", "Thank you - interview later", None),
    ("ok\nOn Mon, Jan 1 Ann wrote:\n> leider", "", None), ("> leider\nfine", "", None), ("join https://meet.google.com/abc-defg-hij.", "", "interview"), ("x", "Application received", "review"), ("apply via our page", None, "review"), (None, None, None), ("", "", None),
    ("On top of it all, leider", "", "rejected"), ("Leider    nicht", "", "rejected"), ("leider " * 150_000, "", "rejected"), ("On \n" * 100_000, "", None),
]


def test_what_a_reply_says(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "no int, body string, subject string, want string")
    got = I.classified(df).select("no", "want", "intent").collect()
    assert [(r.no, r.intent) for r in got if r.intent != r.want] == []


def _rows(seed):
    """Replies of a few applications, some a minute apart, some alike, in random order; copies share the id."""
    rng, rows = random.Random(seed), []
    for app in range(12):
        at = dt.datetime(2024, 1, 1)
        for n in range(rng.randrange(1, 25)):
            at += dt.timedelta(seconds=rng.choice([30, 119, 120, 4000, 90_000]))
            rows.append((app if app else None, f"{app}-{n}", at, rng.choice("ab"), rng.choice(["s", None]), rng.choice(["x", "y", "z " * 200]), rng.choice([*I.KEPT, "ignore", None]), ["applied", "rejected", "offer", None][app % 4], app % 3 == 0))
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    return rows


SHAPE = "app int, seq string, ts timestamp, sender string, subject string, own string, intent string, cur string, soft boolean"


def _streamed(spark, parts, late):
    path = shared_path(spark, "replies")
    for part in parts:
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path)
    return live.latest(streams.drained(live.inbox(stream, "app", "ts", "seq", "sender", "subject", "cur", "soft", late), "update"), "app")


def test_stream_equals_batch_in_any_order(spark):
    rows = _rows(1)
    batch = I.synced(spark.createDataFrame(rows, SHAPE), "app", "ts", "seq", "sender", "subject", "cur", "soft")
    got = _streamed(spark, [rows[i::3] for i in range(3)], "1000 days")
    names = ["app", "status", "n_fresh", "n_copies", "n_away"]
    key = lambda r: str(r[0])
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted((tuple(r) for r in batch.select(*names).collect()), key=key)
    assert got.agg(F.sum("n_late")).first()[0] == 0


def test_late_replies_are_left_to_the_recomputation(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    first = [(1, "a", day(1), "x", "s", "one", "review", "applied", False), (1, "b", day(20), "x", "s", "two", "rejected", "applied", False), (1, "b", day(20), "x", "s", "two", "rejected", "applied", False)]
    more = [(1, "c", day(2), "x", "s", "three", "offer", "applied", False), (1, "d", day(21), "x", "s", "four", "auto_reply", "applied", False)]
    # the watermark moves between batches, so that the second one already finds it behind the first one's last time
    got = _streamed(spark, [first, [first[1]], more], "2 days").collect()
    assert [(r.app, r.status, r.n_fresh, r.n_copies, r.n_away, r.n_late) for r in got] == [(1, "rejected", 2, 0, 1, 1)]
    everything = spark.createDataFrame([*first, *more], SHAPE)
    assert [tuple(r)[:3] for r in I.synced(everything, "app", "ts", "seq", "sender", "subject", "cur", "soft").collect()] == [(1, "offer", 3)]


def test_corrections(spark):
    rows = [(1, 1, "review", "rejected", "review"), (2, 1, "review", "rejected", "interview"), (3, 1, "offer", "rejected", "offer"), (4, 1, "review", "review", "review"), (5, 1, "review", None, "review"), (6, 1, "rejected", "review", "x"), (6, 2, "review", "interview", "review"), (7, 1, None, "review", None)]
    df = spark.createDataFrame(rows, "app int, seq int, was string, intent string, cur string").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.app: (r.status, r.fixed) for r in I.reconciled(df, "app", "ts", "seq", "was", "intent", "cur").collect()}
    assert got == {1: ("rejected", True), 2: ("interview", False), 3: ("offer", False), 4: ("review", False), 6: ("interview", True), 7: (None, False)}


def test_a_part_tells_each_application_from_one_file(spark, tmp_path, monkeypatch):
    from tarnwick.plans import inbox as plans

    kept = plans.shared_path
    monkeypatch.setattr(plans, "shared_path", lambda s, name: f"{tmp_path}/{name}" if name == "inbox" else kept(s, name))
    many = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(8).write.parquet(f"{many}/conversations.parquet")
    plans.inbox_stream(spark, str(many))
    files = spark.read.parquet(f"{tmp_path}/inbox").select("part", "app", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("part", "app").count().where("count > 1").isEmpty()
