"""Digests: batches that run again, hot users; purges: circles of references."""

import datetime as dt
import random

from tarnwick.operators import digest as D
from tarnwick.operators import purge as P
from tarnwick.session import shared_path
from tarnwick.streaming.digest import DigestLog

SHAPE = "user long, seq long, url string, score int"


def test_a_batch_that_runs_again_changes_nothing(spark):
    log = DigestLog(spark, shared_path(spark, "log"))
    rows = [[(1, 10 * n + i, f"u{(3 * n + i) % 9}", 70 + 5 * i) for i in range(5)] + [(None, 1, "x", 99), (2, n, None, 99)] for n in range(4)]
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=(0, 5, 30, 60)[n])
    seen = []
    for n, part in enumerate(rows):
        for _ in range(2):  # as after a failure between the batch and its commit
            log.take(spark.createDataFrame(part, SHAPE), n, at(n))
        seen.append(sorted(tuple(r) for r in log.sent().where(f"batch = {n}").collect()))
    assert [len(x) for x in seen] == [3, 0, 5, 5] or [len(x) for x in seen][1] == 0
    fresh = [r.url for r in log.sent().where("fresh").collect()]
    assert len(fresh) == len(set(fresh))


def test_hot_user_against_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, rng.randrange(20)]), i, f"u{rng.randrange(150)}", rng.choice([None, *range(60, 100)])) for i in range(2000)]
    sent = [(7, f"u{i}", i) for i in range(120)] + [(3, "u1", 1)]
    got = D.digests(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(sent, "user long, url string, at long"))
    want = set()
    for user in {r[0] for r in rows}:
        first = {}
        for u, seq, url, score in rows:
            if u == user and url not in first:
                first[url] = (seq, score or 0)
        known = {url for u, url, _ in sent if u == user}
        fresh = [(url, s, x, True) for url, (s, x) in first.items() if url not in known]
        pool = fresh if len(fresh) >= 3 else fresh + [(url, s, x, False) for url, (s, x) in first.items() if url in known]
        good = [p for p in pool if p[2] >= 80]
        pool = sorted(good if len(good) >= 3 else pool, key=lambda p: (-p[2], not p[3], p[1]))[:5]
        want |= {(user, k + 1, p[0], p[2], p[3]) for k, p in enumerate(pool)}
    assert {tuple(r) for r in got.collect()} == want
    assert D.digests(spark.createDataFrame([], SHAPE), spark.createDataFrame(sent, "user long, url string, at long")).count() == 0


def test_cascade_in_circles(spark):
    people = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4), (6, 99)], "id int, boss int")
    pets = spark.createDataFrame([(10, 2), (11, 5), (12, None)], "id int, owner int")
    tables, links = {"people": (people, "id"), "pets": (pets, "id")}, [("people", "boss", "people"), ("pets", "owner", "people")]
    own = lambda keys: {k: sorted(r.key for r in v.collect()) for k, v in P.cascade(tables, links, {"people": spark.createDataFrame([(k,) for k in keys], "k int")}).items()}
    assert own([1]) == {"people": [1, 2, 3], "pets": [10]}
    assert own([4, None]) == {"people": [4, 5], "pets": [11]}
    assert own([77]) == {"people": [77]}
    assert own([]) == {"people": []}


def test_whom_a_blocked_address_concerns(spark):
    apps = spark.createDataFrame([(1, 1, "mail AA@b.example", None), (2, 2, "aa@b.example", None), (3, 2, None, "https://x.example/?to=cc@d.example"), (4, 3, "ee@f.example.", None), (5, 3, None, None)], "app int, user int, notes string, url string")
    logs = spark.createDataFrame([(5, 3, " CC@d.example "), (None, 3, "cc@d.example"), (9, 3, "cc@d.example")], "app int, user int, to_email string")
    black = spark.createDataFrame([("aa@b.example", 1, "manual"), ("cc@d.example", 9, "bounce"), ("ee@f.example", None, None), (None, None, "manual"), (" ", 1, "manual")], "email string, user int, source string")
    assert sorted(tuple(r) for r in P.dead_applications(apps, logs, black).collect()) == [(1, 1, False, True, False), (3, 2, False, False, True), (4, 3, False, True, False), (5, 3, True, False, False)]
