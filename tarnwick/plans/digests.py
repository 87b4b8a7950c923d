"""Events as candidates of daily digests, read as a stream in parts, with SQL written from the rules."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.digest import Rules
from tarnwick.session import shared_path, table
from tarnwick.streaming.digest import DigestLog

#: Hours after the first part at which the others are read: the second comes before users of the first are due again.
HOURS = (0, 10, 24, 48)
RULES, BEGIN = Rules(remembered=8), datetime(2024, 3, 1)
_SCORE = "55 + (event_id * 37 + user_id * 11) % 45"


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(
        F.col("user_id").cast("long").alias("user"), F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("https://jobs.example/"), (F.col("event_id") * 7 % 40).cast("string")).alias("url"), F.expr(_SCORE).cast("int").alias("score"),
        (F.col("event_id") % 11 % len(HOURS)).alias("part"),
    ).where("seq % 5 > 0")


def daily_digests(s: SparkSession, d: str) -> DataFrame:
    """Each part lands after the one before was read and the stream stopped, so that every part is read by a restart; the last restart finds nothing new."""
    folder, rows = shared_path(s, "digests"), _candidates(s, d)
    log = DigestLog(s, f"{folder}/log", RULES)
    for n in range(len(HOURS) + 1):
        if n < len(HOURS):
            rows.where(F.col("part") == n).drop("part").write.parquet(f"{folder}/in/part={n}")
        log.drain(s.readStream.schema(rows.drop("part").schema).parquet(f"{folder}/in/part=*"), lambda no: BEGIN + timedelta(hours=HOURS[no]))
    return log.sent()


def _batches() -> str:
    ctes = [f"""c AS (SELECT user_id AS u, event_id AS seq, 'https://jobs.example/' || (event_id * 7 % 40) AS url, {_SCORE} AS score, event_id % 11 % {len(HOURS)} AS part FROM events WHERE event_id % 5 > 0),
        seen_0 AS (SELECT u, url, seq AS pos FROM c WHERE false), last_0 AS (SELECT u, seq AS h FROM c WHERE false), wait_0 AS (SELECT * FROM c WHERE false)"""]
    for n, hour in enumerate(HOURS, 1):
        ctes.append(f"""pool_{n} AS (SELECT p.*, coalesce(l.h > {hour} - {RULES.spacing_h}, false) AS early FROM (SELECT * FROM wait_{n - 1} UNION ALL SELECT * FROM c WHERE part = {n - 1}) p LEFT JOIN last_{n - 1} l USING (u)),
        own_{n} AS (SELECT p.u, p.url, min(p.seq) AS seq, arg_min(p.score, p.seq) AS score, count(s.url) = 0 AS fresh FROM pool_{n} p LEFT JOIN seen_{n - 1} s USING (u, url) WHERE NOT early GROUP BY p.u, p.url),
        k_{n} AS (SELECT *, count(*) FILTER (fresh) OVER w >= {RULES.enough_fresh} AS alone, count(*) FILTER (fresh AND score >= {RULES.good}) OVER w AS fg, count(*) FILTER (score >= {RULES.good}) OVER w AS ag FROM own_{n} WINDOW w AS (PARTITION BY u)),
        d_{n} AS (SELECT u, url, score, fresh, row_number() OVER (PARTITION BY u ORDER BY score DESC, fresh DESC, seq) AS rank FROM k_{n} WHERE (NOT alone OR fresh) AND (CASE WHEN alone THEN fg ELSE ag END < {RULES.enough_good} OR score >= {RULES.good})
            QUALIFY rank <= {RULES.size}),
        seen_{n} AS (SELECT * FROM (SELECT * FROM seen_{n - 1} UNION ALL SELECT u, url, {n} * 1000 + rank FROM d_{n} WHERE fresh) QUALIFY row_number() OVER (PARTITION BY u ORDER BY pos DESC) <= {RULES.remembered}),
        last_{n} AS (SELECT u, max(h) AS h FROM (SELECT * FROM last_{n - 1} UNION ALL SELECT DISTINCT u, {hour} FROM d_{n}) GROUP BY u), wait_{n} AS (SELECT u, seq, url, score, part FROM pool_{n} WHERE early)""")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(f"SELECT u AS user, CAST(rank AS INTEGER) AS rank, url, CAST(score AS INTEGER) AS score, fresh, {n - 1} AS batch FROM d_{n}" for n in range(1, len(HOURS) + 1))


SQL = {"daily_digests": _batches()}
QUERIES = {name: globals()[name] for name in SQL}
