"""Report queries over the supplied tables, with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.functions.dates import age_hours, age_label, freshness, salary
from tarnwick.operators.entity import covered_days, first_by, nearest, sightings
from tarnwick.operators.reports import calendar, due, pipeline_stats as stats, rate, running_count, skill_gap as gaps, status_counts
from tarnwick.session import table


def pipeline_counts(s: SparkSession, d: str) -> DataFrame:
    return status_counts(table(s, d, "orders"), "o_orderstatus", {"P": "O"}, "O")


def pipeline_stats(s: SparkSession, d: str) -> DataFrame:
    return stats(table(s, d, "orders"), "o_orderstatus", "P", ["F"])


def kpi_overview(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.bround(F.avg("value"), 4).alias("avg_value"), F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).alias("last_week"))
    c = table(s, d, "customer").agg(F.count("*").alias("n_customers"), F.countDistinct("c_mktsegment").alias("n_segments"))
    o = table(s, d, "orders").agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_buyers"))
    return e.crossJoin(c).crossJoin(o)  # one row each


def calendar_daily(s: SparkSession, d: str) -> DataFrame:
    days = calendar(table(s, d, "events"), "ts", "event_type", ["signup", "purchase", "error"])
    return days.withColumn("ok_rate", F.coalesce(rate(F.col("total") - F.col("error"), F.col("total"), 1), F.lit(100.0)))


def user_crm(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    agg = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    out = table(s, d, "customer").select("c_custkey", "c_name").join(agg, "c_custkey", "left")
    return out.select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.col("f.o_orderkey").alias("first_order"))


def recent_feed_topk(s: SparkSession, d: str) -> DataFrame:
    top = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(8)
    return top.join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")


def admin_search(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where(F.col("p_name").ilike("%red%") | F.col("p_brand").ilike("%brand#1%")).select("p_partkey", "p_name", "p_brand")


def semi_join_activity(s: SparkSession, d: str) -> DataFrame:
    big = table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


def anti_join_seen(s: SparkSession, d: str) -> DataFrame:
    seen = table(s, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


def first_per_group(s: SparkSession, d: str) -> DataFrame:
    return first_by(table(s, d, "events").select("user_id", "event_id", "ts"), [F.col("user_id")], [F.col("ts"), F.col("event_id")])


def last_per_group(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"))


def follow_up_due(s: SparkSession, d: str) -> DataFrame:
    return due(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderstatus", "O", "P", "F", "2001-01-01", 5, 8)


def quota_counter(s: SparkSession, d: str) -> DataFrame:
    return running_count(table(s, d, "events"), "user_id", "ts", "event_id", 3)


def company_mass_posting(s: SparkSession, d: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("p_brand"))
    return table(s, d, "part").select("p_partkey", "p_brand", n.alias("n_same"))


def corpus_union_dedup(s: SparkSession, d: str) -> DataFrame:
    nations = lambda t, k, p: table(s, d, t).select(F.col(k).alias("key"), F.lit(p).alias("priority"))
    rows = nations("supplier", "s_nationkey", 0).unionByName(nations("customer", "c_nationkey", 1)).unionByName(nations("nation", "n_nationkey", 2))
    return rows.groupBy("key").agg(F.min("priority").alias("priority"), F.count("*").alias("n"))


def json_props(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(s, d, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def age_buckets(s: SparkSession, d: str) -> DataFrame:
    hours = age_hours(F.col("o_orderdate").cast("date"), F.lit("2001-01-01").cast("date"))
    return table(s, d, "orders").select(age_label(hours).alias("label"), freshness(hours).alias("points")).groupBy("label", "points").agg(F.count("*").alias("n"))


def experience_union(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return covered_days(table(s, d, "orders"), "o_custkey", day, F.date_add(day, 30))


def sightings_history(s: SparkSession, d: str) -> DataFrame:
    return sightings(table(s, d, "events"), ["user_id", "event_type"], "ts")


def dup_within_interval(s: SparkSession, d: str) -> DataFrame:
    """A neighbour within six hours, by the row before in time: no pairs are made."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w))
    return table(s, d, "events").select("event_id", "user_id", (gap / 1000000).alias("gap_s")).where("gap_s <= 21600")


def status_fold(s: SparkSession, d: str) -> DataFrame:
    """The state after a user's events in order: an error never undoes a purchase, all else follows the last event."""
    rows = table(s, d, "events").where("event_type in ('signup', 'purchase', 'error')")
    last_buy = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("bought")
    last_other = F.max(F.when(F.col("event_type") != "error", F.struct("ts", "event_id", "event_type"))).alias("kept")
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    agg = rows.groupBy("user_id").agg(last_buy, last_other, last)
    return agg.select("user_id", F.when(F.col("kept.event_type") == "purchase", "purchase").otherwise(F.col("last.event_type")).alias("state"))


def skill_gap(s: SparkSession, d: str) -> DataFrame:
    return gaps(table(s, d, "part"), F.split("p_name", " "), F.col("p_size").cast("double") * 2, F.col("p_brand"))


def salary_extract(s: SparkSession, d: str) -> DataFrame:
    """Ranges written in several ways: with and without thousands, k on one side, decimals, long dashes, ends on both sides of a limit."""
    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.concat(
        F.lit("pay $"), size.cast("string"), F.when(size % 2 == 0, ",000").when(key % 5 == 0, ".50").otherwise(""), F.when(key % 7 == 0, "K").otherwise(""),
        F.when(key % 3 == 0, " – $").when(key % 4 == 0, "—").otherwise(" - $"), (size + 10).cast("string"), F.when(size % 3 == 0, "k").when(key % 11 == 0, "").otherwise(",000"),
    )
    x = salary(text)
    return table(s, d, "part").select("p_partkey", x["interval"].alias("interval"), x["least"].alias("least"), x["most"].alias("most"), x["annual"].alias("annual"))


def fuzzy_match(s: SparkSession, d: str) -> DataFrame:
    """Best customer for each supplier: same nation, then the nearest balance within 1,000; ties to the smaller key."""
    c = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("value"))
    b = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value"))
    return nearest(b, c, "s_suppkey", "c_custkey", 1000).select("s_suppkey", "c_custkey", "gap")


SQL = {
    "pipeline_counts": "SELECT CASE WHEN o_orderstatus IS NULL OR o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1",
    "pipeline_stats": """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS saved, count(*) FILTER (o_orderstatus = 'F') AS answered,
        count(*) - count(*) FILTER (o_orderstatus = 'P') AS submitted,
        round_even(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / (count(*) - count(*) FILTER (o_orderstatus = 'P')), 1) AS response_rate FROM orders""",
    "kpi_overview": """SELECT * FROM (SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users, round_even(avg(value), 4) AS avg_value, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS last_week FROM events),
        (SELECT count(*) AS n_customers, count(DISTINCT c_mktsegment) AS n_segments FROM customer), (SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_buyers FROM orders)""",
    "calendar_daily": """SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase,
        count(*) FILTER (event_type = 'error') AS error, round_even(100.0::DOUBLE * (count(*) - count(*) FILTER (event_type = 'error')) / count(*), 1) AS ok_rate FROM events GROUP BY 1""",
    "user_crm": "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n_orders, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "recent_feed_topk": "SELECT o_custkey, o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 8",
    "admin_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%brand#1%'",
    "semi_join_activity": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_join_seen": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "first_per_group": "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "last_per_group": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "follow_up_due": """SELECT o_custkey, CAST(DATE '2001-01-01' - min(o_orderdate) FILTER (o_orderstatus = 'O')::DATE AS INTEGER) AS waiting FROM orders GROUP BY o_custkey
        HAVING count(*) FILTER (o_orderstatus = 'O') > 0 AND count(*) FILTER (o_orderstatus = 'P') = 0 AND count(*) FILTER (o_orderstatus = 'F') < 8 AND waiting >= 5""",
    "quota_counter": "SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS nth, row_number() OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)",
    "company_mass_posting": "SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n_same FROM part",
    "corpus_union_dedup": """SELECT key, CAST(min(priority) AS INTEGER) AS priority, count(*) AS n FROM (SELECT s_nationkey AS key, 0 AS priority FROM supplier
        UNION ALL SELECT c_nationkey, 1 FROM customer UNION ALL SELECT n_nationkey, 2 FROM nation) GROUP BY key""",
    "json_props": "SELECT CAST(props->>'$.k' AS BIGINT) % 10 AS k, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
    "age_buckets": """WITH a AS (SELECT CASE WHEN DATE '2001-01-01' - o_orderdate::DATE <= 0 THEN 4.0 ELSE (DATE '2001-01-01' - o_orderdate::DATE) * 24.0 END::DOUBLE AS h FROM orders)
        SELECT CASE WHEN h < 1 THEN 'Just now' WHEN h < 24 THEN floor(h)::BIGINT || 'h ago' WHEN h < 168 THEN floor(h / 24)::BIGINT || 'd ago' WHEN h < 840 THEN floor(h / 168)::BIGINT || 'w ago'
        WHEN h < 8760 THEN floor(h / 720)::BIGINT || 'mo ago' ELSE floor(h / 8760)::BIGINT || 'y ago' END AS label,
        CASE WHEN h <= 24 THEN 20 WHEN h <= 72 THEN 16 WHEN h <= 168 THEN 12 WHEN h <= 720 THEN 6 ELSE 2 END AS points, count(*) AS n FROM a GROUP BY 1, 2""",
    "experience_union": """WITH r AS (SELECT o_custkey, o_orderdate::DATE AS s, o_orderdate::DATE + 30 AS e FROM orders),
        m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
        i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY s, e) AS island FROM m), g AS (SELECT o_custkey, island, max(e) - min(s) AS d FROM i GROUP BY 1, 2)
        SELECT o_custkey, count(*) AS n_islands, CAST(sum(d) AS BIGINT) AS days FROM g GROUP BY 1""",
    "sightings_history": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS again FROM events)
        SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT ts::DATE) AS n_days, CAST(sum(again) AS BIGINT) AS times_seen FROM m GROUP BY 1, 2""",
    "dup_within_interval": """WITH g AS (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 1000000 AS gap_s FROM events)
        SELECT event_id, user_id, gap_s FROM g WHERE gap_s <= 21600""",
    "status_fold": """WITH e AS (SELECT * FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
        SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') = 'purchase' THEN 'purchase' ELSE arg_max(event_type, (ts, event_id)) END AS state FROM e GROUP BY user_id""",
    "skill_gap": """WITH r AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS skill, greatest(0.15, least(1.0, (100 - p_size * 2.0) / 100))::DECIMAL(10,4) AS w, p_brand FROM part)
        SELECT skill, round(sum(w)::DOUBLE, 2) AS weight, count(*) AS n, count(DISTINCT p_brand) AS n_owners FROM r GROUP BY skill ORDER BY weight DESC, n DESC, skill LIMIT 14""",
    "salary_extract": r"""WITH t AS (SELECT p_partkey, 'pay $' || p_size || CASE WHEN p_size % 2 = 0 THEN ',000' WHEN p_partkey % 5 = 0 THEN '.50' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'K' ELSE '' END
            || CASE WHEN p_partkey % 3 = 0 THEN ' – $' WHEN p_partkey % 4 = 0 THEN '—' ELSE ' - $' END || (p_size + 10) || CASE WHEN p_size % 3 = 0 THEN 'k' WHEN p_partkey % 11 = 0 THEN '' ELSE ',000' END AS text FROM part),
        m AS (SELECT p_partkey, regexp_extract(text, '\$(\d+(?:,\d+)?(?:\.\d+)?)([kK]?)\s*[-—–]\s*(?:\$)?(\d+(?:,\d+)?(?:\.\d+)?)([kK]?)', ['a', 'ka', 'b', 'kb']) AS x FROM t),
        v AS (SELECT p_partkey, floor(replace(x.a, ',', '')::DOUBLE) * f AS a, floor(replace(x.b, ',', '')::DOUBLE) * f AS b
            FROM (SELECT *, CASE WHEN lower(x.ka) = 'k' OR lower(x.kb) = 'k' THEN 1000.0::DOUBLE ELSE 1.0 END AS f FROM m)),
        y AS (SELECT *, CASE WHEN a < 350 THEN 'hourly' WHEN a < 30000 THEN 'monthly' ELSE 'yearly' END AS kind, a * CASE WHEN a < 350 THEN 2080 WHEN a < 30000 THEN 12 ELSE 1 END AS ya,
            CASE WHEN a < 350 THEN CASE WHEN b < 350 THEN b * 2080 END WHEN a < 30000 THEN CASE WHEN b < 30000 THEN b * 12 END ELSE b END AS yb FROM v),
        z AS (SELECT *, coalesce(yb > 0 AND ya BETWEEN 1000 AND 700000 AND yb BETWEEN 1000 AND 700000 AND ya < yb, false) AS ok FROM y)
        SELECT p_partkey, CASE WHEN ok THEN kind END AS interval, CASE WHEN ok THEN a END AS least, CASE WHEN ok THEN b END AS most, CASE WHEN ok THEN ya END AS annual FROM z""",
    "fuzzy_match": """SELECT s_suppkey, arg_min(c_custkey, (gap, c_custkey)) AS c_custkey, min(gap) AS gap FROM (SELECT s_suppkey, c_custkey, round(abs(s_acctbal - c_acctbal), 2) AS gap
        FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE gap <= 1000 GROUP BY s_suppkey""",
}
QUERIES = {name: globals()[name] for name in SQL}
