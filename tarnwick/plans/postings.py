"""Queries of the posting, mail and verdict operators over the supplied tables, with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tarnwick.functions import mail as M
from tarnwick.functions import names as N
from tarnwick.operators import entity, verdicts
from tarnwick.session import table
from tarnwick.sources import landed


def company_keys(s: SparkSession, d: str) -> DataFrame:
    """Supplier names with endings put behind them; customers' names as titles with a tail."""
    name = F.concat_ws(" ", "s_name", F.element_at(F.array(*map(F.lit, ("GmbH", "Inc.", "(EU) Holding AG", "Größe"))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    title = F.concat(F.col("s_name"), F.lit(" – Remote"))
    return table(s, d, "supplier").select("s_suppkey", N.company_key(name).alias("company"), N.title_key(title).alias("title"), N.posting_fingerprint(name, title).alias("fingerprint"))


def source_status(s: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers as sources of the same postings, and one source that is not there."""
    root = d.rstrip("/")
    schema = StructType([StructField("s_name", StringType()), StructField("c_name", StringType())])
    sources = {n: ("parquet", f"{root}/{n}.parquet") for n in ("supplier", "customer", "missing")}
    rows, failures = landed.union_sources(s, sources, schema)
    return landed.source_status(rows, list(sources), failures)


def parts_page(s: SparkSession, d: str) -> DataFrame:
    return landed.page(table(s, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 40, 20)


def post_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", "n_chars").alias("url"), "text")
    return entity.first_posts(rows, "doc_id", "url", F.col("text")).select(F.col("seq").alias("doc_id"))


def applied_exclusion(s: SparkSession, d: str) -> DataFrame:
    """Customers without a large order and without a supplier of the same nation and hundred of balance."""
    place = lambda n, b: F.concat_ws(":", F.lit("n"), F.col(n), F.floor(F.col(b) / 100))
    c = table(s, d, "customer").withColumn("keys", F.array(F.concat(F.lit("c:"), F.col("c_custkey")), place("c_nationkey", "c_acctbal")))
    seen = table(s, d, "orders").where("o_totalprice > 450000").select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("key"))
    seen = seen.unionByName(table(s, d, "supplier").select(place("s_nationkey", "s_acctbal").alias("key")))
    return entity.without_any(c, "c_custkey", "keys", seen).select("c_custkey", "c_name")


def scored_match(s: SparkSession, d: str) -> DataFrame:
    """The customer that shares most with each supplier: nation with a thousand of balance 45, a ten of balance 30."""
    near = lambda n, b: F.concat_ws(":", F.col(n), F.floor(F.col(b) / 1000))
    tens = lambda b: F.floor(F.col(b) / 10)
    keys = [(near("s_nationkey", "s_acctbal"), near("c_nationkey", "c_acctbal"), 45), (tens("s_acctbal"), tens("c_acctbal"), 30)]
    return entity.scored_links(table(s, d, "supplier"), table(s, d, "customer"), "s_suppkey", "c_custkey", keys, 30)


def application_status(s: SparkSession, d: str) -> DataFrame:
    """Events as messages on a user's application: purchase an offer, error a rejection, click an interview, signup a review."""
    e = table(s, d, "events").withColumn("intent", F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "interview").when(F.col("event_type") == "signup", "review"))
    e = e.withColumn("cur", F.when(F.col("user_id") % 2 == 0, "rejected").otherwise("applied")).withColumn("timeout", F.col("user_id") % 4 == 0)
    return entity.final_status(e, "user_id", F.struct("ts", "event_id"), "intent", "cur", "timeout")


def mail_intents(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("RE: [ext] Application for "), F.coalesce("text", F.lit("")))
    rules = [("rejected", "thand|edti"), ("interview", "tionan|ererly"), ("review", "[.]")]
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(M.subject_core(body)).alias("subject"), M.intent(F.lower(F.coalesce("text", F.lit(""))), rules, "none").alias("intent"))


def posting_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Documents as postings: a dollar sign as pay, short texts and nameless sources as doubts."""
    t, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    legit = verdicts.legitimacy([(n < 200, 1.0), (F.coalesce(F.col("source") == "src0", F.lit(True)), 0.8), (t.contains("!!"), 1.7)])
    permit = verdicts.permit_score(t, ["thand", "edtion"], ["ererly"])
    fit = verdicts.fit_score(F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 101).cast("double")), F.col("doc_id") % 7 == 0)
    v = verdicts.verdict(fit, legit, permit, verdicts.pay_score(F.lit(None).cast("string"), t), F.col("doc_id") % 11 == 0, F.lit(None).cast("boolean"), F.col("lang") == "d")
    return table(s, d, "documents").select("doc_id", v.alias("v")).groupBy("v.verdict").agg(F.count("*").alias("n"), F.bround(F.sum(F.col("v.score").cast("decimal(6,1)")).cast("double"), 1).alias("total"))


def final_ranks(s: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("p_size") < 5, "Suspicious").when(F.col("p_size") < 15, "Proceed with Caution")
    rank = verdicts.final_rank(F.col("p_size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") * 2), tier, F.col("p_partkey") % 5, F.col("p_brand") == "Brand#11", F.col("p_partkey") % 2 == 0)
    return table(s, d, "part").select("p_partkey", rank.alias("rank"))


def connector_health(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_type", "ts", "event_id", "value", (F.col("event_id") % 4).alias("rows"))
    return verdicts.source_health(e, "event_type", ["ts", "event_id"], "value", "rows")


def order_funnel(s: SparkSession, d: str) -> DataFrame:
    return verdicts.funnel(table(s, d, "orders"), [("opened", F.col("o_orderstatus") != "P"), ("filled", F.col("o_orderstatus") == "F"), ("large", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000))])


_ENDINGS = "|".join(N.COMPANY_ENDINGS)
_PERMIT = "CASE WHEN bad AND good THEN 3.0 WHEN bad THEN 2.0 WHEN good THEN 4.8 ELSE 3.6 END"

SQL = {
    "company_keys": rf"""WITH n AS (SELECT s_suppkey, s_name, s_name || ' ' || ['GmbH', 'Inc.', '(EU) Holding AG', 'Größe'][s_suppkey % 4 + 1] AS name FROM supplier),
        k AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(lower(name), 'ö', 'o'), 'ß', 'ss'), '\([^)]*\)', ' ', 'g'), '[^a-z0-9/]+', ' ', 'g')) AS words,
            regexp_replace(regexp_replace(lower(name), '\b({'|'.join(N.LEGAL_WORDS)})\b\.?', '', 'g'), '\([^)]*\)', '', 'g') AS core FROM n)
        SELECT s_suppkey, regexp_replace(regexp_replace(words, '(\s*\b({_ENDINGS}))+$', ''), '[^a-z0-9]', '', 'g') AS company, regexp_replace(lower(s_name), '[^a-z0-9+#]', '', 'g') AS title,
        regexp_replace(core, '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS fingerprint FROM k""",
    "source_status": "SELECT 'supplier' AS site, 'success' AS status, count(*) AS n FROM supplier UNION ALL SELECT 'customer', 'success', count(*) FROM customer UNION ALL SELECT 'missing', 'error', 0",
    "parts_page": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40",
    "post_dedup": """WITH r AS (SELECT doc_id, concat_ws('/', source, lang, n_chars) AS url, substring(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g'), 1, 120) AS b FROM documents),
        u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1) SELECT min(doc_id) AS doc_id FROM u GROUP BY CASE WHEN length(b) >= 40 THEN b ELSE '#' || doc_id END""",
    "applied_exclusion": """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
        AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100))""",
    "scored_match": """WITH p AS (SELECT s_suppkey, c_custkey, CASE WHEN s_nationkey = c_nationkey AND floor(s_acctbal / 1000) = floor(c_acctbal / 1000) THEN 45 ELSE 0 END
            + CASE WHEN floor(s_acctbal / 10) = floor(c_acctbal / 10) THEN 30 ELSE 0 END AS score FROM supplier, customer)
        SELECT s_suppkey, c_custkey, CAST(score AS BIGINT) AS score FROM p WHERE score >= 30 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) = 1""",
    "application_status": """WITH e AS (SELECT user_id, (ts, event_id) AS o, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'interview' WHEN 'signup' THEN 'review' END AS i FROM events),
        a AS (SELECT user_id, bool_or(coalesce(i = 'interview', false)) AS iv, bool_or(coalesce(i = 'review', false)) AS rv, max(o) FILTER (i = 'rejected') AS no, min(o) FILTER (i IN ('interview', 'review')) AS yes FROM e GROUP BY 1)
        SELECT user_id, CASE WHEN user_id % 4 = 0 THEN CASE WHEN no > yes THEN 'rejected' WHEN iv THEN 'interview' WHEN rv THEN 'review' ELSE 'rejected' END WHEN user_id % 2 = 0 THEN 'rejected'
        WHEN no IS NOT NULL THEN 'rejected' WHEN iv THEN 'interview' WHEN rv THEN 'review' ELSE 'applied' END AS status FROM a""",
    "mail_intents": r"""SELECT conv_id, turn, md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS subject, CASE WHEN regexp_matches(lower(text), 'thand|edti') THEN 'rejected'
        WHEN regexp_matches(lower(text), 'tionan|ererly') THEN 'interview' WHEN contains(text, '.') THEN 'review' ELSE 'none' END AS intent FROM conversations""",
    "posting_verdicts": rf"""WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS t, source FROM documents),
        a AS (SELECT doc_id, lang = 'd' AS gap, list_transform(regexp_extract_all(t, '(?i)(?:[$€£]|usd|eur|gbp)\s?(\d{{2,3}}(?:[,.]\d{{3}})+|\d{{2,3}}\s?k)', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')::BIGINT * CASE WHEN x ILIKE '%k' THEN 1000 ELSE 1 END) AS pay,
            CASE WHEN length(t) < 200 THEN 1.0 ELSE 0 END + CASE WHEN coalesce(source = 'src0', true) THEN 0.8 ELSE 0 END + CASE WHEN contains(t, '!!') THEN 1.7 ELSE 0 END AS risk,
            regexp_matches(t, '(?i)thand|edtion') AS bad, regexp_matches(t, '(?i)ererly') AS good,
            CASE WHEN doc_id % 5 = 0 THEN 3.0 WHEN doc_id % 7 = 0 THEN round(greatest(1, round(least(5, 1 + (doc_id % 101) / 25.0), 1) - 0.4), 1) ELSE round(least(5, 1 + (doc_id % 101) / 25.0), 1) END AS fit FROM b),
        c AS (SELECT *, list_max(list_filter(pay, lambda x: x BETWEEN 1000 AND 1000000)) AS top FROM a),
        p AS (SELECT *, CASE WHEN top > 20000 THEN top ELSE top * 12 END AS y FROM c),
        s AS (SELECT *, fit::DOUBLE * 0.45::DOUBLE + round(greatest(1, 4.6 - risk), 1)::DOUBLE * 0.25::DOUBLE + ({_PERMIT})::DOUBLE * 0.15::DOUBLE + (CASE WHEN y >= 120000 THEN 4.5 WHEN y >= 70000 THEN 4.0 WHEN y >= 35000 THEN 3.5 ELSE 3.0 END)::DOUBLE * 0.15::DOUBLE AS raw FROM p),
        f AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN least(raw, 1.5) WHEN risk >= 2.5 THEN least(raw, 2.5) ELSE raw END - CASE WHEN bad AND NOT good THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN gap THEN 0.6::DOUBLE ELSE 0 END AS g FROM s),
        r AS (SELECT risk >= 2.5 OR doc_id % 11 = 0 AS stop, round(round(least(5.0, greatest(1.0, g)), 6), 1) AS score FROM f)
        SELECT CASE WHEN stop THEN 'skip' WHEN score >= 4 THEN 'apply' WHEN score >= 3 THEN 'consider' ELSE 'skip' END AS verdict, count(*) AS n, round(sum(score::DECIMAL(6,1))::DOUBLE, 1) AS total FROM r GROUP BY 1""",
    "final_ranks": """SELECT p_partkey, round(CASE WHEN p_partkey % 3 <> 0 THEN round_even(round(0.55::DOUBLE * (p_size * 2) + 0.45::DOUBLE * p_size, 6), 1) ELSE p_size::DOUBLE END - CASE WHEN p_size < 5 THEN 15 WHEN p_size < 15 THEN 5 ELSE 0 END
        - 3 * least(p_partkey % 5, 3) + CASE WHEN p_brand = 'Brand#11' THEN 2.5::DOUBLE ELSE 0 END - CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 0 END, 1) AS rank FROM part""",
    "connector_health": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 4 > 0) AS with_rows, round_even(100.0::DOUBLE * count(*) FILTER (event_id % 4 > 0) / count(*), 1) AS hit_rate, max(value) AS max_ms,
        round(sum(value * pow(0.8, back) * CASE WHEN back = n - 1 THEN 1.0 ELSE 0.2 END), 4) AS avg_ms FROM p GROUP BY 1""",
    "order_funnel": """WITH a AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS opened, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS large FROM orders)
        SELECT *, round_even(100.0::DOUBLE * opened / total, 1) AS opened_rate, round_even(100.0::DOUBLE * filled / opened, 1) AS filled_rate, round_even(100.0::DOUBLE * large / filled, 1) AS large_rate FROM a""",
}
QUERIES = {name: globals()[name] for name in SQL}
