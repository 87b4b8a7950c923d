"""Text, matching, dedup and search queries over the supplied tables, with the SQL that an oracle runs."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import urls as U
from tarnwick.functions.text import STOPWORDS
from tarnwick.operators import entity, scoring
from tarnwick.session import table
from tarnwick.streaming import events as streams

QUERY = ("the", "that", "edtion", "thand", "ereren", "tionan")


def _key(most: int | None = None) -> Column:
    """The whole cleaned text; its first `most` characters only where a rule says so."""
    text = T.cleaned(F.col("text"))
    return F.md5(text if most is None else F.substring(text, 1, most))


def clean_tokens(s: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


def stem_tokens(s: SparkSession, d: str) -> DataFrame:
    t = F.transform(T.tokens(F.col("text")), T.singular)
    return table(s, d, "benchmark").select("item_id", F.array_join(t, " ").alias("stems"))


def canonical_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"), U.root_domain(U.host(F.col("url"))).alias("domain"))


def url_domain_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").groupBy(U.root_domain(U.host(F.col("url"))).alias("domain")).agg(F.count("*").alias("n"), F.countDistinct(U.canonical_url(F.col("url"))).alias("n_urls"))


def html_to_text(s: SparkSession, d: str) -> DataFrame:
    t = T.plain_html(F.col("html"))
    return table(s, d, "pages").select("page_id", F.char_length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


def email_extract(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.explode(U.emails(F.col("text"))).alias("email"))
    return rows.withColumn("domain", U.root_domain(F.substring_index("email", "@", -1))).withColumn("tier", U.email_tier(F.col("email")))


def ngram_tf(s: SparkSession, d: str) -> DataFrame:
    w = scoring.ngram_weights(table(s, d, "benchmark"), "item_id", T.tokens(F.col("text")))
    return w.select("item_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_pairs(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "benchmark")
    side = lambda k: scoring.ngram_weights(b.select(F.col("item_id").alias(k), "text"), k, T.tokens(F.col("text")))
    return scoring.pair_cosine(side("a"), side("b"), "a", "b")


def _words(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(T.tokens(F.col("text"))).alias("token"))


def bm25_best(s: SparkSession, d: str) -> DataFrame:
    """The best document for each benchmark text, ties to the smaller id."""
    docs = table(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return scoring.bm25_best(_words(table(s, d, "benchmark"), "item_id"), docs, "item_id", "doc_id")


def keyword_recall(s: SparkSession, d: str) -> DataFrame:
    """Share of the query's words in each text, three times, at most 1."""
    asked = F.array(*map(F.lit, QUERY))
    return table(s, d, "documents").select("doc_id", F.round(F.least(F.lit(1.0), F.size(F.array_intersect(asked, T.tokens(F.col("text"), ()))) * 3.0 / len(QUERY)), 6).alias("recall"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"), ())
    hits = F.size(F.array_intersect(F.array(*map(F.lit, QUERY)), t))
    docs = table(s, d, "documents").select("doc_id", "source", (hits * 100.0 / len(QUERY)).alias("relevance"), F.char_length("text").alias("len"), (F.size(U.emails(F.col("text"))) > 0).alias("mail"), F.col("text").rlike(r"\$[0-9]").alias("pay"))
    q = scoring.quality(F.col("relevance"), F.lit(6), F.coalesce("len", F.lit(0)), F.col("mail"), F.coalesce("pay", F.lit(False)), F.col("source") != "src0", F.lit(1))
    return docs.select("doc_id", F.coalesce(q, F.lit(0)).alias("quality"))


def quality_rank(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d)


def adaptive_topk(s: SparkSession, d: str) -> DataFrame:
    return scoring.adaptive_keep(_scored(s, d), "quality", [F.desc("quality"), F.col("doc_id")], wanted=400, good=70)


def dedup_first(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", _key().alias("key"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def merge_richest(s: SparkSession, d: str) -> DataFrame:
    m = entity.merge_richest(table(s, d, "documents"), _key(), "doc_id", "text", "source")
    return m.select("key", "doc_id", F.md5("text").alias("digest"), "sources", "n_merged")


def greedy_dedup(s: SparkSession, d: str) -> DataFrame:
    """Documents as postings with several keys: their whole text, and their first and last hundred words, so that rows meet across keys."""
    words = F.filter(F.split(T.cleaned(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    part = lambda a: F.md5(F.array_join(a, " "))
    whole = F.concat(F.lit("t:"), F.md5(F.coalesce("text", F.lit(""))))
    keys = T.let(words, lambda w: F.array(whole, F.concat(F.lit("a:"), part(F.slice(w, 1, 100))), F.concat(F.lit("z:"), part(F.reverse(F.slice(F.reverse(w), 1, 100))))))
    return entity.greedy_merge(table(s, d, "documents").select("doc_id", keys.alias("keys")), "doc_id", "keys")


def intent_classify(s: SparkSession, d: str) -> DataFrame:
    """The first rule that holds names a turn's intent."""
    x = F.lower(F.coalesce("text", F.lit("")))
    intent = F.when(x.rlike(r"\?"), "question").when(x.rlike("thank|merci|danke|gracias"), "thanks").when(F.char_length(x) < 80, "short").otherwise("statement")
    return table(s, d, "conversations").groupBy("role", intent.alias("intent")).agg(F.count("*").alias("n"))


def persona_best(s: SparkSession, d: str) -> DataFrame:
    """The benchmark text with most distinct words in common for each conversation turn; ties to the smaller id."""
    b = _words(table(s, d, "benchmark"), "item_id").distinct()
    c = table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    n = _words(c, "k").distinct().join(b, "token").groupBy("k", "item_id").agg(F.count("*").alias("n"))
    return n.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("m"), "item_id")).alias("x")).select("k", F.col("x.item_id").alias("item_id"), (-F.col("x.m")).alias("n"))


def stream_daily(s: SparkSession, d: str) -> DataFrame:
    out = streams.drained(streams.daily(streams.event_stream(s, f"{d.rstrip('/')}/events.parquet")))
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    out = streams.drained(streams.sessions(streams.event_stream(s, f"{d.rstrip('/')}/events.parquet")))
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


def stream_times_seen(s: SparkSession, d: str) -> DataFrame:
    out = streams.drained(streams.times_seen(streams.event_stream(s, f"{d.rstrip('/')}/events.parquet")), "update")
    return out.groupBy("user_id").agg(F.max("times_seen").alias("times_seen"))


def search_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Documents as postings: cleaned, matched, scored, the first of each key kept, the best fifty ranked."""
    t = T.tokens(F.col("text"), ())
    hits = F.size(F.array_intersect(F.array(*map(F.lit, QUERY)), t))
    rows = table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", _key().alias("key"), (hits * 100.0 / len(QUERY)).alias("relevance"), F.char_length("text").alias("len"))
    q = scoring.quality(F.col("relevance"), F.lit(6), F.col("len"), F.lit(False), F.lit(False), F.lit(True), F.lit(1))
    best = rows.withColumn("quality", q).groupBy("key").agg(F.min(F.struct("doc_id", "source", "quality")).alias("x")).select("x.*")
    return best.where("quality >= 20").orderBy(F.desc("quality"), "doc_id").limit(50)


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_CLEAN = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_+#./ \t\r\n-]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))".format("text")
_BARE = f"list_transform(string_split(coalesce({_CLEAN}, ''), ' '), lambda x: trim(x, '.-/'))"
_TOKENS = f"list_filter({_BARE}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x))"
_ALL = f"list_filter({_BARE}, lambda x: length(x) >= 3)"
_HITS = f"len(list_intersect([{', '.join(repr(w) for w in QUERY)}], {_ALL}))"
_HOST = "regexp_extract(lower(url), '^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)', 1)"
_ROOT = "(SELECT array_to_string(list_slice(p, greatest(1, len(p) - CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND list_contains(['co','com','org','net','ac','gov'], p[-2]) THEN 2 ELSE 1 END), len(p)), '.') FROM (SELECT string_split({}, '.') AS p))"
def _canonical(url: str) -> str:
    """SQL of the canonical URL, one case for each board."""
    low = f"lower(trim({url}))"
    cases = "".join(f" WHEN regexp_matches({low}, '{p}') THEN '{name}:' || " + " || '/' || ".join(f"regexp_extract({low}, '{p}', {g})" for g in groups) for name, p, groups in U.BOARDS)
    bare = f"regexp_replace(regexp_replace(regexp_replace({low}, '^[a-z]+://', ''), '^www\\.', ''), '[?#].*$', '')"
    return f"CASE{cases} ELSE regexp_replace(regexp_replace({bare}, '/+$', ''), ';jsessionid=[^/?]*', '') END"


_CANON = _canonical("url")
_SPELLED = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\s*(?:\[at\]|\(at\)|\[@\]|\bat\b)\s*', '@', 'g'), '(?i)\s*(?:\[dot\]|\(dot\)|\bdot\b)\s*', '.', 'g'), '([a-zA-Z0-9._%+-]+)\s*@\s*([a-zA-Z0-9.-]+)\s*\.\s*([a-zA-Z]{2,10})', '\1@\2.\3', 'g')"
_EMAILS = rf"""list_distinct(list_filter(list_transform(list_transform(regexp_extract_all({_SPELLED}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,10}}'), lambda e: lower(e)),
    lambda e: CASE WHEN len(string_split(e, '.')) >= 3 AND list_contains({list(U.TRAILING)}, string_split(e, '.')[-1]) AND list_contains({list(U.COMMON_ENDS)}, string_split(e, '.')[-2]) THEN array_to_string(string_split(e, '.')[:-2], '.') ELSE e END),
    lambda e: NOT regexp_matches(e, '\.(?:{"|".join(U.FILE_ENDS)})$') AND NOT regexp_matches(e, '^(?:{"|".join(U.NO_PERSON)})') AND NOT list_contains({list(U.NO_DOMAIN)}, regexp_replace(e, '^[^@]*@', '')) AND length(regexp_extract(e, '^[^@]*')) >= 2 AND length(regexp_replace(e, '^[^@]*@', '')) >= 4))"""
_NAMED = "MAP {" + ", ".join(f"'&{name};': chr({code})" for name, code in name2codepoint.items()) + ", '&apos;': chr(39)}"
_ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _entities(x: str) -> str:
    code = "CASE WHEN e[3] IN ('x', 'X') THEN ('0x' || e[4:-2])::BIGINT ELSE e[3:-2]::BIGINT END"
    made = f"CASE WHEN e[2] = '#' THEN CASE WHEN {code} > 0 AND {code} <= 1114111 AND NOT ({code} BETWEEN 55296 AND 57343) THEN chr(({code})::INT) ELSE e END ELSE coalesce({_NAMED}[e], e) END"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{_ENTITY}'), list_transform(regexp_extract_all({x}, '{_ENTITY}'), lambda e: {made})), lambda p: p[1] || coalesce(p[2], '')), '')"


_GRAMS = f"""WITH t AS (SELECT item_id, {_TOKENS} AS t FROM benchmark), g AS (SELECT item_id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
    w AS (SELECT item_id, term, 1 + ln(count(*)) AS weight FROM g GROUP BY 1, 2)"""
_QUALITY = "CAST(least(100, greatest(0, round_even(0.5::DOUBLE * (h * 100.0::DOUBLE / 6) + 6 + CASE WHEN l >= 800 THEN 10 WHEN l >= 250 THEN 6 WHEN l >= 80 THEN 2 ELSE 0 END + {}, 0))) AS INTEGER)"
_SCORED = f"""WITH s AS (SELECT doc_id, source, {_HITS} AS h, coalesce(length(text), 0) AS l, len({_EMAILS}) > 0 AS mail, coalesce(regexp_matches(text, '\\$[0-9]'), false) AS pay FROM documents),
    q AS (SELECT doc_id, {_QUALITY.format("CASE WHEN mail THEN 10 ELSE 0 END + CASE WHEN pay THEN 5 ELSE 0 END + CASE WHEN source <> 'src0' THEN 5 ELSE 0 END")} AS quality FROM s)"""
_KEY = f"md5({_CLEAN})"
_DAILY = "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"

SQL = {
    "clean_tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "stem_tokens": f"""SELECT item_id, array_to_string(list_transform({_TOKENS}, lambda x: CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN regexp_replace(x, 'ies$', 'y')
        WHEN length(x) > 4 AND regexp_matches(x, '(ers|ors|ists|ysts|ants|ents|ects)$') THEN regexp_replace(x, 's$', '') ELSE x END), ' ') AS stems FROM benchmark""",
    "canonical_urls": f"SELECT page_id, {_CANON} AS canonical, {_ROOT.format(_HOST)} AS domain FROM pages",
    "url_domain_counts": f"SELECT domain, count(*) AS n, count(DISTINCT canonical) AS n_urls FROM (SELECT {_CANON} AS canonical, {_ROOT.format(_HOST)} AS domain FROM pages) GROUP BY 1",
    "html_to_text": rf"""SELECT page_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace({_entities("b")}, '[ \t\r\n]+', ' ', 'g')) AS t FROM (
        SELECT page_id, regexp_replace(regexp_replace({_entities("html")}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS b FROM pages))""",
    "email_extract": f"""SELECT doc_id, email, {_ROOT.format("string_split(email, '@')[-1]")} AS domain, CASE WHEN list_contains(['gmail.com','outlook.com','yahoo.com','hotmail.com','gmx.de'], string_split(email, '@')[-1]) THEN 3
        WHEN list_contains(['hr','jobs','careers','recruiting','info','contact','hello','support','sales','admin','team'], string_split(email, '@')[1]) THEN 2 ELSE 1 END AS tier FROM (SELECT doc_id, unnest({_EMAILS}) AS email FROM documents)""",
    "ngram_tf": f"{_GRAMS} SELECT item_id, term, round(weight, 6) AS weight FROM w",
    "tfidf_pairs": f"""{_GRAMS}, n AS (SELECT item_id, sum(weight * weight) AS n FROM w GROUP BY 1), p AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.weight * y.weight) AS dot, sum(x.weight * x.weight) AS sa, sum(y.weight * y.weight) AS sb
        FROM w x JOIN w y USING (term) GROUP BY 1, 2) SELECT a, b, round(dot / sqrt(((na.n - sa) * pow(1 + ln(1.5), 2) + sa) * ((nb.n - sb) * pow(1 + ln(1.5), 2) + sb)), 6) AS cosine
        FROM p JOIN n na ON na.item_id = a JOIN n nb ON nb.item_id = b""",
    "bm25_best": f"""WITH q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS token FROM benchmark), d AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), nq AS (SELECT item_id, count(*) AS nq FROM q GROUP BY 1),
        dl AS (SELECT doc_id, count(*) AS dl FROM d GROUP BY 1), tf AS (SELECT doc_id, token, count(*) AS tf FROM d GROUP BY 1, 2),
        s AS (SELECT item_id, doc_id, sum(ln(4) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 150.0))) AS raw FROM q JOIN tf USING (token) JOIN dl USING (doc_id) GROUP BY 1, 2),
        r AS (SELECT item_id, doc_id, round(least(1.0, raw / (nq * ln(2) * 2.5)), 6) AS bm25 FROM s JOIN nq USING (item_id)) SELECT item_id, doc_id, bm25 FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) = 1""",
    "keyword_recall": f"SELECT doc_id, round(least(1.0, {_HITS} * 3.0 / 6)::DOUBLE, 6) AS recall FROM documents",
    "quality_rank": f"{_SCORED} SELECT doc_id, quality FROM q",
    "adaptive_topk": f"""{_SCORED}, g AS (SELECT count(*) AS n FROM q WHERE quality >= 70), f AS (SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC, doc_id) AS no FROM q WHERE quality >= 20 AND quality < 70)
        SELECT doc_id, quality FROM q WHERE quality >= 70 UNION ALL SELECT doc_id, quality FROM f, g WHERE no + n <= 400""",
    "dedup_first": f"SELECT {_KEY} AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "merge_richest": f"""SELECT {_KEY} AS key, min(doc_id) AS doc_id, md5(arg_max(text, (length(text), -doc_id))) AS digest, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n_merged FROM documents GROUP BY 1""",
    "intent_classify": r"""SELECT role, CASE WHEN contains(x, '?') THEN 'question' WHEN regexp_matches(x, 'thank|merci|danke|gracias') THEN 'thanks' WHEN length(x) < 80 THEN 'short' ELSE 'statement' END AS intent, count(*) AS n
        FROM (SELECT role, lower(coalesce(text, '')) AS x FROM conversations) GROUP BY 1, 2""",
    "persona_best": f"""WITH b AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS token FROM benchmark), c AS (SELECT DISTINCT conv_id || ':' || turn AS k, unnest({_TOKENS}) AS token FROM conversations),
        n AS (SELECT k, item_id, count(*) AS n FROM c JOIN b USING (token) GROUP BY 1, 2) SELECT k, item_id, n FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, item_id) = 1""",
    "stream_daily": _DAILY,
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
        SELECT user_id, CAST(sum(new) AS BIGINT) AS n_sessions, count(*) AS n FROM g GROUP BY 1""",
    "stream_times_seen": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS new FROM events)
        SELECT user_id, CAST(sum(new) AS BIGINT) AS times_seen FROM g GROUP BY 1""",
    "search_pipeline": f"""WITH s AS (SELECT doc_id, source, {_KEY} AS key, {_HITS} AS h, length(text) AS l FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, source, key, {_QUALITY.format("5")} AS quality FROM s),
        f AS (SELECT doc_id, source, quality FROM q QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1) SELECT doc_id, source, quality FROM f WHERE quality >= 20 ORDER BY quality DESC, doc_id LIMIT 50""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "greedy_dedup"]}
