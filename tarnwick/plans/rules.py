"""Dates, links, mailboxes, kinds of postings and relevance over literal cases and whole tables, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import profile as P
from tarnwick.functions import relevance as R
from tarnwick.functions import rules as U
from tarnwick.functions.lexicon import SHORT
from tarnwick.plans import matching as MP
from tarnwick.session import table

TODAY, NOW_MS = "2026-01-15", 1_768_435_200_000
URLS = [
    "https://www.linkedin.com/jobs/search?currentJobId=3812345678", "https://www.linkedin.com/jobs/view/data-engineer-at-acme-3812345679?ref=x", "https://x.io/jobs/view/123/", "https://town.example/jobPosting/4455",
    "https://site.com/o/12345678/x", "https://boards.greenhouse.io/acme?gh_jid=998877", "https://a.b/c/123", "", None, "https://indeed.com/viewjob?jk=ab12cd34ef",
    "https://www.linkedin.com/posts/ann-lee_hiring-data-engineer-in-paris-activity-7283000000000000000-aBcD", "https://www.linkedin.com/posts/nobody",
]
SNOWFLAKES = ["7283000000000000000", "7417000000000000000", "12", "99999999999999999999", "x", None]
AGES = ["2 hours ago", "Just now", "an hour ago", "yesterday", "hier", "3 days ago", "il y a 5 jours", "a week ago", "2 weeks ago", "un mois", "3 mois", "a year ago", "2 ans", "recently", "N/A", "", None, "30+ days", "about an hour", "1d ago", "soon", "10 mins ago"]
STAMPS = ["1700000000", "1700000000000", "2024-03-05", "2024-03-05T10:11:12Z", "2024-03-05T10:11:12+02:00", "posted 2024-03-05 in town", "2024-03-05 08:09", "never", "", None]
DEADLINES = [
    ("2026-01-20", None), (None, "Great job. Apply by January 16, 2026. Bye"), (None, "Application deadline: 15 janvier 2026"), ("2025-12-31", "x"), (None, "closing date - 2026/02/28"), (None, "date limite de candidature: 3 août 2026"),
    (None, "no date here"), ("February 30, 2026", None), (None, "Applications close on March 1st, 2026"), (None, None), ("soon", "Apply before tomorrow morning"),
]
MAILBOXES = ["hr@firm.com", "jobs.team@firm.co.uk.please", "info@firm.com", "info-jobs@firm.com", "x@firm.com", "recruiting@example.com", "careers@firm..com", "careers@a.b", "no at sign", None, "talent2@firm.io", "support@firm.com", "HR@Firm.Com", "career@firm.png"]
HIRING, OTHER = ("hr", "jobs", "career", "recruit", "talent", "hiring"), ("info", "support", "sales", "admin", "contact")
BODIES = ["see http://x.com/a, and https://acme.com/careers/12. bye", "https://t.me/a then https://acme.com/team;", "https://twitter.com/x", "none", None]
POSTINGS = [
    ("Data Engineer", "https://a.b/1", "Acme Inc", "Fully remote, full time. Contract possible. No fee."), ("Jobs in Paris", "https://a.b/2", "Acme", "Part time internship"), ("Cluj.", None, "www.jobrapido", "télétravail pour une entreprise, cdi au centre"),
    ("Dev", "https://a.b/3", "X", "Make money fast at home office"), ("Analyst", "https://agg.com/search?q=x", "Confidential", "Nous recherchons un analyste"), ("Nurse", "https://a.b/4", "Jobrapido", "Night shifts"), (None, None, None, None),
    ("Software Engineer", "https://a.b/5", "Global Labs Technologies GmbH", "fulltime parttime"),
]
TITLES, LINKS, LISTERS, SPAM = r"(?i)\bjobs in\b", r"(?i)/search\?", ("jobrapido", "jooble"), r"(?i)\bmake money fast\b"
PAYS = [(50000.0, 70000.0, None), (50000.0, 50000.0, None), (None, 60000.0, None), (None, None, "from 30 to 40k a year, with many extras on top of it all and more"), (1234567.8, None, "x"), (None, None, None)]
WINDOW = [(1.0, False), (24.0, False), (25.0, False), (3000.0, False), (None, False), (5.0, True), (5.0, None)]
SOURCES = [("https://boards.greenhouse.io/x/1", None, "web"), (None, "https://acme.wd3.myworkdayjobs.com/x", None), (None, "https://a.b", "ats_lever"), (None, None, "ats"), ("https://a.b", "https://c.d", "linkedin"), (None, None, None)]
HOSTS, VENDORS = {"greenhouse.io": "Greenhouse", "myworkdayjobs.com": "Workday", "lever.co": "Lever"}, {"lever": "Lever", "ashby": "Ashby"}
SEARCHES = ["Python Developer", "data analyst", "Senior Full Stack Engineer", "the", "golang"]
ANSWERS = [
    ("Python Developer", "Django and SQL"), ("Senior Python Engineer (m/f)", "x"), ("Java Developer", "Spring; some python too"), ("Java Developer", "Spring"), ("Product Owner", "we use python"), ("Data Analysts", "SQL reports"), ("Business analyst", "data"),
    ("Cook", "data analyst wanted by our friends"), ("Cook", "analyst of soups"), ("Fullstack programmer", "full-stack work"), ("Go Engineer", "golang services"), (None, None), ("Full-Stack Engineers", None), ("Support lead", "frontend and backend, data entry"),
]
WORDS = R.SearchWords()
#: Searches over the documents, in their own words: the first words of a text stand for its title.
TEXT_WORDS = R.SearchWords(stop=("the", "and"), soft=("of",), classes=(("that", "thand"), ("edtion", "ereren")), anchors=("tionan",), role="that")
TEXT_SEARCHES = ["that edtion", "tionan the thand", "of"]


def _cases(s: SparkSession, d: str, rows: list, shape: str, own: bool = True) -> DataFrame:
    """Each document with one of the cases by its id (no): the case's columns, of which text or body has the document's own text behind it if `own`."""
    fields = [f.strip().split(" ") for f in shape.split(",")]
    cases = F.array(*[F.struct(*[F.lit(x).cast(t).alias(c) for x, (c, t) in zip(r if isinstance(r, tuple) else (r,), fields, strict=True)]) for r in rows])
    docs = table(s, d, "documents").select(F.col("doc_id").alias("no"), F.get(cases, (F.col("doc_id") % len(rows)).cast("int")).alias("case_"), F.col("text").alias("own_"))
    return docs.select("no", *[F.concat_ws(" ", f"case_.{c}", "own_").alias(c) if own and c in ("text", "body") else F.col(f"case_.{c}") for c, _ in fields])


def url_ids(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _cases(s, d, URLS, "url string").select("no", U.job_id(u).alias("id"), U.clean_job_url(u).alias("key"), F.coalesce(U.slug_words(u), F.lit("")).alias("words"))


def snowflake_ages(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, SNOWFLAKES, "id string").select("no", U.snowflake_ms(F.col("id"), NOW_MS).alias("ms"))


def age_words(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, AGES, "said string").select("no", U.age_of_words(F.col("said")).alias("hours"))


def iso_stamps(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, STAMPS, "said string").select("no", U.iso_stamp(F.col("said")).alias("iso"))


def deadlines(s: SparkSession, d: str) -> DataFrame:
    x = U.deadline(F.col("field"), F.col("text"), F.lit(TODAY).cast("date"))
    return _cases(s, d, DEADLINES, "field string, text string").select("no", x["deadline"].alias("deadline"), x["days"].alias("days"), x["label"].alias("label"))


def mailboxes(s: SparkSession, d: str) -> DataFrame:
    e = F.col("address")
    return _cases(s, d, MAILBOXES, "address string").select("no", U.trimmed_address(F.coalesce(e, F.lit(""))).alias("trimmed"), U.valid_address(e, ("board.com",)).alias("valid"), F.coalesce(U.hiring_mailbox(e, HIRING, OTHER), F.lit(False)).alias("hiring"))


def portal_links(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, BODIES, "body string").select("no", U.portal_link(F.col("body"), F.lit("https://own")).alias("link"))


def posting_flags(s: SparkSession, d: str) -> DataFrame:
    t, u, c, x = (F.col(n) for n in ("title", "url", "company", "text"))
    return _cases(s, d, POSTINGS, "title string, url string, company string, text string").select(
        "no", F.coalesce(x.rlike(U.REMOTE), F.lit(False)).alias("remote"), F.coalesce(F.array_join(U.job_types(x), ","), F.lit("")).alias("types"), U.language(x).alias("language"), U.company_slug(c).alias("slug"),
        U.no_posting(t, u, c, TITLES, LINKS, LISTERS).alias("no_posting"), U.spam(t, x, c, SPAM).alias("spam"),
    )


def pay_labels(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, PAYS, "low double, high double, text string").select("no", U.pay_label(F.col("low"), F.col("high"), F.col("text")).alias("label"))


def search_window(s: SparkSession, d: str) -> DataFrame:
    h, c = F.col("hours"), F.col("closed")
    return _cases(s, d, WINDOW, "hours double, closed boolean").select("no", U.in_window(h, c, None).alias("any_time"), U.in_window(h, c, 24.0).alias("last_day"))


def ats_sources(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, SOURCES, "direct string, url string, site string").select("no", U.first_party(F.col("direct"), F.col("url"), F.col("site"), HOSTS, VENDORS).alias("vendor"))


def ats_keywords(s: SparkSession, d: str) -> DataFrame:
    """The twelve skills that each posting names most, and whether the first CV has them."""
    own = s.range(1).select(P.names(P.found_terms(P.normalized(F.lit(MP.CVS[0][1]), SHORT), SHORT.tech)).alias("own"))  # one row, worked out once
    found = P.found_terms(P.normalized(F.concat_ws("\n", "title", "text"), SHORT), SHORT.tech)
    ranked = F.slice(F.array_sort(F.transform(found, lambda x: F.struct((-x["n"]).alias("m"), x["term"].alias("keyword")))), 1, 12)
    rows = MP.jobs(s, d).select("job_id", F.posexplode(ranked).alias("rank", "k")).crossJoin(F.broadcast(own))
    return rows.select("job_id", (F.col("rank") + 1).alias("rank"), "k.keyword", (-F.col("k.m")).alias("mentions"), F.array_contains("own", F.col("k.keyword")).alias("in_cv"))


def title_relevance(s: SparkSession, d: str) -> DataFrame:
    rows = _cases(s, d, ANSWERS, "title string, text string").select("no", R.relevances(SEARCHES, F.col("title"), F.col("text"), WORDS).alias("r"))
    each = [F.get("r", F.lit(n)).cast("int").alias(f"q{n}") for n in range(len(SEARCHES))]
    return rows.select("no", *each, F.greatest(F.lit(0), F.get("r", F.lit(0)), F.get("r", F.lit(1))).cast("int").alias("best"))


def document_relevance(s: SparkSession, d: str) -> DataFrame:
    """Every document as a posting whose first sentence is its title."""
    title = F.substring_index("text", ".", 1)
    rows = table(s, d, "documents").select("doc_id", R.relevances(TEXT_SEARCHES, title, F.col("text"), TEXT_WORDS).alias("r"))
    return rows.select("doc_id", *[F.get("r", F.lit(n)).cast("int").alias(f"q{n}") for n in range(len(TEXT_SEARCHES))])


# SQL, from the rules


def _values(rows: list, names: str, types: str, own: bool = True) -> str:
    """The same as SQL; each column of the cases is cast once so that nulls have a type."""
    rows = [(n, *(r if isinstance(r, tuple) else (r,))) for n, r in enumerate(rows)]
    text = ", ".join("(" + ", ".join("NULL" if x is None else MP._q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    cast = ", ".join(f"concat_ws(' ', CAST(v.{n} AS {t}), o.own_) AS {n}" if own and n in ("text", "body") else f"CAST(v.{n} AS {t}) AS {n}" for n, t in zip(names.split(), types.split(), strict=True))
    return f"(SELECT o.no, {cast} FROM (SELECT doc_id AS no, text AS own_ FROM documents) o LEFT JOIN (VALUES {text}) AS v(case_, {', '.join(names.split())}) ON v.case_ = o.no % {len(rows)})"


def _first(x: str, pattern: str, n: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {n}), '')"


_ID = f"coalesce({_first('url', 'currentJobId=([0-9]+)')}, {_first('url', '-([0-9]{7,12})(?:[/?#]|$)')}, {_first('url', '/jobs/view/([0-9]+)(?:[/?#]|$)')}, {_first('url', '/jobPosting/([0-9]+)')}, list_filter(regexp_extract_all(url, '[0-9]+'), lambda z: length(z) BETWEEN 8 AND 11)[1])"
_CANON = rf"""coalesce('linkedin:' || {_first('low', 'currentjobid=([0-9]+)')}, 'linkedin:' || {_first('low', '/jobs/view/(?:[^/?#]*-)?([0-9]{6,})')}, 'indeed:' || {_first('low', '[?&]jk=([a-z0-9]+)')},
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, '^https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', ''))"""
_AGE = [("just now|moment|second|minute|min ago|mins ago|less than an hour|moments ago|few seconds|à l''instant", "0.5"), (r"\b(an?\s+hour|une\s+heure)\b", "1"), (r"([0-9]+)\s*(hours?|hrs?|h|heures?)\b", "n * 1"), (r"yesterday|hier|\b1\s*days?\s*ago\b|\b1d\s*ago\b", "24"),
        (r"\b(a\s+day\s+ago|un\s+jour)\b", "24"), (r"([0-9]+)\s*(days?|d|jours?|j)\b", "n * 24"), (r"\b(a\s+week\s+ago|une\s+semaine)\b", "168"), (r"([0-9]+)\s*(weeks?|wks?|w|semaines?)\b", "n * 168"), (r"\b(a\s+month\s+ago|un\s+mois)\b", "720"),
        (r"([0-9]+)\s*(months?|mos?|mo|mois)\b", "n * 720"), (r"\b(a\s+year|an?\s+yr|un\s+an)\b", "8760"), (r"([0-9]+)\s*(years?|yrs?|yr|y|ans?|an)\b", "n * 8760")]
_AGE_SQL = " ".join(f"WHEN regexp_matches(low, '{p}') THEN " + h.replace("n *", f"CAST(regexp_extract(low, '{p}', 1) AS DOUBLE) *") for p, h in _AGE)
_MONTH = "MAP {" + ", ".join(f"'{name}': {n}" for name, n in U.MONTHS.items()) + "}"


def _date(x: str) -> str:
    day = lambda y, m, d: f"TRY_CAST({y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
    a, b, c = r"\b(20\d\d)[-/.](\d{1,2})[-/.](\d{1,2})\b", r"([A-Za-zÀ-ÿ]{3,10})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(20\d\d)\b", r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-zÀ-ÿ]{3,10})\.?,?\s+(20\d\d)\b"
    month = lambda p, n: f"{_MONTH}[lower(regexp_extract({x}, '{p}', {n}))]"
    return f"coalesce({day(_first(x, a, 1), _first(x, a, 2), _first(x, a, 3))}, {day(_first(x, b, 3), month(b, 1), _first(x, b, 2))}, {day(_first(x, c, 3), month(c, 2), _first(x, c, 1))})"


_PHRASE = U.DEADLINE.replace("'", "''")


def _search(x: str, words: R.SearchWords) -> str:
    low = f"lower(coalesce({x}, ''))"
    for a, b in R.SPELLINGS:
        low = f"replace({low}, '{a}', '{b}')"
    one = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(ers|ors|ists|ysts|ants|ents|ects)$') THEN w[:-2] ELSE w END"
    group = "CASE " + " ".join(f"WHEN list_contains({list(g)}, w) THEN '#{n}'" for n, g in enumerate(words.classes)) + " ELSE w END"
    return f"list_transform(list_transform(list_filter(regexp_extract_all({low}, '[a-zà-ÿ0-9+#]+'), lambda w: NOT list_contains({list(words.stop)}, w)), lambda w: {one}), lambda w: {group})"


def _relevance(query: str, words: R.SearchWords) -> str:
    """Over columns title, text, t and x (the classes of both)."""
    core = R.core_words(query, words)
    if not core:
        return "50"
    asked, low = [words.class_of(w) for w in core], query.lower()
    anchors = [words.class_of(w) for w in core if w in words.anchors]
    hits, far = (" + ".join(f"list_contains({c}, '{a}')::INT" for a in asked) for c in "tx")
    technique = f"WHEN NOT list_has_any(t, {anchors}) AND NOT list_has_any(x, {anchors}) THEN 0 WHEN NOT list_has_any(t, {anchors}) THEN CASE WHEN list_contains(t, '{words.class_of(words.role)}') THEN 38 ELSE 25 END" if anchors else ""
    return (
        f"CAST(CASE WHEN regexp_matches(lower(coalesce(title, '')), '\\b{low}\\b') THEN 100 {technique} WHEN {hits} = {len(asked)} THEN 90 "
        f"WHEN {hits} > 0 THEN floor(40 + 30.0 * ({hits}) / {len(asked)} + CASE WHEN list_contains(t, '{asked[-1]}') THEN 10 ELSE 0 END) "
        f"WHEN coalesce(text, '') = '' THEN 0 WHEN contains(lower(text), '{low}') THEN 35 ELSE floor(25.0 * ({far}) / {len(asked)}) END AS INT)"
    )


def _in(x: str, words: tuple[str, ...]) -> str:
    return f"list_contains({list(words)}, {x})"


_TRIM = f"CASE WHEN len(string_split(e, '.')) >= 3 AND {_in('''string_split(e, '.')[-1]''', U.TRAILING)} AND {_in('''string_split(e, '.')[-2]''', U.COMMON_ENDS)} THEN array_to_string(string_split(e, '.')[:-2], '.') ELSE e END"
_LINKS = r"list_transform(regexp_extract_all(coalesce(body, ''), 'https?://[^\s<>\"'')]+'), lambda u: regexp_replace(u, '[.,;:]+$', ''))"
_FR = " + ".join(f"contains(l, '{h}')::INT" for h in (" à ", " au ", " aux ", " cdi ", " cdd ", " stage ", " alternance ", " entreprise ", " mission ", " formation "))
_STRONG = "|".join(U.FRENCH).replace("'", "''")
_BOX = "regexp_extract(lower(e), '^[^@]*')"
_HOST = "regexp_extract(lower({}), '^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)', 1)"

SQL = {
    "url_ids": rf"""SELECT no, {_ID} AS id, CASE WHEN coalesce(url, '') = '' THEN '' ELSE coalesce('greenhouse:' || {_first('url', '[?&]gh_jid=([0-9]+)')}, {_CANON}) END AS key,
        trim(regexp_replace(regexp_replace(regexp_extract(regexp_extract(coalesce(url, ''), '^(?:[a-z]+://)?[^/]*/+posts/([^/?#]+)', 1), '^[^_]*_(.*)$', 1), '(?i)-(?:activity|share|ugcPost)-[0-9]+.*$', ''), '[-_\s]+', ' ', 'g')) AS words
        FROM (SELECT *, lower(trim(url)) AS low FROM {_values(URLS, "url", "VARCHAR")})""",
    "snowflake_ages": f"SELECT no, CASE WHEN ms BETWEEN 1420070400000 AND {NOW_MS} + 86400000 THEN ms END AS ms FROM (SELECT no, TRY_CAST(id AS BIGINT) // 4194304 AS ms FROM {_values(SNOWFLAKES, 'id', 'VARCHAR')})",
    "age_words": f"SELECT no, CAST(CASE WHEN low IN ('recently', 'recent', 'n/a', 'none', 'unknown', '') THEN NULL {_AGE_SQL} END AS DOUBLE) AS hours FROM (SELECT no, lower(trim(said)) AS low FROM {_values(AGES, 'said', 'VARCHAR')})",
    "iso_stamps": rf"""SELECT no, CASE WHEN regexp_full_match(s, '[0-9]+') THEN strftime(make_timestamp(CAST(floor(CASE WHEN s::DOUBLE > 1e12 THEN s::DOUBLE / 1000 ELSE s::DOUBLE END) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
        WHEN regexp_matches(s, '\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d') AND TRY_CAST(s AS TIMESTAMPTZ) IS NOT NULL THEN strftime(epoch_us(TRY_CAST(CASE WHEN regexp_matches(s, '(Z|[+-]\d\d:\d\d)$') THEN s ELSE s || '+00:00' END AS TIMESTAMPTZ)).make_timestamp(), '%Y-%m-%dT%H:%M:%SZ')
        ELSE regexp_extract(s, '\d{{4}}-\d\d-\d\d') END AS iso FROM (SELECT no, trim(coalesce(said, '')) AS s FROM {_values(STAMPS, "said", "VARCHAR")})""",
    "deadlines": f"""WITH a AS (SELECT no, coalesce({_date("coalesce(field, '')")}, {_date("said")}) AS deadline FROM (SELECT *, regexp_extract(coalesce(text, ''), '{_PHRASE}', 1) AS said FROM {_values(DEADLINES, "field text", "VARCHAR VARCHAR")})),
        b AS (SELECT *, CAST(deadline - DATE '{TODAY}' AS INT) AS days FROM a)
        SELECT no, deadline, days, CASE WHEN days IS NULL THEN NULL WHEN days < 0 THEN 'Deadline passed (' || deadline || ')' WHEN days = 0 THEN 'Closes today!' WHEN days <= 7 THEN 'Closes in ' || days || 'd (' || deadline || ')' ELSE 'Closes ' || deadline END AS label FROM b""",
    "mailboxes": rf"""WITH a AS (SELECT no, coalesce(address, '') AS e FROM {_values(MAILBOXES, "address", "VARCHAR")}), b AS (SELECT no, e, {_TRIM} AS trimmed FROM a),
        c AS (SELECT *, {_TRIM.replace("(e,", "(lower(trim(e)),").replace("ELSE e END", "ELSE lower(trim(e)) END")} AS f FROM b), d AS (SELECT *, string_split(f, '@') AS p FROM c),
        g AS (SELECT *, len(p) = 2 AND length(p[1]) >= 2 AND length(p[2]) >= 4 AND contains(p[2], '.') AND length(string_split(p[2], '.')[-1]) BETWEEN 2 AND 10 AND NOT contains(f, '..') AND NOT {_in("p[2]", (*U.NO_DOMAIN, "board.com"))}
            AND NOT regexp_matches(f, '\.({"|".join(U.FILE_ENDS)})$') AS valid FROM d)
        SELECT no, trimmed, coalesce(valid, false) AS valid, coalesce(valid AND ({" OR ".join(f"contains({_BOX}, '{w}')" for w in HIRING)}) AND NOT {_in(_BOX, OTHER)} AND NOT regexp_matches({_BOX}, '^({"|".join(OTHER)})[._-]') AND (length({_BOX}) >= 3 OR {_BOX} = 'hr'), false) AS hiring FROM g""",
    "portal_links": f"SELECT no, coalesce(list_filter({_LINKS}, lambda u: regexp_matches(lower(u), '{U.PORTAL}'))[1], list_filter({_LINKS}, lambda u: NOT regexp_matches(lower(u), '{U.NO_PORTAL}'))[1], 'https://own') AS link FROM {_values(BODIES, 'body', 'VARCHAR')}",
    "posting_flags": rf"""WITH a AS (SELECT *, ' ' || lower(coalesce(text, '')) || ' ' AS l, regexp_replace(lower(trim(coalesce(company, ''))), '^www\.', '') AS c FROM {_values(POSTINGS, "title url company text", "VARCHAR VARCHAR VARCHAR VARCHAR")})
        SELECT no, coalesce(regexp_matches(text, '{U.REMOTE}'), false) AS remote, array_to_string(list_filter([CASE WHEN regexp_matches(l, 'full\s?time') THEN 'fulltime' END, CASE WHEN regexp_matches(l, 'part\s?time') THEN 'parttime' END,
            CASE WHEN contains(l, 'internship') THEN 'internship' END, CASE WHEN contains(l, 'contract') THEN 'contract' END], lambda z: z IS NOT NULL), ',') AS types,
            CASE WHEN regexp_matches(l, '{_STRONG}') OR ({_FR}) >= 2 THEN 'fr' ELSE 'en' END AS language, regexp_replace(regexp_replace(lower(coalesce(company, '')), '\b({U.SLUG_OUT})\b', '', 'g'), '[^a-z0-9]', '', 'g') AS slug,
            length(trim(coalesce(title, ''))) <= 3 OR regexp_full_match(trim(title), '[A-Za-zÀ-ÿ\s.-]{{1,18}}\.') OR regexp_matches(title, '{TITLES}') OR coalesce(regexp_matches(url, '{LINKS}'), false) OR {_in("c", LISTERS)} AS no_posting,
            regexp_matches(concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(text, '')), '{SPAM}') AS spam FROM a""",
    "pay_labels": f"""SELECT no, CASE WHEN a || b <> '' THEN a || b ELSE coalesce(text, '')[1:60] END AS label FROM (SELECT *, CASE WHEN coalesce(low, 0) <> 0 THEN '$' || format('{{:,}}', CAST(floor(low) AS BIGINT)) ELSE '' END AS a,
        CASE WHEN coalesce(high, 0) <> 0 AND high <> coalesce(low, 0) THEN '–$' || format('{{:,}}', CAST(floor(high) AS BIGINT)) ELSE '' END AS b FROM {_values(PAYS, "low high text", "DOUBLE DOUBLE VARCHAR")})""",
    "search_window": f"SELECT no, coalesce(hours <= 2160, true) AND NOT coalesce(closed, false) AS any_time, coalesce(hours <= 24, false) AND NOT coalesce(closed, false) AS last_day FROM {_values(WINDOW, 'hours closed', 'DOUBLE BOOLEAN')}",
    "ats_sources": f"SELECT no, coalesce({', '.join(f'''CASE WHEN contains({_HOST.format(u)}, '{h}') THEN '{v}' END''' for u in ('direct', 'url') for h, v in HOSTS.items())}, CASE lower(site) WHEN 'ats_lever' THEN 'Lever' WHEN 'ats_ashby' THEN 'Ashby' WHEN 'ats' THEN 'Company ATS' END) AS vendor FROM {_values(SOURCES, 'direct url site', 'VARCHAR VARCHAR VARCHAR')}",
    "ats_keywords": f"""WITH j AS (SELECT job_id, {MP._norm("title || chr(10) || t")} AS norm FROM {MP.JOBS_SQL}), f AS (SELECT job_id, unnest({MP._found("norm", SHORT.tech)}) AS s FROM j),
        c AS (SELECT {MP._names(MP._found(f"({MP._norm(MP._q(MP.CVS[0][1]))})", SHORT.tech))} AS own)
        SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY s.n DESC, s.term) AS INT) AS rank, s.term AS keyword, CAST(s.n AS INT) AS mentions, list_contains(own, s.term) AS in_cv FROM f, c QUALIFY rank <= 12""",
    "title_relevance": f"""WITH a AS (SELECT *, {_search("title", WORDS)} AS t, {_search("text", WORDS)} AS x FROM {_values(ANSWERS, "title text", "VARCHAR VARCHAR")})
        SELECT no, {", ".join(f"{_relevance(q, WORDS)} AS q{n}" for n, q in enumerate(SEARCHES))}, greatest({_relevance(SEARCHES[0], WORDS)}, {_relevance(SEARCHES[1], WORDS)}) AS best FROM a""",
    "document_relevance": f"""WITH d AS (SELECT doc_id, text, string_split(text, '.')[1] AS title FROM documents), a AS (SELECT *, {_search("title", TEXT_WORDS)} AS t, {_search("text", TEXT_WORDS)} AS x FROM d)
        SELECT doc_id, {", ".join(f"{_relevance(q, TEXT_WORDS)} AS q{n}" for n, q in enumerate(TEXT_SEARCHES))} FROM a""",
}
QUERIES = {name: globals()[name] for name in SQL}
