"""Faceted searches over documents and parts, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import facets as A
from tarnwick.operators import facets as O
from tarnwick.session import table

TITLES = ("Senior cook", "Junior baker", "Intern", "Head of halls", "Cook", None, "Chief baker", "Team lead", "Mid baker")
NOTES = ("Remote work", "hybride, full-time", "", "Freelance contract", "Temps plein à Paris", None, "part-time; who can apply: all", "CDD, premier emploi")
LABELS = ("2 hours ago", "just now", "yesterday", "3 days ago", "a week ago", "2 weeks ago", "un mois", "2 months ago", "1 year ago", "recently", "2026-01-14", "2026-01-02 10:00:00", "N/A", None, "30 jours", "soon", "5 min ago", "20 heures", "3w", "Today")
OFFERED = {"company": ("SRC1", "src2", "nobody"), "sector": ("tion", "halls"), "function": ("baker", "cook"), "title": ("Cook", "baker"), "commitment": ("the", "pour")}
CHOSEN = {"experience": ["senior", "entry", "director"], "workplace": ["remote", "onsite"], "type": [], "function": ["baker", "cook", "halls"], "company": ["SRC1", "src2"]}
PART_CHOSEN = {"brand": ["Brand#1", "Brand#12", "Brand#7"], "kind": ["ECONOMY", "SMALL"], "size": ["0-9", "20-29"], "price": []}
NOW = "2026-01-15 12:00:00"


def _pick(values: tuple, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _postings(s: SparkSession, d: str) -> DataFrame:
    """Documents as postings: their texts with a note behind, a title, their source as firm and their language as place."""
    k = F.col("doc_id")
    return table(s, d, "documents").select(
        "doc_id", _pick(TITLES, k).alias("title"), F.concat_ws(" ", "text", _pick(NOTES, k)).alias("text"), F.col("source").alias("company"), F.col("lang").alias("place"), (k % 10 == 3).alias("is_remote"), (k % 4).alias("n_emails"), (k % 6 == 1).alias("easy"),
        (k % 9 == 0).alias("abroad"), F.when(k % 3 != 0, (k * 13 % 2500).cast("double")).alias("hours"), (k % 101).alias("rank"), _pick(LABELS, k).alias("label"), F.when(k % 17 == 0, k % 2 == 0).alias("closed"), (k % 23 == 0).alias("is_new"),
    )


def _values() -> dict[str, Column]:
    return A.posting_facets(F.col("title"), F.col("text"), F.col("company"), F.col("place"), F.col("is_remote"), F.col("n_emails"), F.col("easy"), F.col("abroad"), OFFERED)


def posting_facets(s: SparkSession, d: str) -> DataFrame:
    return O.facet_counts(_postings(s, d), _values(), CHOSEN, A.of_age(F.col("closed"), F.col("hours"), F.col("is_new"), F.col("label"), None, F.lit(NOW).cast("timestamp")))


def faceted_postings(s: SparkSession, d: str) -> DataFrame:
    p = _postings(s, d)
    return O.faceted(p, _values(), CHOSEN, F.col("rank"), F.col("hours"), "doc_id").select("doc_id", "rank")


def posting_ages(s: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    own = lambda wanted: A.of_age(F.col("closed"), F.col("hours"), F.col("is_new"), F.col("label"), wanted, now)
    return _postings(s, d).select("doc_id", *[own(w).alias(f"in_{w}") for w in A.AGES], own(None).alias("in_all"))


def part_facets(s: SparkSession, d: str) -> DataFrame:
    band = lambda c, step: F.concat((F.floor(F.col(c) / step) * step).cast("long").cast("string"), F.lit("-"), (F.floor(F.col(c) / step) * step + step - 1).cast("long").cast("string"))
    values = {"brand": F.array("p_brand"), "kind": F.array("p_type"), "size": F.array(band("p_size", 10)), "price": F.array(band("p_retailprice", 100))}
    return O.facet_counts(table(s, d, "part"), values, PART_CHOSEN)


def _list(values) -> str:
    return "CAST([" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "] AS VARCHAR[])"


def _signs(signs: dict) -> str:
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({w}, '{x}')" for w, x in places) + f" THEN '{name}' END" for name, places in signs.items()) + "], lambda x: x IS NOT NULL)"


_P = f"""p AS (SELECT doc_id, lower(coalesce({_list(TITLES)}[doc_id % {len(TITLES)} + 1], '')) AS t, lower(concat_ws(' ', text, {_list(NOTES)}[doc_id % {len(NOTES)} + 1])) AS d, lower(coalesce(source, '')) AS c, lower(coalesce(lang, '')) AS l,
    doc_id % 4 > 0 AS mail, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 13 % 2500)::DOUBLE END AS hours, doc_id % 101 AS rank, lower(trim(coalesce({_list(LABELS)}[doc_id % {len(LABELS)} + 1], ''))) AS s,
    coalesce(CASE WHEN doc_id % 17 = 0 THEN doc_id % 2 = 0 END, false) AS closed, doc_id % 23 = 0 AS is_new FROM documents),
    w AS (SELECT *, doc_id % 10 = 3 OR contains(l, 'remote') OR contains(d, 'à distance') OR contains(d, 'remote') AS far, contains(l, 'hybrid') OR contains(d, 'hybrid') AS mixed FROM p),
    v AS (SELECT doc_id, hours, rank, closed, {_signs(A.LEVELS)} AS experience, list_filter([CASE WHEN far THEN 'remote' END, CASE WHEN mixed THEN 'hybrid' END, CASE WHEN NOT far AND NOT mixed THEN 'onsite' END], lambda x: x IS NOT NULL) AS workplace, {_signs(A.KINDS)} AS type,
        list_filter({_list(OFFERED['company'])}, lambda x: contains(c, lower(x))) AS company, list_filter({_list(OFFERED['sector'])}, lambda x: contains(d, lower(x)) OR contains(t, lower(x))) AS sector,
        list_filter({_list(OFFERED['function'])}, lambda x: contains(d, lower(x)) OR contains(t, lower(x))) AS function, list_filter({_list(OFFERED['title'])}, lambda x: contains(t, lower(x))) AS title, list_filter({_list(OFFERED['commitment'])}, lambda x: contains(d, lower(x))) AS commitment,
        CASE WHEN mail THEN ['yes'] ELSE [] END AS verified, CASE WHEN mail OR doc_id % 6 = 1 THEN ['yes'] ELSE [] END AS easy, CASE WHEN doc_id % 9 = 0 OR {' OR '.join(f"contains(d, '{x}')" for x in A.ABROAD)} THEN ['yes'] ELSE [] END AS abroad FROM w)"""


def _ok(chosen: dict, but: str = "") -> str:
    return " AND ".join(["true", *[f"list_has_any({f}, {_list(w)})" for f, w in chosen.items() if w and f != but]])


def _counts(chosen: dict, facets: list[str], source: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS facet, value, count(*) AS n FROM (SELECT unnest({f}) AS value FROM {source} WHERE {where} AND {_ok(chosen, f)}) GROUP BY value" for f in facets)


_FACETS = ["experience", "workplace", "type", "company", "sector", "function", "title", "commitment", "verified", "easy", "abroad"]
_N = "TRY_CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT)"


def _aged(wanted: str) -> str:
    most, short = A.AGES[wanted], wanted in A.SHORT_AGES
    days, grace = {"24h": 1, "week": 7, "month": 30}.get(wanted, -1), {"24h": 36.0}.get(wanted, most + 0.5 if short else most)
    return f"""NOT closed AND CASE WHEN hours IS NOT NULL THEN hours <= {most} WHEN {wanted == '24h'} AND is_new THEN true WHEN s IN ('', 'recently', 'n/a') OR s LIKE '%year%' THEN false
        WHEN s LIKE '%month%' OR s LIKE '%mois%' THEN {wanted == 'month'} AND s = 'un mois' WHEN s LIKE '%week%' OR s = '3w' THEN {wanted in ('week', 'month')} AND (s = 'a week ago' OR {wanted == 'month'} AND {_N} <= 4)
        WHEN s LIKE '%days%' OR s LIKE '%jours%' THEN {_N} <= {days} WHEN s LIKE '%hours%' OR s LIKE '%heures%' THEN {not short} OR {_N} <= {most} WHEN s IN ('just now', '5 min ago') THEN true WHEN s IN ('yesterday', 'today') THEN {wanted not in ('1h', '3h', '6h')}
        ELSE coalesce(epoch(TIMESTAMP '{NOW}') - epoch(TRY_CAST(s AS TIMESTAMP)) <= {grace * 3600}, false) END"""


_BAND = "CAST(floor({c} / {s}) * {s} AS BIGINT) || '-' || CAST(floor({c} / {s}) * {s} + {t} AS BIGINT)"
SQL = {
    "posting_facets": f"WITH {_P}, a AS (SELECT * FROM v WHERE NOT closed AND NOT coalesce(hours > {A.MOST_HOURS}, false)) " + _counts(CHOSEN, _FACETS, "a"),
    "faceted_postings": f"WITH {_P} SELECT doc_id, rank FROM v WHERE {_ok(CHOSEN)}",
    "posting_ages": f"WITH {_P} SELECT doc_id, " + ", ".join(f"{_aged(w)} AS in_{w}" for w in A.AGES) + f", NOT closed AND NOT coalesce(hours > {A.MOST_HOURS}, false) AS in_all FROM p",
    "part_facets": f"WITH v AS (SELECT [p_brand] AS brand, [p_type] AS kind, [{_BAND.format(c='p_size', s=10, t=9)}] AS size, [{_BAND.format(c='p_retailprice', s=100, t=99)}] AS price FROM part) " + _counts(PART_CHOSEN, ["brand", "kind", "size", "price"], "v"),
}
QUERIES = {name: globals()[name] for name in SQL}
