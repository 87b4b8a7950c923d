"""Phrases and tools in documents, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import phrases as P
from tarnwick.operators import phrases as O
from tarnwick.session import table

#: Sentences that stand behind every document by its id's remainder, besides its own words; tools that are known; a CV.
DUTIES = (
    "Design scalable ETL pipelines and data models; maintain data quality. Strong experience of customer inquiries", "You will build REST APIs for the data models with Zendesk and ServiceNow, using ITIL. Bachelor degree in data science",
    "Nous cherchons un chef de cuisine, data models, 5+ years of work", "We use GitLab CI/CD, and Python 3 (Salesforce too). Support the mobile teams of engineers", "",
)
TOOLS, SPELLED, CV, TITLE, COMPANY = ("python", "etl", "rest"), {"python": "Python"}, "I know Zendesk, c++ and gitlab-runner", "Data Scientist", "Salesforce"


def _text() -> Column:
    return F.concat_ws("\n", F.get(F.array(*map(F.lit, DUTIES)), (F.col("doc_id") % len(DUTIES)).cast("int")), "text")


def _counts(s: SparkSession, d: str) -> DataFrame:
    return O.phrase_counts(table(s, d, "documents"), "doc_id", _text(), F.lit(TITLE), TOOLS, ("of customer inquiries",))


def key_phrases(s: SparkSession, d: str) -> DataFrame:
    return O.key_phrases(_counts(s, d), "doc_id", spelled=SPELLED)


def phrase_spread(s: SparkSession, d: str) -> DataFrame:
    return O.phrase_spread(_counts(s, d))


def named_tools(s: SparkSession, d: str) -> DataFrame:
    tools = P.named_tools(_text(), F.lit(CV), F.lit(TITLE), F.lit(COMPANY))
    return table(s, d, "documents").select("doc_id", F.array_join(tools, "|").alias("tools"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PY = lambda p: p.replace("*+", "*").replace("++", "+").replace("'", "''")
_DOC = f"d AS (SELECT doc_id, concat_ws(chr(10), {_list(DUTIES)}[doc_id % {len(DUTIES)} + 1], text) AS t FROM documents)"
_BREAKS = [w for w in P.STOP if w not in ("of", "de")]
#: Words between clauses, as wholes: every word stands between two marks then.
_SPLITS = _PY(P.CLAUSES).replace(r"\b", "#").replace("#and#", "\x02and\x03").replace("#or#", "\x02or\x03").replace("#et#", "\x02et\x03").replace("#ou#", "\x02ou\x03")
_RUNS = rf"""{_DOC}, c AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(t, '([\p{{L}}\p{{N}}_]+)', chr(2) || '\1' || chr(3), 'g'), '{_SPLITS}'), lambda x, i: (i, translate(x, chr(2) || chr(3), ''))), lambda x: NOT regexp_matches(x[2], '{_PY(P.DEGREES)}'))) AS x FROM d),
    m AS (SELECT doc_id, x[1] AS no, array_to_string(list_transform(regexp_extract_all(x[2], '{_PY(P.WORD)}'), lambda w: CASE WHEN list_contains({_list(_BREAKS)}, lower(w)) THEN chr(1) || w ELSE w END), ' ') AS m FROM c),
    r AS (SELECT doc_id, no, unnest(list_transform(regexp_extract_all(m, '(\x01?[^\x01]*)(?:\x01[^ \x01]* ?)?', 1), lambda y, i: (i, y))) AS y FROM m),
    w AS (SELECT doc_id, no, y[1] AS k, list_filter(string_split(replace(y[2], chr(1), ''), ' '), lambda z: z <> '')[-{P.LONGEST}:] AS w FROM r WHERE y[2] <> ''),
    f AS (SELECT *, list_position(list_transform(w, lambda z: list_contains({_list([*P.STOP, *P.VERBS])}, lower(z))), false) AS a, list_position(list_transform(list_reverse(w), lambda z: list_contains({_list(P.STOP)}, lower(z))), false) AS b FROM w),
    p AS (SELECT doc_id, no, k, w[a : len(w) - b + 1] AS w FROM f WHERE a > 0 AND b > 0), l AS (SELECT *, list_transform(w, lambda z: lower(z)) AS low, array_to_string(list_transform(w, lambda z: lower(z)), ' ') AS phrase FROM p WHERE len(w) >= 2),
    t AS (SELECT * FROM l WHERE NOT list_has_any(low, {_list(P.PEOPLE)}) AND NOT list_has_all({_list(TOOLS)}, low) AND NOT list_contains({_list(TOOLS)}, phrase) AND NOT list_has_all({_list(P.LANGUAGES)}, low)
        AND NOT list_has_all({_list(TITLE.lower().split())}, low) AND NOT regexp_matches(low[1], '^[0-9]+\+?$') AND phrase <> 'of customer inquiries'),
    n AS (SELECT doc_id, phrase, count(*) AS n, min((no, k)) AS place, arg_min(w, (no, k)) AS w FROM t GROUP BY 1, 2)"""
_SHOWN = f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in ({w: w.upper() for w in P.SHORT_FORMS} | P.SPELLED | SPELLED).items())}}}"
SQL = {
    "key_phrases": f"""WITH RECURSIVE {_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS pos FROM n),
        g AS (SELECT doc_id, 0::BIGINT AS pos, CAST([] AS VARCHAR[]) AS kept, CAST([] AS VARCHAR[][]) AS words FROM d
            UNION ALL SELECT doc_id, nat, CASE WHEN ok THEN list_append(kept, phrase) ELSE kept END, CASE WHEN ok THEN list_append(words, w) ELSE words END
            FROM (SELECT g.*, o.phrase, o.w, o.pos AS nat, len(list_filter(g.kept, lambda x: contains(x, o.phrase) OR contains(o.phrase, x))) = 0 AS ok FROM g JOIN o ON o.doc_id = g.doc_id AND o.pos = g.pos + 1 WHERE len(g.kept) < 10) q),
        e AS (SELECT doc_id, kept, words FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1), u AS (SELECT doc_id, unnest(list_transform(kept, lambda x, i: (i, x, words[i]))) AS x FROM e)
        SELECT doc_id, CAST(x[1] AS INTEGER) AS rank, x[2] AS phrase, array_to_string(list_transform(x[3], lambda z: coalesce({_SHOWN}[lower(z)], CASE WHEN z = lower(z) THEN CASE WHEN z[1] = 'ß' THEN 'Ss' ELSE upper(z[1]) END || z[2:] ELSE z END)), ' ') AS shown FROM u""",
    "phrase_spread": f"WITH {_RUNS} SELECT phrase, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1 HAVING count(*) >= 2",
    "named_tools": rf"""WITH {_DOC}, g AS (SELECT doc_id, regexp_extract_all(t, '{_PY(P.NAME)}') AS names, string_split_regex(t, '{_PY(P.NAME)}') AS gaps FROM d),
        x AS (SELECT doc_id, unnest(list_transform(names, lambda w, i: (i, w, regexp_replace(gaps[i], '[ \t\r\n\x0b\x0c]+$', '')))) AS x FROM g),
        f AS (SELECT doc_id, x[1] AS no, x[2] AS w, lower(x[2]) AS low, CASE WHEN x[3] = '' THEN x[1] = 1 ELSE contains('{P.BEGINS}', x[3][-1]) END AS begins FROM x),
        k AS (SELECT * FROM f WHERE (regexp_matches(w, '[a-z][A-Z]') OR regexp_matches(w, '^[A-Z]{{2,6}}$') OR (regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '[a-z]') AND NOT regexp_matches(w[2:], '[A-Z]') AND NOT begins))
            AND length(w) > 1 AND NOT list_contains({_list([*P.NO_TOOLS, *P.STOP, *P.LANGUAGES, *TITLE.lower().split(), COMPANY.lower(), 'it', 'hr', 'ok', 'zendesk', 'gitlab', 'know'])}, low)),
        q AS (SELECT doc_id, low, min(no) AS no, arg_min(w, no) AS w FROM k GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS r FROM q)
        SELECT doc_id, coalesce(string_agg(w, '|' ORDER BY no) FILTER (r <= 8), '') AS tools FROM d LEFT JOIN s USING (doc_id) GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
