"""Conversations as replies to applications, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import mail as M
from tarnwick.operators import inbox as I
from tarnwick.session import shared_path, table
from tarnwick.streaming import events as streams
from tarnwick.streaming import inbox as live

#: What conversations say besides their own words, by a number made of their id and turn; None leaves them as they are.
SAID = (
    "We are pleased to offer you the role", "We regret to inform you", "Would you be available for a call", "Thank you for applying", "I am out of the office", "Earn money fast", "Please visit our careers page to apply", None,
    "We will schedule a quick call if you are shortlisted", "Join at https://meet.google.com/abc-defg-hij today", "Malheureusement le poste est pourvu", "Earn money, we have received your application", "Should you be selected we would like to offer you more",
    "Nothing new\nOn Monday Ann Lee wrote: we regret to inform you", "Hello\n> we regret to inform you\nwe get back to you", "Wir haben Ihre Bewerbung erhalten", "The position has been filled", "Let's schedule a phone screen", None,
    "Ok\n-----Original Message-----\noffer letter", "See acme.zoom.us and https://acme.zoom.us/j/12345?pwd=a, please", "Your file is under review now",
)
ABOUT = ("Re: [EXT] Application for cook", "Fwd: Interview on Monday", "Automatic reply: away", "Application received, interview later", None, "Invitation: talk", "Re: your mail")
WAS = ("review", "rejected", "interview", None)
STATUSES = ("applied", "rejected", "offer", "review", "accepted", None)
BATCHES = 4


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: tuple, n) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def replies(s: SparkSession, d: str) -> DataFrame:
    """Each turn as a reply about its conversation's application; every sixth comes again a day later under another id, and times of some are a minute apart."""
    c, h = table(s, d, "conversations"), F.col("conv_id") * 31 + F.col("turn") * 17
    body = F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit(" "), _pick(SAID, h), F.lit(".")), F.lit("")))
    seconds = F.col("conv_id") % 50 * 86400 + F.col("turn") * F.when(F.col("conv_id") % 3 == 0, 60).otherwise(7200)
    rows = c.select(
        F.col("conv_id").alias("app"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.timestamp_seconds(F.lit(1704067200) + seconds).alias("ts"), F.concat("role", F.lit("@firm.example")).alias("sender"),
        _pick(ABOUT, F.col("conv_id") + F.floor(F.col("turn") / 3)).alias("subject"), body.alias("body"), _pick(STATUSES, F.col("conv_id")).alias("cur"), (F.col("conv_id") % 4 == 1).alias("soft"), _pick(WAS, h).alias("was"), h.alias("h"),
    )
    again = rows.where("h % 6 = 0").withColumns({"seq": -F.col("seq") - 1, "ts": F.expr("ts + INTERVAL 1 DAY")})
    return rows.unionByName(again).drop("h")


def reply_intents(s: SparkSession, d: str) -> DataFrame:
    return I.classified(replies(s, d)).select("seq", "intent", "evidence", F.md5("own").alias("own"))


def inbox_sync(s: SparkSession, d: str) -> DataFrame:
    return I.synced(I.classified(replies(s, d)), "app", "ts", "seq", "sender", "subject", "cur", "soft")


def inbox_stream(s: SparkSession, d: str) -> DataFrame:
    """The same from a stream: the replies land in several parts, in no order of their times, and part of them twice."""
    path, rows = shared_path(s, "inbox"), replies(s, d)
    for n in range(BATCHES):
        part = F.pmod(F.xxhash64("seq"), F.lit(BATCHES))
        # An application's replies of a part lie in one file, so that the batches of a part each take their own applications and none is told again for every batch.
        rows.where((part == n) | ((part == n - 1) & (F.col("seq") % 5 == 0))).repartition("app").write.parquet(f"{path}/part={n}")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/part=*")
    told = live.inbox(I.classified(stream), "app", "ts", "seq", "sender", "subject", "cur", "soft", late="400 days")
    return live.latest(streams.drained(told, "update"), "app").drop("n_late", "n_read")


def inbox_reconciled(s: SparkSession, d: str) -> DataFrame:
    return I.reconciled(I.classified(replies(s, d)), "app", "ts", "seq", "was", "intent", "cur")


def _has(text: str, phrases: tuple) -> str:
    return f"list_extract(list_filter({_list(phrases)}, lambda p: contains({text}, p)), 1)"


_PLAIN_QUOTES = [p.replace("{2,}+", "{2,}") for p in M.QUOTE_STARTS]
_CUT = "least(length(b), " + ", ".join(f"CASE WHEN length(string_split_regex(b, '{p.replace(chr(39), chr(39) * 2)}')[1]) = 0 THEN length(b) ELSE length(string_split_regex(b, '{p.replace(chr(39), chr(39) * 2)}')[1]) END" for p in _PLAIN_QUOTES) + ")"
def _link(x: str) -> str:
    """SQL of the first link to a meeting in x, by kind."""
    one = lambda p, bare: f"nullif({bare and chr(39) + 'https://' + chr(39) + ' || '}regexp_replace(regexp_extract({x}, '{p.replace(chr(39), chr(39) * 2)}'), '[.,;:]+$', ''), '{bare and 'https://'}')"
    return "coalesce(" + ", ".join(one(p, p.startswith(r"\b") and "bare" or "") for p in M.MEETINGS) + ")"


_REPLIES = rf"""WITH RECURSIVE c AS (SELECT *, conv_id * 31 + turn * 17 AS h FROM conversations),
    r AS (SELECT conv_id AS app, conv_id * 1000 + turn AS seq, 1704067200 + conv_id % 50 * 86400 + turn * CASE WHEN conv_id % 3 = 0 THEN 60 ELSE 7200 END AS ts, role || '@firm.example' AS sender,
        {_list(ABOUT)}[(conv_id + turn // 3) % {len(ABOUT)} + 1] AS subject, coalesce(text, '') || coalesce(' ' || {_list(SAID)}[h % {len(SAID)} + 1] || '.', '') AS b, {_list(STATUSES)}[conv_id % {len(STATUSES)} + 1] AS cur, conv_id % 4 = 1 AS soft,
        {_list(WAS)}[h % {len(WAS)} + 1] AS was, h FROM c),
    a AS (SELECT * FROM r UNION ALL SELECT app, -seq - 1, ts + 86400, sender, subject, b, cur, soft, was, h FROM r WHERE h % 6 = 0),
    o AS (SELECT *, regexp_replace(array_to_string(list_filter(string_split(b[1:{_CUT}], chr(10)), lambda x: NOT starts_with(ltrim(x), '>')), chr(10)), '^\s+|\s+$', '', 'g') AS own, lower(coalesce(subject, '')) AS s FROM a),
    m AS (SELECT *, lower(regexp_replace(replace(own, chr(160), ' '), '\s+', ' ', 'g')) AS t FROM o),
    u AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: NOT (regexp_matches(x, '{M.CONDITIONS}') AND regexp_matches(x, '{M.DEPENDENT}'))), ' ') AS sure FROM m),
    p AS (SELECT *, coalesce({_has('s', M.AWAY_SUBJECT)}, {_has('t', M.AWAY)}) AS e1, CASE WHEN {_has('t', M.REVIEW[: M.RECEIPTS])} IS NULL THEN {_has('t', M.MARKETING)} END AS e2, {_has('sure', M.OFFER)} AS e3, {_has('t', M.REJECTION)} AS e4,
        coalesce({_link('own')}, {_link("coalesce(subject, '')")}, CASE WHEN {_has('s', M.POLITE)} IS NULL THEN {_has('s', M.INVITING)} END, {_has('sure', M.INTERVIEW)}) AS e5,
        coalesce({_has('t', M.PORTAL)}, {_has('t', M.REVIEW)}, {_has('s', M.REVIEW)}) AS e6 FROM u),
    i AS (SELECT *, CASE WHEN e1 IS NOT NULL THEN 'auto_reply' WHEN e2 IS NOT NULL THEN 'ignore' WHEN e3 IS NOT NULL THEN 'offer' WHEN e4 IS NOT NULL THEN 'rejected' WHEN e5 IS NOT NULL THEN 'interview' WHEN e6 IS NOT NULL THEN 'review' END AS intent FROM p)"""
_SYNC = f"""{_REPLIES},
    k AS (SELECT *, trim(own[1:{I.SAME_START}]) AS begin, row_number() OVER (PARTITION BY app ORDER BY ts, seq) AS n FROM i WHERE intent IN ('rejected', 'review', 'interview', 'offer', 'auto_reply')),
    w AS (
        SELECT app, 0::BIGINT AS n, coalesce(any_value(cur), 'applied') AS status, bool_or(soft) AS soft, 0::BIGINT AS fresh, 0::BIGINT AS copies, 0::BIGINT AS away, CAST([] AS STRUCT(w VARCHAR, ts BIGINT, b VARCHAR, f BOOLEAN)[]) AS seen FROM k GROUP BY app
        UNION ALL
        SELECT app, n, CASE WHEN NOT f OR status = 'accepted' OR intent = 'auto_reply' THEN status WHEN intent = 'offer' THEN 'offer' WHEN intent = 'rejected' THEN CASE WHEN status = 'offer' THEN status ELSE 'rejected' END
                WHEN intent = 'interview' THEN CASE WHEN status = 'offer' OR (status = 'rejected' AND NOT soft) THEN status ELSE 'interview' END
                WHEN status IN ('applied', 'sent', 'saved') OR (status = 'rejected' AND soft) THEN 'review' ELSE status END,
            soft AND NOT (f AND intent = 'rejected' AND status NOT IN ('offer', 'rejected', 'accepted')),
            fresh + (f AND intent <> 'auto_reply')::BIGINT, copies + (NOT f)::BIGINT, away + (f AND intent = 'auto_reply')::BIGINT, list_append(seen, {{'w': who, 'ts': ts, 'b': begin, 'f': f}})
        FROM (SELECT w.app, k.n, w.status, w.soft, w.fresh, w.copies, w.away, w.seen, k.intent, k.ts, k.begin, k.sender || '/' || coalesce(k.subject, chr(0)) AS who,
                len(list_filter(w.seen, lambda x: x.w = k.sender || '/' || coalesce(k.subject, chr(0)) AND ((x.f AND x.b = k.begin) OR k.ts - x.ts < {I.SAME_WITHIN_S}))) = 0 AS f
            FROM w JOIN k ON k.app = w.app AND k.n = w.n + 1)
    )
    SELECT app, status, fresh AS n_fresh, copies AS n_copies, away AS n_away FROM w QUALIFY row_number() OVER (PARTITION BY app ORDER BY n DESC) = 1"""
SQL = {
    "reply_intents": f"{_REPLIES} SELECT seq, intent, coalesce(e1, e2, e3, e4, e5, e6) AS evidence, md5(own) AS own FROM i",
    "inbox_sync": _SYNC,
    "inbox_stream": _SYNC,
    "inbox_reconciled": f"""{_REPLIES}, l AS (SELECT * FROM i WHERE intent IN ('rejected', 'review', 'interview', 'offer') QUALIFY row_number() OVER (PARTITION BY app ORDER BY ts DESC, seq DESC) = 1),
        f AS (SELECT *, coalesce(cur = was AND was <> intent AND cur NOT IN ('offer', 'accepted'), false) AS fixed FROM l) SELECT app, CASE WHEN fixed THEN intent ELSE cur END AS status, fixed FROM f""",
}
QUERIES = {name: globals()[name] for name in SQL}
