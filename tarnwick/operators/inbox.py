"""Replies in an inbox: what each says, which come twice, and where they take the application that they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import mail as M
from tarnwick.functions.text import let
from tarnwick.operators.entity import final_status

#: Replies that change an application, and those that are kept.
MEANINGFUL = ("rejected", "review", "interview", "offer")
KEPT = (*MEANINGFUL, "auto_reply")
#: A reply of the same sender and subject within so many seconds, or with the same first characters of its own text, is the same reply.
SAME_WITHIN_S, SAME_START = 120, 160


def reply(body: Column, subject: Column) -> Column:
    """(own, intent, evidence) of a reply: the newly written text; auto_reply, ignore, offer, rejected, interview, review or null; the phrase or link that says so.

    Only what the reply itself says counts, not the history below it. Absence comes first and marketing next (unless it also acknowledges); then an offer, a rejection, a link to a meeting, a subject that
    invites, words of an interview, the firm's portal, an acknowledgement. Conditional sentences promise neither offers nor interviews.
    """
    about = F.lower(F.coalesce(subject, F.lit("")))

    def judged(own: Column, flat: Column, sure: Column) -> Column:
        told = lambda text, phrases: M.first_phrase(text, phrases)
        steps = (
            ("auto_reply", F.coalesce(told(about, M.AWAY_SUBJECT), told(flat, M.AWAY))), ("ignore", F.when(told(flat, M.REVIEW[: M.RECEIPTS]).isNull(), told(flat, M.MARKETING))), ("offer", told(sure, M.OFFER)), ("rejected", told(flat, M.REJECTION)),
            ("interview", F.coalesce(M.meeting_link(own), M.meeting_link(F.coalesce(subject, F.lit(""))), F.when(told(about, M.POLITE).isNull(), told(about, M.INVITING)), told(sure, M.INTERVIEW))),
            ("review", F.coalesce(told(flat, M.PORTAL), told(flat, M.REVIEW), told(about, M.REVIEW))),
        )
        none = F.lit(None).cast("string")
        as_found = lambda name: lambda x: F.when(x.isNotNull(), F.struct(own.alias("own"), F.lit(name).alias("intent"), x.alias("evidence")))
        found = F.coalesce(*[let(e, as_found(name)) for name, e in steps])
        return F.coalesce(found, F.struct(own.alias("own"), none.alias("intent"), none.alias("evidence")))

    one_line = lambda own: F.lower(F.regexp_replace(F.translate(own, "\u00a0", " "), r"\s+", " "))
    return let(let(body, M.own_text), lambda own: let(one_line(own), lambda flat: let(M.unconditional(flat), lambda sure: judged(own, flat, sure))))


def classified(df: DataFrame, body: str = "body", subject: str = "subject") -> DataFrame:
    """df with `own`, `intent` and `evidence` of its replies, see reply()."""
    return df.withColumn("reply_", reply(F.col(body), F.col(subject))).select(*df.columns, "reply_.own", "reply_.intent", "reply_.evidence")


def fresh_replies(df: DataFrame, app: str, ts: str, seq: str, sender: str, subject: str, own: str, intent: str) -> DataFrame:
    """The kept replies of df with `fresh`: whether one is no copy of an earlier one of its application, sender and subject.

    A copy comes within SAME_WITHIN_S of the reply before it, or begins like an earlier one that was fresh. Of the replies that keep their distance only the first of each beginning can be fresh, so two windows
    tell. Rows with one `seq` are one message that was read twice.
    """
    rows = df.where(F.col(intent).isin(*KEPT)).dropDuplicates([seq])
    thread = [app, sender, subject]
    rows = rows.withColumn("begin_", F.trim(F.substring(own, 1, SAME_START)))
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(Window.partitionBy(*thread).orderBy(ts, seq))
    rows = rows.withColumn("apart_", F.coalesce(gap >= SAME_WITHIN_S * 1_000_000, F.lit(True)))
    first = F.row_number().over(Window.partitionBy(*thread, "begin_", "apart_").orderBy(ts, seq)) == 1
    return rows.withColumn("fresh", F.col("apart_") & first).drop("begin_", "apart_")


def synced(df: DataFrame, app: str, ts: str, seq: str, sender: str, subject: str, current: str, reopens: str) -> DataFrame:
    """(app, status, n_fresh, n_copies, n_away) from classified replies: the oldest first, so that the latest outcome wins.

    `current` is an application's status before (null: applied) and `reopens` whether a rejection was only a timeout. Statuses move as in final_status(). Applications without kept replies are not returned, nor are replies without an application.
    """
    rows = fresh_replies(df.where(F.col(app).isNotNull()), app, ts, seq, sender, subject, "own", "intent")
    counts = rows.groupBy(app).agg(
        F.count_if(F.col("fresh") & F.col("intent").isin(*MEANINGFUL)).alias("n_fresh"), F.count_if(~F.col("fresh")).alias("n_copies"), F.count_if(F.col("fresh") & (F.col("intent") == "auto_reply")).alias("n_away"),
    )
    moved = rows.withColumn("step_", F.when(F.col("fresh"), F.col("intent")))
    return final_status(moved, app, F.struct(ts, seq), "step_", current, reopens).join(counts, app).select(app, "status", "n_fresh", "n_copies", "n_away")


def reconciled(replies: DataFrame, app: str, ts: str, seq: str, stored: str, intent: str, current: str) -> DataFrame:
    """(app, status, fixed): statuses that an earlier analysis set are corrected by what the latest meaningful reply says now.

    `stored` is what a reply was taken for then. A status counts as the analysis's own if it still is what that reply set; offers and acceptances stay.
    """
    last = replies.where(F.col(intent).isin(*MEANINGFUL)).groupBy(app).agg(F.max_by(F.struct(F.col(stored).alias("then"), F.col(intent).alias("now"), F.col(current).alias("cur")), F.struct(ts, seq)).alias("x"))
    fixed = F.coalesce((F.col("x.cur") == F.col("x.then")) & (F.col("x.then") != F.col("x.now")) & ~F.col("x.cur").isin("offer", "accepted"), F.lit(False))
    return last.select(app, F.when(fixed, F.col("x.now")).otherwise(F.col("x.cur")).alias("status"), fixed.alias("fixed"))
