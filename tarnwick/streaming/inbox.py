"""The inbox as a stream: replies are put in the order of their times for each application, whatever order they come in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwick.operators.inbox import KEPT, MEANINGFUL, SAME_START, SAME_WITHIN_S


def moved(status: str, timeout: bool, intent: str) -> tuple[str, bool]:
    """The status after a reply, and whether a rejection still is only a timeout."""
    if status == "accepted" or intent not in MEANINGFUL:
        return status, timeout
    soft = status == "rejected" and timeout
    if intent == "offer":
        return "offer", False
    if intent == "rejected":
        return (status, timeout) if status in ("offer", "rejected") else ("rejected", False)
    if intent == "interview":
        return (status, timeout) if status == "offer" or (status == "rejected" and not soft) else ("interview", timeout)
    return ("review", timeout) if status in ("applied", "sent", "saved") or soft else (status, timeout)


def follow(at: dict, rows: list) -> dict:
    """The state of an application after more replies (time in microseconds, id, thread, beginning, intent) in the order of their times."""
    threads = {k: (t, set(seen)) for k, (t, seen) in at["threads"].items()}
    status, timeout, counts = at["status"], at["timeout"], list(at["counts"])
    for ts, _, thread, begin, intent in rows:
        last, seen = threads.get(thread, (None, set()))
        fresh = (last is None or ts - last >= SAME_WITHIN_S * 1_000_000) and begin not in seen
        if fresh:
            seen.add(begin)
            counts[0 if intent in MEANINGFUL else 2] += 1
            status, timeout = moved(status, timeout, intent)
        else:
            counts[1] += 1
        threads[thread] = (ts, seen)
    return {"status": status, "timeout": timeout, "counts": counts, "threads": {k: (t, sorted(seen)) for k, (t, seen) in threads.items()}}


def inbox(stream: DataFrame, app: str, ts: str, seq: str, sender: str, subject: str, current: str, reopens: str, late: str = "7 days") -> DataFrame:
    """Streaming twin of synced() over classified replies: (app, status, n_fresh, n_copies, n_away, n_late, n_read) of each application that a batch touches.

    Replies wait, as a few words each, until the watermark has passed their time, and are taken in the order of their times then; what is told in between follows
    from those that wait. So replies may come in any order within `late`, and a message that is read twice counts once. What comes after the watermark has passed it is
    counted in n_late and left to reconciled(). Of an application's rows the one with the largest n_read is the last.
    """
    kind = stream.schema[app].dataType.simpleString()
    rows = stream.where(F.col("intent").isin(*KEPT) & F.col(app).isNotNull()).withWatermark(ts, late).select(
        app, ts, F.col(seq).cast("string").alias("seq_"), F.xxhash64(sender, subject).cast("string").alias("thread_"), F.xxhash64(F.trim(F.substring("own", 1, SAME_START))).cast("string").alias("begin_"),
        "intent", F.coalesce(F.col(current), F.lit("applied")).alias("cur_"), F.coalesce(F.col(reopens), F.lit(False)).alias("soft_"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting, upto, n_late, n_read = (json.loads(state.get[0]), {r[1]: r for r in json.loads(state.get[1])}, *state.get[2:]) if state.exists else (None, {}, -(1 << 62), 0, 0)
        for frame in frames:
            stamps = frame[ts].to_numpy("datetime64[us]").astype("int64").tolist()
            for t, *rest, cur, soft in zip(stamps, frame["seq_"], frame["thread_"], frame["begin_"], frame["intent"], frame["cur_"], frame["soft_"], strict=True):
                held = held or {"status": cur, "timeout": bool(soft), "counts": [0, 0, 0], "threads": {}}
                n_read += 1
                if t < upto:
                    n_late += 1
                else:
                    waiting[rest[0]] = [t, *rest]
        mark = state.getCurrentWatermarkMs() * 1000
        upto = max(upto, mark)
        order = sorted(waiting.values(), key=lambda r: (r[0], len(r[1]), r[1]))
        due = [r for r in order if r[0] < upto]
        held, order = follow(held, due), order[len(due) :]
        state.update((json.dumps(held), json.dumps(order), upto, n_late, n_read))
        now = follow(held, order)
        yield pd.DataFrame({app: [key[0]], "status": [now["status"]], "n_fresh": [now["counts"][0]], "n_copies": [now["counts"][1]], "n_away": [now["counts"][2]], "n_late": [n_late], "n_read": [n_read]})

    out = f"{app} {kind}, status string, n_fresh long, n_copies long, n_away long, n_late long, n_read long"
    return rows.groupBy(app).applyInPandasWithState(step, out, "held string, waiting string, upto long, n_late long, n_read long", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, app: str) -> DataFrame:
    """The last row of each application among the updates of a stream."""
    names = [c for c in updates.columns if c != app]
    last = updates.groupBy(app).agg(F.max_by(F.struct(*names), "n_read").alias("x"))
    return last.select(app, "x.*")
