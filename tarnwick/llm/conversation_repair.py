"""Repair of conversations: roles and faults as signatures, the cheapest edits of each distinct one, replayed over its conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import WORD, batches_of, cut

#: What has been said so far: nothing, a system turn, a user's turn, an assistant's turn. From each the next turn is one of these two only.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT, _ROLE = (USER, USER, ASSISTANT, USER), {USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits, and of leaving a truncated turn; the edits that complete a conversation that ends in each state.
REROLE, DELETE, INSERT, LEFT = 3, 4, 3, 3
_ENDING = ("", "II", "I", "")
_INITIAL = {USER: "u", ASSISTANT: "a"}
_FAR = 1 << 40


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with a fault in some rows, by crc32(`conv:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes `[.!?]` from it,
    3 repeats it, 4 makes its role user. Null roles and texts, and null ids and turns inside the sum, are one space; null ids and turns stay null in the rows."""
    blank = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank)).cast("binary")) % 20
    rows = df.select(F.col(conv), F.col(turn), F.coalesce(F.col(role), blank).alias(role), F.coalesce(F.col(text), blank).alias(text), code.alias("code_")).where("code_ <> 0")
    rows = rows.withColumn("copy_", F.explode(F.when(F.col("code_") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    what = F.when(F.col("code_") == 1, F.lit("")).when(F.col("code_") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    return rows.select(conv, turn, F.when(F.col("code_") == 4, F.lit("user")).otherwise(F.col(role)).alias(role), what.alias(text))


def faults(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df's rows with `place` (from 1, by turn, nulls first, ties by role and text), `fault` (blank, duplicate, truncated or null; the first that holds) and `pair_` (initials of the turn before and of this one).

    Blank has nothing but white space, a duplicate has role and text of an earlier row, a truncated one does not end in `.`, `!` or `?`, white space aside.
    Two windows over one shuffle; none holds more than a row.
    """
    order = [F.asc_nulls_first(turn), F.col(role), F.col(text)]
    line = Window.partitionBy(conv).orderBy(*order)
    alike = Window.partitionBy(conv, role, text).orderBy(F.col("place"))
    rows = df.select(conv, turn, role, text).withColumn("place", F.row_number().over(line))
    rows = rows.withColumn("pair_", F.concat(F.lag(F.substring(role, 1, 1)).over(line), F.substring(role, 1, 1)))
    last = F.substring(F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = (
        F.when(~F.col(text).rlike(WORD), F.lit("blank"))
        .when(F.row_number().over(alike) > 1, F.lit("duplicate"))
        .when(~last.isin(".", "!", "?"), F.lit("truncated"))
    )
    return rows.withColumn("fault", fault)


def symbol(role: Column, fault: Column) -> Column:
    """One ASCII letter for what matters to the edits: d if the row must go, else s, u, a or x for its role, in capitals if it is truncated."""
    first = F.substring(role, 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))
    return F.when(fault.isin("blank", "duplicate"), F.lit("d")).when(fault == "truncated", F.upper(letter)).otherwise(letter)


def _step(letter: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, next state) for a row in this state, in the order of ASCII. Inserts come before rows and are left to the callers."""
    edits = [("D", DELETE, state)]
    kind, extra = letter.lower(), LEFT if letter.isupper() else 0
    if kind == "s" and state == START:
        edits.append(("K", extra, SYSTEM))
    elif kind == _INITIAL[_NEXT[state]]:
        edits.append(("K", extra, _NEXT[state]))
    if kind != "d":
        edits.append(("R", REROLE + extra, _NEXT[state]))
    return tuple(edits)


@lru_cache(maxsize=100_000)
def spans(signature: str) -> tuple[tuple[int, ...], ...]:
    """Least costs from each state before these rows to each state after them, recursively from halves. No inserts stand behind the last row."""
    if len(signature) > 1:
        left, right = _halves(signature)
        a, b = spans(left), spans(right)
        return tuple(tuple(min(a[s][m] + b[m][t] for m in range(4)) for t in range(4)) for s in range(4))
    out = []
    for state in range(4):
        row, at, paid = [_FAR] * 4, state, 0
        for _ in range(3):  # at most two inserts are ever of use before a row
            for _, cost, then in _step(signature, at):
                row[then] = min(row[then], paid + cost)
            at, paid = _NEXT[at], paid + INSERT
        out.append(tuple(row))
    return tuple(out)


def _halves(signature: str) -> tuple[str, str]:
    """Cut at the largest power of two below the length, so that long signatures share their parts."""
    at = 1 << (len(signature) - 1).bit_length() - 1
    return signature[:at], signature[at:]


def _before(signature: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(c + d for c, d in zip(row, after, strict=True)) for row in spans(signature))


@lru_cache(maxsize=100_000)
def walk(signature: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The cheapest edits (ASCII-least on ties) from this state, where `after` are the costs still to pay from each state behind, and the state that they end in.

    Each edit leads to one place and state, so taking the least letter that stays cheapest gives the least string.
    """
    if len(signature) > 1:
        left, right = _halves(signature)
        middle = _before(right, after)
        low = min(middle)
        edits, at = walk(left, state, tuple(x - low for x in middle))
        more, end = walk(right, at, after)
        return edits + more, end
    edits = ""
    while True:
        due = _before(signature, after)[state]
        options = {e: (c, t) for e, c, t in _step(signature, state)}
        if "D" in options and options["D"][0] + after[state] == due:
            return edits + "D", state
        if INSERT + _before(signature, after)[_NEXT[state]] == due:
            edits, state = edits + "I", _NEXT[state]
            continue
        for e in "KR":
            if e in options and options[e][0] + after[options[e][1]] == due:
                return edits + e, options[e][1]


@cache
def _last() -> tuple[int, ...]:
    return tuple(INSERT * len(e) for e in _ENDING)


def cheapest(signature: str) -> tuple[int, str]:
    """(cost, audit) of a signature."""
    if not signature:
        return 0, ""
    edits, end = walk(signature, START, _last())
    return _before(signature, _last())[START], edits + _ENDING[end]


def signatures(rows: DataFrame, conv: str) -> DataFrame:
    """(conv, signature) from (conv, place, letter): sorted rows are streamed, so that a conversation costs a byte a turn."""
    schema = f"{conv} {rows.schema[conv].dataType.simpleString()}, signature string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, kind = None, [], None
        for batch in batches:
            kind, keys, letters = batch.column(0).type, batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else key) or (i == 0 and not parts)]
            done: list[tuple] = []
            at = 0
            for i in first:
                parts.append("".join(letters[at:i]))
                if any(parts):
                    done.append((key, "".join(parts)))
                key, parts, at = keys[i], [], i
            parts.append("".join(letters[at:]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([s for _, s in done])], [conv, "signature"])
        if any(parts):
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array(["".join(parts)])], [conv, "signature"])

    return rows.repartition(conv).sortWithinPartitions(conv, "place").select(conv, "letter").mapInArrow(joined, schema)


def solved(signature: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature, each solved once."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [cheapest(s) for s in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found])], ["signature", "cost", "audit"])

    return signature.select("signature").distinct().mapInArrow(solve, "signature string, cost long, audit string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of df, and its repaired rows (conv, place, edit, role, text).

    Roles must become `(s?(ua)+)?` by their initials. Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user's or assistant's turn 3;
    a truncated turn that stays adds 3; blank and duplicate turns must go. The audit is the initials of the cheapest edits in order, the ASCII-least of equally
    cheap ones. gaps is the turns missing between the least and the greatest, nulls ignored; illegal counts neighbours whose initials are not su, ua or au.

    Each distinct signature is solved once and joined back; a third of all conversations may share one, which
    Spark's adaptive joins broadcast or split. Rows are then replayed as a stream in order, so a conversation of any length takes a byte a turn besides the rows at
    hand. Nulls in role or text count as given (a null role can't be kept and a null text is blank), a null id is one conversation, turns that are null come first; ties are ordered
    by role and text; repeated rows are duplicates; an empty table gives empty results; other columns are not looked at. Texts are compared and streamed whole.
    """
    given = df.select(F.col(conv), F.col(turn), F.coalesce(F.col(role), F.lit(" ")).alias(role), F.coalesce(F.col(text), F.lit(" ")).alias(text))
    rows = cut(faults(given, conv, turn, role, text))
    count = lambda c: F.count_if(c).cast("long")
    turns = rows.groupBy(conv).agg(
        F.coalesce((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).cast("long"), F.lit(0)).alias("gaps"),
        *[count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        count(~F.col("pair_").isin("su", "ua", "au")).alias("illegal"),
    )
    own = cut(signatures(rows.select(conv, "place", symbol(F.col(role), F.col("fault")).alias("letter")), conv))
    audits = cut(own.join(solved(own), "signature").select(conv, "cost", "audit"))
    report = turns.join(audits.withColumnRenamed(conv, "conv_"), F.col(conv).eqNullSafe(F.col("conv_"))).drop("conv_")
    return report, _replayed(rows, audits, conv, role, text)


def _replayed(rows: DataFrame, audits: DataFrame, conv: str, role: str, text: str) -> DataFrame:
    """The repaired rows: each conversation's audit stands before its rows in one sorted stream."""
    nothing = F.lit(None).cast("string")
    both = rows.select(conv, "place", F.col(role).alias("role_"), F.col(text).alias("text_")).unionByName(audits.select(conv, F.lit(0).alias("place"), F.col("audit").alias("role_"), nothing.alias("text_")))
    schema = f"{conv} {rows.schema[conv].dataType.simpleString()}, place long, edit string, {role} string, {text} string"

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, START, 0
        for batch in batches:
            keys, places, roles, texts = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for k, no, r, t in zip(keys, places, roles, texts, strict=True):
                if no == 0:
                    audit, at, state, place = r, 0, START, 0
                else:
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        state = SYSTEM if state == START and r[:1] == "s" else _NEXT[state]
                    elif edit == "R":
                        state = _NEXT[state]
                        r = _ROLE[state]
                    if edit != "D":
                        place += 1
                        out.append((k, place, edit, r, t))
                while at < len(audit) and audit[at] == "I":
                    state, at, place = _NEXT[state], at + 1, place + 1
                    out.append((k, place, "I", _ROLE[state], ""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], [conv, "place", "edit", role, text])

    return both.repartition(conv).sortWithinPartitions(conv, "place").mapInArrow(replay, schema)


def digests(repaired: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of `role:text` of its rows, joined by line feeds. The rows must be as repair() gives them, a conversation's together and in order."""
    schema = f"{conv} {repaired.schema[conv].dataType.simpleString()}, repaired_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, kind = None, None, None
        for batch in batches:
            kind = batch.column(0).type
            done: list[tuple] = []
            for k, no, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if no == 1:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(f"{r}:{t}".encode())
                else:
                    digest.update(f"\n{r}:{t}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done])], [conv, "repaired_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()])], [conv, "repaired_sha256"])

    return repaired.select(conv, "place", role, text).mapInArrow(hashed, schema)


def audited(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """repair() of the damaged rows of df with digests of the repaired conversations, for every id of df: zeros, an empty audit and the digest of nothing where no row is left."""
    with batches_of(df.sparkSession, 2_000):
        report, repaired = repair(damaged(df, conv), conv)
        found = cut(digests(repaired, conv))
    out = df.select(conv).distinct()
    for part, no in ((report, "report_"), (found, "found_")):
        out = out.join(part.withColumnRenamed(conv, no), F.col(conv).eqNullSafe(F.col(no)), "left").drop(no)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
