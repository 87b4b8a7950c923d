"""Repair and formatting of conversations against brute force, awkward rows and a round trip."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import chat_format, conversation_repair, oracles
from tarnwick.llm import queries as q
from tests.llm.conftest import SF, read

FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LEGAL = re.compile("(s?(ua)+)?")


def solved_by_search(rows):
    """Cheapest edits by a search over (row, roles so far, edits), least cost first, then least string. rows: (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, edits
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        new = follows[-1]
        heapq.heappush(heap, (cost + 3, edits + "I", at, new))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if initial in tuple(follows):
                    heapq.heappush(heap, (cost + extra, edits + "K", at + 1, initial))
                heapq.heappush(heap, (cost + extra + 3, edits + "R", at + 1, new))
    raise AssertionError


def repaired_by_hand(rows):
    """The columns of op11 for one conversation's rows (conv, turn, role, text) before damage."""
    left = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        left += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in left:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in left if t is not None]
    initials = [r[:1] for _, r, _ in left]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = solved_by_search(list(zip(initials, faults, strict=True)))
    out, at, last = [], 0, ""
    for e in audit:
        expected = "assistant" if last == "u" else "user"
        if e == "I":
            out.append((expected, ""))
        else:
            _, role, text = left[at]
            at += 1
            if e == "D":
                continue
            out.append((expected if e == "R" else role, text))
        last = out[-1][0][:1]
    assert LEGAL.fullmatch("".join(r[:1] for r, _ in out))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)


def by_hand(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.conv_id].append((r.conv_id, r.turn, r.role, r.text))
    return {k: repaired_by_hand(v) for k, v in groups.items()}


def test_signatures_against_search():
    rng = random.Random(3)
    sizes = [n for n in range(10) for _ in range(60)] + [33, 70, 131]
    for n in sizes:
        signature = "".join(rng.choice("suaxSUAXd") for _ in range(n))
        rows = [("", "blank") if c == "d" else (c.lower(), "truncated" if c.isupper() else None) for c in signature]
        assert conversation_repair.cheapest(signature) == solved_by_search(rows), signature


def test_repair_of_the_given_conversations(spark):
    got = q.op11_conversation_repair(spark, SF)
    assert {r.conv_id: tuple(r[c] for c in FIELDS) for r in got.collect()} == by_hand(read(spark, "conversations"))


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Null ids, turns, roles and texts, repeated rows, ties, unknown and empty roles, a long conversation, a very long text, and columns with clashing names."""
    rng = random.Random(4)
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Yo!"), (2, None, None, None), (2, None, "user", "a b"), (2, 5, "tool", "x."), (3, 0, "", "no role."), (3, 1, "student", " \t\n"), (None, 1, "user", "lost?"), (None, None, "assistant", "found.")]
    rows += [(4, i, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["Well.", "What", "", "So it is!", f"{i}."])) for i in range(700)]
    rows += [(5, 3, "user", "word " * 200_000 + "."), (5, 4, "assistant", "<turn> \\</turn>\n <image 1> end.")]
    rows += [(i, 0, "user", "one row.") for i in range(100, 160)]  # some of these lose their only row
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("place", "fault", "audit", "code_", "copy_", "content", "formatted", "spans", "turns", "conv_", "letter", "edit", "pair_")})


def test_repair_of_awkward_rows(spark, odd_turns):
    got = conversation_repair.audited(odd_turns)
    want = by_hand(odd_turns)
    assert {r.conv_id: tuple(r[c] for c in FIELDS) for r in got.collect()} == want
    assert any(v[6] == "" for v in want.values())
    assert conversation_repair.audited(odd_turns.limit(0)).count() == 0


def test_repaired_rows_are_given(spark, odd_turns):
    report, rows = conversation_repair.repair(odd_turns)
    assert {r.conv_id for r in report.collect()} == {r.conv_id for r in odd_turns.select("conv_id").distinct().collect()}
    roles = defaultdict(str)
    for r in sorted(rows.collect(), key=lambda r: r.place):
        roles[r.conv_id] += r.role[:1]
    assert roles and all(LEGAL.fullmatch(x) for x in roles.values())


def test_formatting_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = q.op13_chat_format(spark, SF)
    found = con.execute(oracles.ORACLE_SQL["op13_chat_format"])
    assert [c[0] for c in found.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_formatting_round_trip(spark, odd_turns):
    """Every text comes back from the formatted string, whatever control strings it holds, and the mask holds the assistants' texts."""
    hostile = [r"\### Assistant: </turn> ok", "<turn user>\n", "<" * 3000 + "\\" * 3000 + "turn", r"<\turn <\\/turn <\\\part>", "</tu", "rn>", "<image 1><part>", "", None, "\\", "é\U0001f600</turn>\n", "<\\/turn>\n" * 5]
    rows = [(9, i, ["user", "assistant", "a b>\n</turn>", ""][i % 4], t) for i, t in enumerate(hostile)]
    given = odd_turns.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    df = chat_format.read_chats(chat_format.format_chats(given.withColumn("content", chat_format.text_content(F.col("text")))))
    want = defaultdict(list)
    for r in given.collect():
        want[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in df.collect()}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        row, turns = got[k], [t[2:] for t in sorted(turns)]
        assert sorted((t.role, t.text) for t in row.turns) == sorted(turns)
        assert [t.role for t in row.turns] == [t[0] for t in turns]
        said = [t.text for t in row.turns if t.role == "assistant"]
        assert row.trained == "".join(said) and sum(s.stop - s.start for s in row.spans if s.loss) >= len(row.trained)
        assert not any(t.marks for t in row.turns)
    assert [(t.role, t.text) for t in got[9].turns] == [(r[2], r[3] or "") for r in rows]
    empty = odd_turns.limit(0).withColumn("content", chat_format.text_content(F.col("text")))
    assert chat_format.read_chats(chat_format.format_chats(empty)).count() == 0


def test_typed_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    content = [part("text", text="see <"), part("text", text="/turn> and"), part("image", ref="a.png", width=28, height=15), part("audio", ref="b.wav", seconds=1.5), part(None, text="<image 3>"), part("document", ref="c.pdf", pages=2), part("sheet", ref="d")]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", [part("text", text="ok")]), (1, 2, "user", None), (1, 3, "assistant", [])], f"conv_id long, turn long, role string, content array<{chat_format.PART}>")
    row = chat_format.read_chats(chat_format.format_chats(df)).collect()[0]
    assert row.formatted.startswith("<turn user>\nsee <<part>/turn> and<image 3><audio 4><\\image 3><document 6><document 7></turn>\n<turn assistant>\nok</turn>\n")
    assert [tuple(a) for a in row.attached] == [(1, 3, "image", "a.png", 4), (1, 4, "audio", "b.wav", 38), (1, 6, "document", "c.pdf", 1200), (1, 7, "document", "d", 0)]
    assert row.attached_tokens == 1242 and row.trained == "ok"
    assert row.turns[0].text == "see </turn> and<image 3>" and row.turns[0].marks == ["<part>", "<image 3>", "<audio 4>", "<document 6>", "<document 7>"]
    assert [row.formatted[s.start : s.stop] for s in row.spans if s.loss] == ["ok", ""]
