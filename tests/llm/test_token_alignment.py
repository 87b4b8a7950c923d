"""Alignment of tokenizers against sets of bytes, over whole texts encoded at once."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwick.llm import queries as q
from tarnwick.llm.token_alignment import align_documents, alignments
from tests.llm.conftest import SF, read

A, B = public_tokenizers.path(q.BYTE_TOKENIZER), public_tokenizers.path(q.PIECE_TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    letters, n = {}, 0
    for byte in range(256):  # the usual stand-ins: printable ones for themselves, the others from 256 on
        if not (33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174):
            letters[chr(256 + n)] = byte
            n += 1
        else:
            letters[chr(byte)] = byte

    def tokens(text):
        if not text:
            return None
        ai, bi = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ab = [bytes(letters[c] for c in names[i]) for i in ai]
        bb = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in bi]
        return (ai, ab, bi, bb) if b"".join(ab) == b"".join(bb) == (" " + text).encode() else None

    return tokens


def expected(texts, plain):
    rows, count = [], Counter()
    for text in texts:
        made = plain(text)
        if made is None:
            rows.append(None)
            continue
        ai, ab, bi, bb = made
        owner = lambda parts: [k for k, p in enumerate(parts) for _ in p]
        links = sorted(set(zip(owner(ab), owner(bb), strict=True)))
        ends = lambda parts: {sum(map(len, parts[: k + 1])): k + 1 for k in range(len(parts))} if len(parts) < 300 else dict(zip(_running(parts), range(1, len(parts) + 1), strict=True))
        ea, eb = ends(ab), ends(bb)
        groups, i, j = [], 0, 0
        for cut in sorted(ea.keys() & eb.keys()):
            groups.append(",".join(map(str, ai[i : ea[cut]])) + "|" + ",".join(map(str, bi[j : eb[cut]])))
            i, j = ea[cut], eb[cut]
        pairs = [(ai[x], bi[y]) for x, y in links]
        count.update(pairs)
        rows.append((len(ai), len(bi), groups, pairs))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = row
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), sha))
    return out


def _running(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_given_documents(spark, plain):
    docs = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    want = Counter((i, *row) for (i, _), row in zip(docs, expected([t for _, t in docs], plain), strict=True))
    assert rows_of(q.op12_token_alignment(spark, SF)) == want


AWKWARD = [
    "a  b", " a", "a ", "  ", "\n", "a\nb", "a \nb", "a\n b", "a\n\nb", "\n\n x", "\ta\tb", "ﬁx", "▁a", "a▁b c", "a\x00b", "<s> </s> <unk> <|endoftext|> <0x0A>", "\xa0x \xa0 y\xa0 z", "", None, "a\r\nb \r\n c",
    "it's we'll 'll \n'll", "x" * 60_000, " " * 30_000 + "x", "9" * 20_000, "\n" * 5_000, "é\u0301 \u2028 \u3000 a\u3000 b", "日本語 テキスト \U0001f600\U0001f600", "a\x1c b\x1f\n c\x85 d", "one two", "one two", "don't  stop\n\n\n  now ",
]


@pytest.mark.parametrize("frequent", [1 << 20, 25, 0])
def test_awkward_texts(spark, plain, frequent):
    """White space of all kinds, control strings, long runs, lost bytes, repeated rows and null ids; with many and no frequent pairs, so that the join gives the rest."""
    rows = [(i if i % 7 else None, t) for i, t in enumerate(AWKWARD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pair", "no", "n", "no_", "at_", "text_", "rare_", "n_a")})
    want = Counter((i, *row) for (i, _), row in zip(rows, expected([t for _, t in rows], plain), strict=True))
    assert rows_of(align_documents(df, A, B, frequent=frequent, remembered=40)) == want
    assert align_documents(df.limit(0), A, B).count() == 0


def test_groups_are_given(spark, plain):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id int, text string")
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in alignments(df, A, B).collect()}
    assert got == {i: (*row[:4], row[6]) for i, row in enumerate(expected(AWKWARD, plain))}


def test_a_worker_forgets_segments_when_it_values_pairs(monkeypatch):
    """The tasks that follow the alignment run in the same workers, beside all that the JVM has by then; what is learnt after it is right again."""
    import pyarrow as pa

    from tarnwick.llm import token_alignment

    monkeypatch.setattr(token_alignment, "_PAIRS", {})
    pair = token_alignment.pair_of(A, B, 400_000)
    texts = pa.array([" ".join(f"new{k}word" for k in range(20_000)), "two words"])
    before = [x.tolist() for x in token_alignment._counted(pair, *pair.numbered(texts))[:1]]
    assert len(pair.known) > 20_000 and len(pair.counts) > 20_000
    token_alignment.forget_pairs()
    assert not pair.known and not pair.texts and len(pair.counts) < 20_000
    assert before == [x.tolist() for x in token_alignment._counted(pair, *pair.numbered(texts))[:1]]


def test_few_groups_are_held_at_once(spark):
    """A row of the table between the two readings is some MB; what is written and read at once must not grow with the rows of a task."""
    import pyarrow.parquet as pq

    from tarnwick.llm.token_alignment import _grouped

    texts = [f"one{k} two\n" * 200_000 for k in range(9)]
    grouped = _grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), A, B, "doc_id", "text", 400_000)
    held = [meta.row_group(i).num_rows for f in grouped.inputFiles() for meta in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(meta.num_row_groups)]
    assert sum(held) == len(texts) and max(held) <= 4
