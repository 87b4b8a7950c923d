"""Ids of whole texts stay those of the tokenizer however often remembered words are forgotten."""

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarnwick.llm import packing
from tarnwick.llm.queries import WORD_TOKENIZER


@pytest.mark.parametrize("remembered", [0, 7, 60, 1_000_000])
def test_forgetting_changes_no_ids(remembered):
    path = public_tokenizers.path(WORD_TOKENIZER)
    plain, words = Tokenizer.from_file(path), packing.WordTokens(path, remembered)
    often = "the same words come again and again, l'été naïve 数据 "
    for n in range(40):
        texts = [often, None, "", " \t\n ", " ".join(f"new{n}word{k}" for k in range(n)), often * 3]
        ids, ends = words.encode(pa.array(texts, pa.string()))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w]
        assert [e - b for b, e in zip([0, *ends[:-1]], ends, strict=True)] == [len(w) for w in want]
        assert len(words.known) <= remembered + 100


def test_words_that_come_again_are_kept():
    words = packing.WordTokens(public_tokenizers.path(WORD_TOKENIZER), 20)
    for n in range(10):
        words.encode(pa.array([" ".join(["often", *(f"n{n}k{k}" for k in range(6))])]))
    assert "often" in words.known and "n0k0" not in words.known


def test_shards_are_dealt_alike_whatever_the_partitions(spark, tmp_path):
    """Pieces of a thousand small partitions fill all shards, and no shard gets far more than its share."""
    from tarnwick.llm.packing import packed

    parts = spark.range(6000, numPartitions=1000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "100L + id % 900 AS length", "0L AS ids_crc32")
    rows = packed(parts, shard=100).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(rows) == 6000 and len(groups) == 60 and max(map(len, groups.values())) <= 160
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


class Counting:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, model):
        self.model, self.texts = model, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.model.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_together():
    path = public_tokenizers.path(WORD_TOKENIZER)
    words, plain = packing.WordTokens(path), Tokenizer.from_file(path)
    words.model = Counting(words.model)
    text = " ".join(f"new{k}word,{k * k}" for k in range(12_345))
    ids, ends = words.encode(pa.array([text, "", text]))
    want = plain.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and ends.tolist() == [len(want), len(want), 2 * len(want)]
    assert words.model.texts <= 200


@pytest.mark.parametrize("text", ["a\0b \0 c", "\0", "Σ ΑΣ\0\0 <|endoftext|> x<|startoftext|>y", "́e   ́\0 'll 's"])
def test_words_with_the_mark(text):
    path = public_tokenizers.path(WORD_TOKENIZER)
    ids, ends = packing.WordTokens(path).encode(pa.array([text, "other words", text]))
    plain = Tokenizer.from_file(path)
    want = [[i for w in t.encode().split() for i in plain.encode(w.decode(), add_special_tokens=False).ids] for t in (text, "other words")]
    assert ids.tolist() == want[0] + want[1] + want[0] and ends.tolist()[-1] == len(ids)
