"""Alignment of two tokenizers over whole texts: byte owners, cut points, and how often ids meet in the corpus."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import batches_of, cut, discard, give_back

#: Texts are aligned in groups of about this many bytes. A worker forgets its segments when it knows so many.
GROUP = 2 << 20
REMEMBERED = 400_000
#: Rows of such groups that are written and read together, about 3 MB each.
TOGETHER = 4
#: So many of the most frequent id pairs are broadcast (17 bytes each); the others are joined.
FREQUENT = 1 << 20

_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \n])")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Two tokenizers and what they make of segments.

    A segment begins at a space or line feed that follows something else than white space. Tokenizer A's pattern cuts there, and no
    piece of B has a space or line feed behind another character (checked when it is loaded), so a text's tokens are its segments'
    tokens, and each distinct segment is encoded and aligned once while it is remembered.
    """

    def __init__(self, a_path: str, b_path: str, remembered: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.remembered = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), remembered
        self.a.encode_special_tokens = True
        stands = byte_level_alphabet()
        entries = {i: bytes(stands[c] for c in t) if all(c in stands for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces across spaces: texts can't be cut into segments")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = np.zeros((1 << 14, 4), np.int32)  # tokens of A and B (-1: bytes differ), groups, links
        self.pairs, self.ends = np.zeros(1 << 16, np.int64), np.zeros((1 << 14) + 1, np.int64)

    def learn(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), 20_000):
            self._learn(fresh[i : i + 20_000])

    def _learn(self, segments: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B puts a space before what it gets: the segment's own, or one before a line feed, which stays a token of its own
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        b = [t if s[0] == " " else t[1:] for s, t in zip(segments, b, strict=True)]
        # an empty rest gets no space from B
        b = [t or self.b.encode("\n")[:1] for t in b]
        same = [b"".join(map(self.a_bytes.__getitem__, x)) == (data := s.encode()) == b"".join(map(self.b_bytes.__getitem__, y)) for s, x, y in zip(segments, a, b, strict=True)]
        n, base = len(segments), len(self.known)
        a, b = ([x if ok else [] for x, ok in zip(t, same, strict=True)] for t in (a, b))
        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        a_ids, b_ids = (np.fromiter((i for x in t for i in x), np.int64, int(m.sum())) for t, m in ((a, n_a), (b, n_b)))
        counts = np.stack([n_a, n_b, np.zeros(n, np.int64), np.zeros(n, np.int64)], axis=1)
        counts[[not ok for ok in same]] = -1
        links = np.zeros(0, np.int64)
        texts = [""] * n
        if len(a_ids):
            # the owners of every byte; each run of one pair of owners is a link, and where both change all tokens before have ended
            a_owner, b_owner = np.repeat(np.arange(len(a_ids)), self.a_size[a_ids]), np.repeat(np.arange(len(b_ids)), self.b_size[b_ids])
            a_new, b_new = (np.concatenate([[True], o[1:] != o[:-1]]) for o in (a_owner, b_owner))
            runs, cuts = np.flatnonzero(a_new | b_new), np.flatnonzero(a_new & b_new)
            segment = np.repeat(np.arange(n), n_a)
            links = (a_ids[a_owner[runs]] << 32) | b_ids[b_owner[runs]]
            counts[:, 3] = np.where(counts[:, 3] < 0, -1, np.bincount(segment[a_owner[runs]], minlength=n))
            of_group = segment[a_owner[cuts]]
            groups = np.bincount(of_group, minlength=n)
            counts[:, 2] = np.where(counts[:, 2] < 0, -1, groups)
            a_text, b_text = (list(map(str, x.tolist())) for x in (a_ids, b_ids))
            a_cut, b_cut = (np.append(o[cuts], m).tolist() for o, m in ((a_owner, len(a_ids)), (b_owner, len(b_ids))))
            made = [",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m]) for i, j, k, m in zip(a_cut, a_cut[1:], b_cut, b_cut[1:], strict=False)]
            upto = np.concatenate([[0], np.cumsum(groups)]).tolist()
            texts = [";".join(made[i:j]) for i, j in zip(upto, upto[1:], strict=False)]
        while base + n > len(self.counts):
            self.counts, self.ends = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.ends, np.zeros(len(self.ends) - 1, np.int64)])
        used = int(self.ends[base])
        while used + len(links) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.counts[base : base + n], self.pairs[used : used + len(links)] = counts, links
        self.ends[base + 1 : base + n + 1] = used + np.cumsum(np.maximum(counts[:, 3], 0))
        self.texts += texts
        self.known.update(zip(segments, range(base, base + n), strict=True))

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all segments of the texts in order, and where each text's end. Null and empty texts have none."""
        texts = texts.fill_null("")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        # a space that follows white space (or nothing) begins no segment: texts with such spaces are cut by the pattern
        odd = np.array([not w or w[-1].isspace() for w in words], bool)
        slow = np.zeros(len(texts), np.int64)
        np.add.at(slow, np.repeat(np.arange(len(texts)), np.diff(bounds))[odd[index]], 1)
        apart = {int(i): _BEFORE_SPACE.split(" " + t) if (t := texts[int(i)].as_py()) else [] for i in np.flatnonzero(slow)}
        segments = [w if w[:1] == "\n" else " " + w for w in words]
        needed = [s for s, o in zip(segments, odd, strict=True) if not o] + list({s for t in apart.values() for s in t})
        fresh = list(dict.fromkeys(s for s in needed if s not in self.known))
        if self.known and len(self.known) + len(fresh) > self.remembered:
            self.forget()
            fresh = list(dict.fromkeys(needed))
        self.learn(fresh)
        number = np.array([-1 if o else self.known[s] for s, o in zip(segments, odd, strict=True)], np.int64)
        if not apart:
            return number[index], bounds[1:]
        parts = [np.array([self.known[s] for s in apart[i]], np.int64) if i in apart else number[index[bounds[i] : bounds[i + 1]]] for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


_PAIRS: dict[tuple, Pair] = {}


def pair_of(a_path: str, b_path: str, remembered: int) -> Pair:
    """One for each Python worker, so that what a task has learnt serves the next one."""
    if (a_path, b_path, remembered) not in _PAIRS:
        _PAIRS[a_path, b_path, remembered] = Pair(a_path, b_path, remembered)
    return _PAIRS[a_path, b_path, remembered]


def forget_pairs() -> None:
    """What this worker has learnt of segments goes back to the system: tasks that follow the alignment in the same worker have no use for it."""
    for pair in _PAIRS.values():
        pair.forget()
    give_back()


def groups_of(batches: Iterator[pa.RecordBatch], size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text (the second column), or one text that is longer."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... sizes[i] of them, for each i in turn."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups) for each row of df: its text under both tokenizers.

    Both encode a space and the text, without special tokens. groups is `a1,a2|b1;a3|b2,b3`: the ids between byte offsets where
    tokens of both end. A link is an A and a B token with a byte in common. Null and empty texts, and those whose tokens' bytes are not the text's,
    have no tokens: zeros and an empty string. Repeated rows come back as often as they came; an empty table gives an empty result; other columns are
    not looked at. Very long texts are aligned whole; the longest run without a space sets the memory of a task, some 100 bytes a byte of it.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path, remembered)
        for part in groups_of(batches):
            numbers, ends = pair.numbered(part.column(1))
            table, texts = _counted(pair, numbers, ends)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, table.T.copy()), pa.array(texts)], [id_col, "n_a", "n_b", "n_groups", "n_links", "groups"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text_")).mapInArrow(made, schema)


def _counted(pair: Pair, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Counts of each text and its groups as a string; nothing if any segment's bytes differ."""
    counts = pair.counts[numbers].astype(np.int64)
    lost = _sums(counts[:, 0] < 0, ends) > 0
    table = np.stack([np.where(lost, 0, _sums(counts[:, c], ends)) for c in range(4)], axis=1)
    begins = np.concatenate([[0], ends[:-1]])
    texts = ["" if no else ";".join([pair.texts[n] for n in numbers[i:j].tolist()]) for i, j, no in zip(begins.tolist(), ends.tolist(), lost.tolist(), strict=True)]
    return table, texts


def _grouped(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, remembered: int) -> DataFrame:
    """One row for each group of texts: the texts' counts and digests, its distinct id pairs with their times, and which pairs are in which text."""
    kind = df.schema[id_col].dataType.simpleString()
    lists = {"ids": f"array<{kind}>", "n_a": "array<long>", "n_b": "array<long>", "n_groups": "array<long>", "n_links": "array<long>", "digests": "array<string>", "pairs": "array<long>", "times": "array<long>"}
    raw = ("segments", "segment_ends", "links", "link_ends")
    schema = ", ".join(["no long", *[f"{c} {t}" for c, t in lists.items()], *[f"{c} binary" for c in raw]])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, no = pair_of(a_path, b_path, remembered), TaskContext.get().partitionId() << 33
        for part in groups_of(batches):
            numbers, ends = pair.numbered(part.column(1))
            table, texts = _counted(pair, numbers, ends)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            used, index = np.unique(numbers, return_inverse=True)
            held = np.maximum(pair.counts[used, 3].astype(np.int64), 0)
            pairs, which = np.unique(pair.pairs[_spread(pair.ends[used], held)], return_inverse=True)
            lost = np.repeat(table[:, 0] == 0, np.diff(np.concatenate([[0], ends])))
            often = np.bincount(index[~lost], minlength=len(used))
            times = np.bincount(which, np.repeat(often, held), minlength=len(pairs)).astype(np.int64)
            # texts without tokens keep no segments either
            kept = _sums(~lost, ends)
            whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (part.column(0), *map(pa.array, table.T.copy()), pa.array(digests, pa.string()), pa.array(pairs), pa.array(times))]
            flat = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (index[~lost], np.cumsum(kept), which, np.cumsum(held))]
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), *whole, *flat], ["no", *lists, *raw])
            no += 1
        give_back()

    with batches_of(df.sparkSession, 2_000):
        return cut(df.select(id_col, F.col(text_col).cast("string").alias("text_")).mapInArrow(made, schema), TOGETHER)


def _b_id(pairs: Column) -> Column:
    return pairs.bitwiseAND(F.lit(0xFFFFFFFF))


def pair_counts(grouped: DataFrame) -> DataFrame:
    """(pair, n, best) of each id pair A << 32 | B: its links in the corpus, and whether no pair has more with its B id. A B id has at most A's vocabulary of pairs."""
    counts = grouped.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).where("x.times > 0").groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(_b_id(F.col("pair")))))


def align_documents(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of df: see alignments(), and what its links are worth in the corpus.

    A pair of ids counts its links over all rows; count_sum adds these counts over a text's links, and n_best counts the links whose pair is
    the most frequent one of its B id, ties included. Texts are read and encoded once. The `frequent` most
    frequent pairs are broadcast, a bounded table; the others, which are rare by then, are joined. So no task gets the rows of a common pair. Nulls, empty texts, repeated rows,
    empty tables, other columns and long texts are as in alignments(); groups_sha256 is empty where there are no tokens.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    grouped = _grouped(df, a_path, b_path, id_col, text_col, remembered)
    counts = cut(pair_counts(grouped))
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow()
    order = np.argsort(top["pair"].to_numpy(), kind="stable")
    common = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "n", "best")))
    names = ("n_a", "n_b", "n_groups", "n_links")
    columns = ["no_", "at_", id_col, *names, "groups_sha256", "n_best", "count_sum", "rare_"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, ["long", "int", kind, *["long"] * 4, "string", "long", "long", "array<struct<pair: long, times: long>>"], strict=True))

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pairs()
        known, n, best = common.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                segments, segment_ends, links, link_ends = (np.frombuffer(row[c].as_buffer(), np.int32).astype(np.int64) for c in ("segments", "segment_ends", "links", "link_ends"))
                pairs = row["pairs"].values.to_numpy()
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                value, is_best = (np.where(found, x[at], 0).astype(np.int64) if len(known) else np.zeros(len(pairs), np.int64) for x in (n, best))
                sums = [_sums(_sums(x[links], link_ends)[segments], segment_ends) for x in (is_best, value)]
                # rare pairs: the links of those segments that have any, text by text
                begins = np.concatenate([[0], link_ends[:-1]])
                rare = _sums(~found[links], link_ends) > 0
                owner = np.repeat(np.arange(len(segment_ends)), np.diff(np.concatenate([[0], segment_ends])))
                hit = rare[segments]
                size = (link_ends - begins)[segments[hit]]
                which = links[_spread(begins[segments[hit]], size)]
                text = np.repeat(owner[hit], size)
                text, which = text[~found[which]], which[~found[which]]
                keys, times = np.unique(text * (len(pairs) + 1) + which, return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(segment_ends) + 1) * (len(pairs) + 1))
                rares = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[keys % (len(pairs) + 1)], pa.int64()), pa.array(times, pa.int64())], ["pair", "times"]))
                numbers = pa.array(np.full(len(segment_ends), row["no"].as_py())), pa.array(np.arange(len(segment_ends), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*numbers, row["ids"].values, *[row[c].values for c in names], row["digests"].values, *map(pa.array, sums), rares], columns)

    with batches_of(spark, TOGETHER):
        valued = cut(grouped.mapInArrow(worth, schema))
    discard(grouped)
    parts = valued.select("no_", "at_", F.explode("rare_").alias("x")).select("no_", "at_", "x.pair", "x.times")
    added = parts.join(counts, "pair").groupBy("no_", "at_").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.col("best").cast("long") * F.col("times")).alias("bests"))
    whole = valued.join(added, ["no_", "at_"], "left")
    return whole.select(
        id_col, *names, (F.col("n_best") + F.coalesce("bests", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
