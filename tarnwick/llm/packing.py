"""Best-fit packing of token pieces into sequences, planned by linear grouping."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import batches_of, cut, give_back

#: Texts are tokenized in groups of about this many bytes. Beyond so many words (a parameter), a worker forgets those that have not come again.
GROUP = 1 << 20
REMEMBERED = 1_000_000
#: So many new words are encoded as one text, with a word between that can be told by its id.
JOINED, MARK = 100, "\0"


class WordTokens:
    """Token ids of texts, word by word: the tokenizer drops white space and no token spans it, so each distinct word is encoded once."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.remembered = Tokenizer.from_file(path), remembered
        self.mark = self.model.encode(MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self.again = np.zeros(len(self.ends), bool)

    def shrink(self) -> None:
        """Keep the words that have come in more than one group since the last time, or none if they fill over half of what may be remembered."""
        keep = np.flatnonzero(self.again[: len(self.known)])
        if 2 * len(keep) > self.remembered:
            keep = keep[:0]
        words, (flat, upto) = list(self.known), self.ids(keep)
        kept = [words[i] for i in keep]
        self.forget()
        self.known = dict(zip(kept, range(len(kept)), strict=True))
        if kept:
            self.flat, self.ends, self.used = flat, upto, len(flat)
            self.again = np.zeros(len(upto), bool)

    def ids(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers, one after the other, and where each begins and the last one ends."""
        first, size = self.ends[where], self.ends[where + 1] - self.ends[where]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])], upto

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has. Texts of many words cost about half of what each word costs alone; if a word has the mark's id too, or the mark isn't one id, each is encoded alone."""
        plain = lambda texts: [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.mark) == 1:
            texts = [f" {MARK} ".join([*words[i : i + JOINED], ""]) for i in range(0, len(words), JOINED)]
            ids = np.fromiter(chain.from_iterable(plain(texts)), np.uint32)
            marks = ids == self.mark[0]
            if (ends := np.flatnonzero(marks)).size == len(words):
                return ids[~marks], np.diff(ends, prepend=-1) - 1
        alone = plain(words)
        return np.fromiter(chain.from_iterable(alone), np.uint32), np.array([len(x) for x in alone], np.int64)

    def learn(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), 10_000):
            some = fresh[i : i + 10_000]
            (new, sizes), n = self.coded(some), len(self.known)
            while self.used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(some) + 1 > len(self.ends):
                self.ends, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.again))
            self.flat[self.used : self.used + len(new)] = new
            self.ends[n + 1 : n + 1 + len(some)] = self.used + np.cumsum(sizes)
            self.used += len(new)
            self.known.update(zip(some, range(n, n + len(some)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's end."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(words) > self.remembered:
            self.shrink()
        old = len(self.known)
        self.learn([w for w in words if w not in self.known])
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.again[numbers[numbers < old]] = True
        where = numbers[coded.indices.to_numpy()] if words else numbers
        ids, upto = self.ids(where)
        return ids, upto[bounds - bounds[0]][1:]


_WORDS: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, remembered: int) -> WordTokens:
    """One for each Python worker, so that what a task has learnt serves the next one."""
    if (path, remembered) not in _WORDS:
        _WORDS[path, remembered] = WordTokens(path, remembered)
    return _WORDS[path, remembered]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids with end_id after them, cut every `capacity` ids."""
    kind = df.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer, remembered)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP, "right")))
                part = batch.slice(at, to - at)
                ids, ends = tokens.encode(part.column(1))
                rows: list[tuple[int, int, int, int]] = []
                begin = 0
                for no, end in enumerate(ends):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin = end
                    rows += [(no, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes())) for s in range(0, len(own), capacity)]
                no, start, length, crc = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(no)), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], [id_col, "piece", "start", "length", "ids_crc32"])
                at = to
        give_back()

    return df.select(id_col, text_col).mapInArrow(made, schema)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size share a sequence) with whole multiplicities, from the linear programme over all patterns.

    Columns are generated: the basis prices the sizes, a knapsack finds the pattern that the prices favour most,
    the ratio test lets it in. Fractions are rounded down; what they would cover is left to best-fit.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    deepest = int(capacity // sizes.min())
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), []
        for _ in range(deepest):
            options = np.full((k, capacity + 1), -1.0)
            for g, s in enumerate(sizes):
                options[g, s:] = best[: capacity + 1 - s] + price[g]
            choice = options.argmax(axis=0)
            gain = options[choice, np.arange(capacity + 1)]
            pick.append(np.where(gain > best, choice, -1))
            best = np.maximum(best, gain)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for level in reversed(pick):
            if (g := level[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        step = np.linalg.solve(basis, column)
        amount = np.linalg.solve(basis, demand.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.floor(np.linalg.solve(basis, demand.astype(float)) + 1e-9).astype(int)
    return [(basis[:, i].astype(int), n) for i, n in enumerate(amount) if n > 0]


def pack(lengths: np.ndarray, capacity: int, groups: int = 32, small: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length: linear grouping for the large ones, best-fit for the rest.

    Lengths above small * capacity are sorted, cut into `groups` groups of equal cardinality and
    rounded up to the largest of each; patterns are optimised over those few sizes. Each
    pattern is then filled with actual documents, its last places with the largest that still
    fits, and what rounding left free goes to leftovers and small documents by best-fit.
    """
    sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    rank = np.argsort(-lengths, kind="stable")
    stock: dict[int, list[int]] = {}
    for i in rank[::-1]:
        stock.setdefault(int(lengths[i]), []).append(int(i))
    have = sum(1 << n for n in stock)
    large = lengths[rank][lengths[rank] > small * capacity]
    free: dict[int, list[int]] = {}
    rooms, count = 0, 0

    def take(most: int, least: int = 1) -> int:
        """The longest document in stock of at most `most`, or -1."""
        nonlocal have
        n = (have & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < least or n < 0:
            return -1
        i = stock[n].pop()
        if not stock[n]:
            have &= ~(1 << n)
        return i

    def put(i: int, seq: int, room: int) -> int:
        sequence[i], offset[i] = seq, capacity - room
        return room - int(lengths[i])

    def keep(seq: int, room: int) -> None:
        nonlocal rooms
        if room > 0:
            free.setdefault(room, []).append(seq)
            rooms |= 1 << room

    floor = int(small * capacity) + 1
    if len(large):
        each = -(-len(large) // groups)
        sizes, demand = np.unique(np.repeat(large[::each], each)[: len(large)], return_counts=True)
        for pattern, times in configurations(sizes, demand, capacity):
            places = [int(sizes[g]) for g in range(len(sizes) - 1, -1, -1) for _ in range(pattern[g])]
            for _ in range(times):
                room = capacity
                for place in places[:-1]:
                    if (i := take(min(place, room), floor)) >= 0:
                        room = put(i, count, room)
                while room >= floor and (i := take(room, floor)) >= 0:
                    room = put(i, count, room)
                if room < capacity:
                    keep(count, room)
                    count += 1
    while (i := take(capacity)) >= 0:
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            seq = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            seq, room, count = count, capacity, count + 1
        keep(seq, put(i, seq, room))
    return sequence, offset


def packed(parts: DataFrame, capacity: int = 2048, shard: int = 8192) -> DataFrame:
    """parts with sequence_id and offset. Full pieces are sequences by themselves.

    The others are dealt by a hash of their row number into shards of about `shard` pieces and packed shard by shard: a
    plan over thousands of pieces wastes next to nothing against one over all of them, and no task or group
    grows with the corpus, however its rows are spread over partitions. `parts` must be a table that reads the same again (see cut()).
    """
    short = F.col("length") < capacity
    numbered = parts.withColumn("no", F.monotonically_increasing_id())
    full = numbered.where(~short).withColumn("sequence_id", -1 - F.col("no")).withColumn("offset", F.lit(0).cast("long")).drop("no")
    shards = max(1, -(-parts.where(short).count() // shard))
    dealt = numbered.where(short).withColumn("no", F.pmod(F.xxhash64("no"), F.lit(shards)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack(frame.length.to_numpy(), capacity)
        out = frame.assign(sequence_id=frame.no.to_numpy() * (1 << 32) + sequence, offset=offset)
        return out.drop(columns="no")

    filled = dealt.groupBy("no").applyInPandas(one, f"{fields}, sequence_id long, offset long")
    return full.unionByName(filled)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, remembered: int = REMEMBERED) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of df.

    A document is its token ids and one closing id 0; only documents over `capacity` are cut. Null and empty texts are
    that one id. Repeated rows and equal or null ids are packed as often as they come; very long texts are encoded whole and cut into pieces; pieces of equal
    length are dealt in any order. An empty table gives an empty result; other columns are not looked at.
    """
    with batches_of(df.sparkSession, 1_000):
        parts = cut(pieces(df, tokenizer, id_col, text_col, capacity, remembered=remembered))
    return packed(parts, capacity)
