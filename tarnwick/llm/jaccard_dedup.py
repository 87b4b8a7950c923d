"""Near-duplicates by the exact Jaccard similarity of their sets of word shingles: SimHash links first, then what they miss.

SimHash fingerprints of the same shingles are linked by the tiled comparison of simhash_dedup, and each link counts if the sets
confirm it. That joins most copies cheaply, but a similarity of 0.8 may lie far beyond any radius that is worth searching, so the rest
is found by prefix filtering. Two sets with a similarity of at least t share a shingle among the first n - ceil(t n) + 1 of each, whatever
common order the shingles are in, so a join on those beginnings misses no pair. The order puts shingles that many texts
share last; it comes from a bounded sketch, which decides only how many pairs are tried, never which are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import batches_of, cut, discard, give_back
from tarnwick.llm.components import components
from tarnwick.llm.simhash_dedup import SEED, _ones, _word_blocks, links, numbered, rank

#: The sketch counts shingles by so many leading bits of their hashes; at most so many of the fullest cells are broadcast.
CELL_BITS = 22
#: Parities by which pairs that can't be similar are told before their texts are fetched: a power of two, so many at least and as many as a set has shingles.
SIGN_BITS, FOLDED = 2048, 8
MOST_HEAVY = 200_000
#: Rounds in which the texts that share a shingle are compared with one of them only, before all that is left is compared.
PIVOT_ROUNDS = 1
#: Rows are chosen by a bit each, 64 to a long; that table is broadcast up to so many longs.
MOST_WORDS = 1 << 20
#: Rounds in which each text of the pairs that are left is compared with its most promising partners only, if it has many, before all that is left is compared.
WIDE_ROUNDS, BEST_ROUNDS = 1, 3
#: Texts, and pairs of texts, that a Python worker gets at once.
TEXTS_A_BATCH, PAIRS_A_BATCH = 1_000, 200


def hashes(text: str | None, size: int = 5) -> np.ndarray:
    """XXH64 values of the word shingles in order of the text; words as in op5, fewer words than a shingle make one, no words none."""
    found, carry = [], []
    for words in _word_blocks((text or "").encode("utf-8", "replace").lower()):
        words = carry + words
        n = len(words) - size + 1
        if n < 1:
            carry = words
            continue
        grams = map(b" ".join, zip(*(words[i : i + n] for i in range(size)), strict=True))
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))
        carry = words[n:]
    if not found and carry:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct values of hashes() in rising order."""
    return np.unique(hashes(text, size))


def _heavy(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of hashes that hold far more than their share in some task, and their counts: at most MOST_HEAVY."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << CELL_BITS, np.int32)
        for frame in frames:
            for text in frame.iloc[:, 0]:
                np.add.at(total, (shingles(text, size) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        cells = np.flatnonzero(total > 16 + 8 * total.mean())
        yield pd.DataFrame({"cell": cells, "n": total[cells].astype(np.int64)})
        del total
        give_back()

    sums = texts.mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sums.orderBy(F.desc("n"), "cell").limit(MOST_HEAVY).toPandas().sort_values("cell")
    return rows.cell.to_numpy(np.int64), rows.n.to_numpy(np.int64)


def _only(rows: DataFrame, number: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `number` is among the first column of `wanted`. Numbers are row numbers, so 64 of them are one long of bits, and rows with whole texts stay where they are at every size."""
    word, bit = "shiftright({0}, 6)", "shiftleft(1L, cast({0} & 63 as int))"
    no = wanted.select(F.col(wanted.columns[0]).alias("_no"))
    bits = cut(no.groupBy(F.expr(word.format("_no")).alias("_word")).agg(F.expr(f"bit_or({bit.format('_no')})").alias("_bits")))
    bits = F.broadcast(bits) if bits.count() <= MOST_WORDS else bits
    return rows.join(bits, F.expr(word.format(number)) == F.col("_word")).where(f"_bits & {bit.format(number)} <> 0").select(*[rows[c] for c in rows.columns])


def _similar(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of at least percent / 100. Texts travel to the pairs, as they are smaller than their sets."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in known:
                if len(known) > 64:
                    known.clear()
                known[text] = shingles(text, size)
            return known[text]

        out = []
        for a, b in zip(left, right, strict=True):
            x, y = of(a), of(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append((100 + percent) * both >= percent * (len(x) + len(y)))
        known.clear()
        give_back()
        return pd.Series(out, dtype=bool)

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = cut(_only(texts, "node", asked))
    side = lambda k: asked.select(F.col("node").alias(k), F.col("text").alias(f"t{k}"))
    with batches_of(texts.sparkSession, PAIRS_A_BATCH):
        found = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(alike("ta", "tb")).select("a", "b"))
    discard(asked)
    return found


def _begun(texts: DataFrame, column: str, size: int, percent: int) -> Column:
    """A text's set as two hashes (k0, k1), its size n, the SimHash fp of its shingles, the parities (sign) of how many fall into each of SIGN_BITS cells (more for a larger set), and its beginning (head) in the common order."""
    sent = texts.sparkSession.sparkContext.broadcast(_heavy(texts.select(F.col(column).alias("text")), size))

    @F.pandas_udf("struct<k0:long,k1:long,n:int,fp:long,sign:array<long>,head:array<long>>")
    def begun(text: pd.Series) -> pd.DataFrame:
        cells, counts = sent.value
        rows = []
        for x in text:
            h = hashes(x, size)
            s = np.unique(h)
            n = len(s)
            cell = (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            weight = np.zeros(n, np.int64)
            if len(cells) and n:
                at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
                weight = np.where(cells[at] == cell, counts[at], 0)
            keep = n - -(-percent * n // 100) + 1 if n else 0
            k0, k1 = np.array([xxhash.xxh64_intdigest(s.tobytes(), i) for i in (0, 1)], np.uint64).view(np.int64)
            fp = np.packbits(2 * _ones(h) > len(h), bitorder="little").view(np.int64)[0]
            cells_n = max(SIGN_BITS, 1 << (n - 1).bit_length() if n else 0)
            sign = np.packbits(np.bincount((s % np.uint64(cells_n)).astype(np.int64), minlength=cells_n) & 1, bitorder="little").view(np.int64)
            rows.append((k0, k1, np.int32(n), fp, sign, s[np.lexsort((s, weight))[:keep]].view(np.int64)))
        give_back()
        return pd.DataFrame(rows, columns=["k0", "k1", "n", "fp", "sign", "head"])

    return begun(F.col(column))


def _simhash_pairs(heads: DataFrame, radius: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, na, b, nb) that SimHash links of at most `radius` bits suggest: nodes with their fingerprint's first node, and first nodes of linked ones."""
    firsts = cut(heads.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")))
    linked = cut(links(firsts, radius))
    at = lambda k: firsts.select(F.col("fp").alias(k), F.col("first.node").alias(f"{k}_node"), F.col("first.n").alias(f"{k}_n"))
    across = linked.join(at("a"), "a").join(at("b"), "b").select(F.col("a_node").alias("a"), F.col("a_n").alias("na"), F.col("b_node").alias("b"), F.col("b_n").alias("nb"))
    within = heads.join(firsts, "fp").where("node <> first.node").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("first.node").alias("b"), F.col("first.n").alias("nb"))
    return across.union(within), [firsts, linked]


def _near(apart: Column, a: str, b: str, percent: int) -> Column:
    """Whether sets of a and b shingles that differ in at least `apart` can be similar."""
    return (100 + percent) * apart <= (100 - percent) * (F.col(a) + F.col(b))


def _alike(apart: Column, a: str, b: str) -> Column:
    """How alike sets of a and b shingles seem whose parities differ in `apart` cells: 1000 at most."""
    return F.lit(1000) - F.floor(1000 * apart / F.greatest(F.col(a) + F.col(b), F.lit(1)))


def _differing(x: Column, y: Column) -> Column:
    """How many parities of two sets differ; if one has twice as many cells as the other, its halves are added first."""
    xor = lambda p, q: p.bitwiseXOR(q)
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, (F.size(s) / 2).cast("int")), xor)
    even = lambda s, other: F.when(F.size(s) > F.size(other), half(s)).otherwise(s)
    return F.aggregate(F.zip_with(even(x, y), even(y, x), lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda total, v: total + v)


def _possible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be similar, and how alike (c) their parities are: two sets differ in at least as many shingles as their parities differ, so no similar pair is lost."""
    side = lambda k: heads.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sign").alias(f"s_{k}"))
    told = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", _differing(F.col("s_a"), F.col("s_b")).alias("apart"))
    return told.where(_near(F.col("apart"), "n_a", "n_b", percent)).select("a", "b", _alike(F.col("apart"), "n_a", "n_b").alias("c"))


def _best(pairs: DataFrame) -> DataFrame | None:
    """For each node of pairs (a, b, c) the partner that c favours most, if nodes have many partners, else None."""
    wide = pairs.agg(F.count("*").alias("n"), F.approx_count_distinct("a").alias("nodes")).first()
    if wide.n <= 4 * wide.nodes:
        return None
    of_a, of_b = pairs.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b")), pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    return cut(of_a.union(of_b.select("a", "b")).distinct())


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are not known to be of one component."""
    label = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    rooted = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return rooted.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(pairs.columns)


def similar_links(heads: DataFrame, texts: DataFrame, size: int = 5, percent: int = 80, radius: int = 2) -> DataFrame:
    """(node, root): components under a similarity of at least percent / 100 of the sets of heads (node, n, fp, sign, head), which differ.

    `texts` (node, text) has their texts. No pair of a component is compared once it is known to be one, so a large group of near
    copies costs each of its texts a few comparisons. What is left after the SimHash links and the pivot rounds (they are compared together) is compared best pairs first, and at last in full: pairs
    that share a beginning and whose sizes allow it.
    """
    posted = heads.select("node", "n", F.posexplode("head").alias("i", "key"))
    # Parities of 64 * FOLDED cells, each the sum of some of the sign's: short enough to go along with each shared shingle.
    fold = lambda k: F.aggregate(F.filter("sign", lambda x, i: i % FOLDED == k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias(f"s{k}")
    folded = heads.select("node", *[fold(k) for k in range(FOLDED)])
    shared = posted.groupBy("key").agg(F.count("*").alias("_count")).where("_count > 1").select("key")
    posted = cut(posted.join(shared.hint("merge"), "key", "left_semi"))  # by the same plan whatever its size
    fits = lambda a, b: (F.lit(100) * F.least(a, b) >= percent * F.greatest(a, b))
    suggested, used = _simhash_pairs(heads, radius)
    suggested = suggested.where(fits(F.col("na"), F.col("nb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found, roots = texts.sparkSession.createDataFrame([], "a long, b long"), texts.sparkSession.createDataFrame([], "node long, root long")
    for k in range(PIVOT_ROUNDS + 1):
        labelled = posted.join(roots, "node", "left").select("key", "node", "n", "i", F.coalesce("root", "node").alias("label"))
        open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("node", "n", "label"), F.xxhash64(F.lit(k), "node")).alias("p")).where("lo <> hi")
        labelled = labelled.join(open_keys.select("key", "p"), "key")
        # A pair that shares the shingle before this one too, with none that others share between, has been met there already.
        before = F.lag("key").over(Window.partitionBy("node").orderBy("i")).alias("before")
        labelled = cut(labelled if k < PIVOT_ROUNDS else labelled.select("*", before).join(folded, "node"))
        if k < PIVOT_ROUNDS:
            pairs = labelled.where((F.col("label") != F.col("p.label")) & fits(F.col("n"), F.col("p.n"))).select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("p.node").alias("b"), F.col("p.n").alias("nb"))
        else:
            # Of two texts that are not known to be one component, at least one is outside the fullest component of the key.
            most = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
            left = labelled.join(most, "key").where("label <> most").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("before").alias("before_a"), F.col("label").alias("la"), *[F.col(f"s{x}").alias(f"sa{x}") for x in range(FOLDED)])
            right = labelled.join(most, "key").select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("before").alias("before_b"), F.col("label").alias("lb"), *[F.col(f"s{x}").alias(f"sb{x}") for x in range(FOLDED)], (F.col("label") == F.col("most")).alias("main"))
            # The first shingle that a pair shares stands early enough in both for what follows it to make them similar.
            early = (100 + percent) * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= percent * (F.col("na") + F.col("nb"))
            first = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
            apart = sum((F.bit_count(F.col(f"sa{x}").bitwiseXOR(F.col(f"sb{x}"))) for x in range(FOLDED)), F.lit(0))
            ok = first & (F.col("la") != F.col("lb")) & (F.col("main") | (F.col("a") < F.col("b"))) & fits(F.col("na"), F.col("nb")) & early & _near(apart, "na", "nb", percent)
            pairs = left.join(right, "key").where(ok).select("a", "na", "b", "nb", _alike(apart, "na", "nb").alias("c"))
        # A pivot stands for a part of the shared shingles only, so in its rounds their number only chooses what to try: pairs that share enough, and those of sets
        # that are small enough for their parities to tell. The last round tries every pair that the parities allow.
        rest = F.greatest(F.ceil(F.col("na") * percent / 100), F.ceil(F.col("nb") * percent / 100)) - 1
        flip = F.col("a") > F.col("b")
        count = F.count("*") if k < PIVOT_ROUNDS else F.first("c")
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(flip, F.col("na")).otherwise(F.col("nb")).alias("nb")]
        pairs = pairs.select(*ends, *[c for c in pairs.columns if c == "c"]).groupBy("a", "b", "na", "nb").agg(count.alias("c"))
        likely = ((100 + percent) * (F.col("c") + rest) >= percent * (F.col("na") + F.col("nb"))) | (F.col("na") + F.col("nb") < 2 * SIGN_BITS)
        pairs = pairs.where(likely).select("a", "b").union(suggested).distinct() if k < PIVOT_ROUNDS else cut(pairs.select("a", "b", "c"))
        # In a large group most nodes have many candidates, and one true link makes the others needless: once before the full parities are fetched, and after.
        for _ in range(WIDE_ROUNDS if k == PIVOT_ROUNDS else 0):
            best = _best(pairs)
            if best is None:
                break
            found = found.union(_similar(cut(_possible(best, heads, percent)).select("a", "b"), texts, size, percent))
            roots = components(found, "a", "b")
            last, pairs = pairs, cut(_apart(pairs, roots).join(best, ["a", "b"], "left_anti"))
            discard(last)
        last, pairs = pairs, cut(_possible(pairs.select("a", "b"), heads, percent))
        discard(labelled)
        if k == PIVOT_ROUNDS:
            discard(last)
            for _ in range(BEST_ROUNDS):
                best = _best(pairs)
                if best is None:
                    break
                found = found.union(_similar(best, texts, size, percent))
                roots = components(found, "a", "b")
                last, pairs = pairs, cut(_apart(pairs, roots).join(best, ["a", "b"], "left_anti"))
                discard(last)
        if not pairs.isEmpty():
            found = found.union(_similar(pairs.select("a", "b"), texts, size, percent))
            roots = components(found, "a", "b")
        discard(pairs)
    discard(posted, *used)
    return roots


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, radius: int = 2) -> DataFrame:
    """The rows of df, with all their columns, of which each component of near-duplicates keeps one: that with the smallest id.

    Rows link if their sets of word shingles have a Jaccard similarity of at least percent / 100; texts without words (and nulls)
    are equal. Rows with an id come before those without; among rows with equal ids the first in the table stays. Very long
    texts are taken whole; an empty table gives an empty result; columns of df come back untouched, whatever their names.
    """
    with batches_of(df.sparkSession, TEXTS_A_BATCH):
        rows = numbered(df, _begun(df, text_col, size, percent))
    nodes = cut(rows.groupBy("made.k0", "made.k1").agg(F.min(rank(id_col)).alias("first")).select("first", F.col("first.row").alias("node")))
    heads = cut(_only(rows.select(F.col("no").alias("node"), "made.n", "made.fp", "made.sign", "made.head"), "node", nodes.select("node")))
    roots = similar_links(heads, rows.select(F.col("no").alias("node"), F.col(f"row.`{text_col}`").alias("text")), size, percent, radius)
    rooted = nodes.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("no")))
    discard(heads, nodes)
    return _only(rows, "no", kept).select("row.*")
