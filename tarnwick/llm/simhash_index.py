"""Document fingerprints by SimHash and their search by permuted block tables, in DataFrame functions only."""

from __future__ import annotations

import json
from itertools import combinations
from math import isqrt, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import hex64

#: Ranges of ids: about one for so many rows, at most so many (their bounds are sent with the plan, some 3 MB), cut by a sample of so many rows a range.
ROWS_A_CELL, MOST_CELLS, SAMPLED = 2_000, 65_536, 16


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text in joins."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def fingerprints(texts: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """One row (keys, fp) for each distinct value of `keys`, which must determine the text.

    Terms are three-word shingles of the lower-cased text (all words, if fewer), each hashed to 64
    bits. A term weighs as often as it occurs and votes with that weight for each bit that is set
    and against each that is not; a bit of the fingerprint is set if its sum is positive. Texts
    without words have fingerprint zero. Two votes share a long (32 bits each), so 32 sums do for
    64 bits. Copies of a text vote alike, so that meeting in one group changes nothing; they are summed within a partition only, so a sum
    stays below the shingles of one partition and no lane overflows, and a text that is common everywhere is no hot group.
    """
    grouped = [*keys, "part"]
    words = texts.select(*keys, F.spark_partition_id().alias("part"), F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[\x20\x09-\x0D]+"), "").alias("w"))
    size = F.size("w")
    grams = F.when(size >= 3, F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(size, F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(size, F.lit(1))).alias("c")))
    terms = words.select(*grouped, F.explode_outer(F.coalesce(grams, F.array(F.struct(F.array_join("w", " ").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))))).alias("t"))
    hashed = terms.where("t.c is not null").select(*grouped, F.when((F.col("t.a") == "") & (F.col("t.c") == ""), None).otherwise(F.xxhash64("t.a", "t.b", "t.c")).alias("h"))
    lane = 0x0000000100000001
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(lane))).alias(f"s{k}") for k in range(32)]
    voted = hashed.groupBy(*grouped).agg(F.count("h").alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{k}", 32)
        for bit, votes in ((k, low), (k + 32, high)):
            fp = fp.bitwiseOR(F.when(2 * votes > F.col("n"), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return voted.select(*keys, fp.alias("fp")).groupBy(*keys).agg(F.min("fp").alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that two fingerprints stand for: their differing bits measure the angle; 0 from a right angle on."""
    bits = F.bit_count(a.bitwiseXOR(b))
    return F.when(bits == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(bits * F.lit(pi / 64))))


def neighbours(prints: DataFrame, radius: int = 3, spare: int = 2) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct values of column fp that differ in 1 to `radius` bits.

    64 bits are cut into radius + spare blocks; two values within the radius agree in `spare` blocks
    at least. For each choice of that many blocks there is a table keyed by them (25 bits and more,
    by default), and only values that share a key are compared. Copies are one value, so a large
    group of them adds nothing; a pair that several tables find is kept in the first one only.
    """
    n = radius + spare
    cuts = [64 * k // n for k in range(n + 1)]
    mask = [((1 << hi) - (1 << lo)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    signed = [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in mask]
    values = prints.select("fp").where("fp is not null").distinct()
    tables = [
        F.struct(F.lit(t).alias("no"), F.col("fp").bitwiseAND(signed[pick[0]] if len(pick) == 1 else _union(mask, pick)).alias("key"))
        for t, pick in enumerate(combinations(range(n), spare))
    ]
    rows = values.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.no", "t.key")
    left, right = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    differs = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(False)
    for t, pick in enumerate(combinations(range(n), spare)):
        others = [k for k in range(pick[-1]) if k not in pick]
        alone = F.lit(True)
        for k in others:
            alone = alone & (differs.bitwiseAND(signed[k]) != 0)
        first = first | ((F.col("no") == t) & alone)
    found = left.join(right, ["no", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differs) <= radius))
    return found.where(first).select("a", "b")


def _union(mask: list[int], pick: tuple[int, ...]) -> Column:
    m = sum(mask[k] for k in pick)
    return F.lit(m - (1 << 64) if m >> 63 else m).cast("long")


def _cell(rows: DataFrame, cells: int) -> Column:
    """Which of about `cells` ranges the row (id, h) falls in. Bounds are quantiles of a bounded sample, so outlying ids don't crowd the others."""
    n = max(1, rows.count())
    sample = rows.select("id", "h").where((F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)) < SAMPLED * cells) & F.col("id").isNotNull())
    tiles = sample.withColumn("tile", F.ntile(cells).over(Window.orderBy("id", "h")))  # a window over some SAMPLED * MOST_CELLS small rows at most
    bounds = sorted({(r.b.id, r.b.h) for r in tiles.groupBy("tile").agg(F.min(F.struct("id", "h")).alias("b")).collect()})[1:]
    if not bounds:
        return F.lit(0).cast("long")
    # Two levels of about the square root of the bounds each: what lies at or below the key is counted in the one, then in one part of the other.
    step = isqrt(len(bounds)) + 1
    kind = rows.schema["id"].dataType.simpleString()
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    sent = lambda some, shape: F.from_json(F.lit(json.dumps(some, default=str)), shape)
    one = lambda b: {"id": b[0], "h": b[1]}
    tops = sent([one(p[0]) for p in parts], f"array<struct<id:{kind},h:bigint>>")
    inner = sent([[one(b) for b in p] for p in parts], f"array<array<struct<id:{kind},h:bigint>>>")
    key = F.struct("id", "h")
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    top = below(tops)
    return F.when(top == 0, 0).otherwise((top - 1) * step + below(F.element_at(inner, F.greatest(top, F.lit(1))))).cast("long")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next_text): each row with the text of the row after it by ascending id, the last with the first's.

    Rows without id come first, in no order of meaning but the same each time; equal ids go by a hash
    of the text. Ids (of any type that sorts) are cut into ranges; a window runs inside each range, which also gets a stub of
    the first row of the next range, so that no window holds the whole table.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cells = max(1, min(MOST_CELLS, rows.count() // ROWS_A_CELL))
    cell = F.when(F.col("id").isNull(), -1 - F.pmod(F.col("h"), F.lit(cells))).otherwise(_cell(rows, cells))
    rows = rows.withColumn("cell", cell.cast("long"))
    firsts = rows.groupBy("cell").agg(F.min(F.struct("id", "h")).alias("first"))
    before = Window.orderBy("cell")  # at most 2 * MOST_CELLS rows
    ring = firsts.select(
        "first.id", "first.h", F.col("cell").alias("of"),
        F.coalesce(F.lag("cell").over(before), F.max("cell").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("cell"),
    )
    same = [F.col("r.id").eqNullSafe(F.col("f.id")), F.col("r.h") == F.col("f.h"), F.col("r.of") == F.col("f.of")]
    stubs = rows.withColumnRenamed("cell", "of").alias("r").join(F.broadcast(ring).alias("f"), same).select("r.id", "r.text", "r.h", "f.cell")
    both = rows.withColumn("stub", F.lit(0)).unionByName(stubs.select("id", "text", "h", "cell", F.lit(1).alias("stub")))
    order = Window.partitionBy("cell").orderBy("stub", "id", "h", "text")
    return both.withColumn("next_text", F.lead("text").over(order)).where("stub = 0").select("id", "text", "next_text")


def edited_prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and how many rows are near.

    The edited text has its last floor(n_chars / share) code points replaced by the first as many of the
    next row's text (all, if fewer). near_rows counts the other rows whose fingerprint is within
    `radius` bits. Null texts count as empty; an empty table gives an empty result; repeated rows
    come back as often as they came; other columns are not looked at, whatever their names. Very long texts are taken whole;
    equal ids (ties) follow each other by a hash of their texts.
    """
    rows = with_next(df, id_col, text_col)
    n = F.char_length("text")
    tail = F.floor(n / share).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr(f"substring(text, 1, char_length(text) - cast(floor(char_length(text) / {share}) as int))"), F.substring("next_text", F.lit(1), tail)))
    meta = rows.select(
        "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array(*text_key(F.col("text"))).alias("own"), F.array(*text_key(F.col("edited"))).alias("edit"), F.array(*text_key(F.col("next_text"))).alias("next"),
    )
    texts = rows.select(F.explode(F.array("text", "edited")).alias("t")).select("t", *[k.alias(f"k{i}") for i, k in enumerate(text_key(F.col("t")))])
    prints = fingerprints(texts, "t", ["k0", "k1"])  # in one job with the joins below, so that the texts are shuffled once for both
    for role in ("own", "edit", "next"):
        meta = meta.withColumn("k0", F.col(role)[0]).withColumn("k1", F.col(role)[1]).join(prints.withColumnRenamed("fp", f"fp_{role}"), ["k0", "k1"]).drop("k0", "k1", role)
    return meta.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hex64(F.col("fp_own")).alias("fingerprint"), hex64(F.col("fp_edit")).alias("edited_fingerprint"),
        likeness(F.col("fp_own"), F.col("fp_edit")).alias("near_edited"), likeness(F.col("fp_own"), F.col("fp_next")).alias("near_next"), "fp_own",
    )


def near_rows(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, near_rows) for each distinct fp: how many other rows lie within the radius, copies included.

    Pairs are of distinct values, of which one has at most some 43,700 within 3 bits, however many rows share them.
    """
    counts = fps.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n"))
    pairs = neighbours(counts, radius)
    both = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    around = both.join(counts.select(F.col("fp").alias("other"), F.col("n").alias("m")), "other").groupBy("fp").agg(F.sum("m").alias("m"))
    return counts.join(around, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("near_rows"))
