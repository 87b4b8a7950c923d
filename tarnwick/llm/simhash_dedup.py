"""Near-duplicates by SimHash, compared exactly in tiles.

Fingerprints are made in Python workers (hashing and bit votes over whole texts), the distinct
ones are dealt into tiles by the population counts of their blocks of bits, and two tiles are
compared bit by bit (numpy exclusive-or and bit counts) unless their population counts alone
prove that no two members lie within the radius. Nothing is sampled: the pruning is exact,
since |popcount(a) - popcount(b)| summed over blocks never exceeds the differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import cut, hex64
from tarnwick.llm.components import components

SEED = 42
#: Texts are hashed in pieces of about this many bytes, so a long one needs no more memory.
PIECE = 1 << 20


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[start:end].split()
        start = end


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits. Bytes hold up to 255 votes, so 255 rows are added at a time."""
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(lanes), 255):
        total += lanes[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash: bit set where over half of the shingles' XXH64 values have it.

    Words are runs of non-space bytes with A-Z lower-cased; fewer words than a shingle make one
    shingle; no words (or null) give zero.
    """
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in _word_blocks((text or "").encode("utf-8", "replace").lower()):
        words = carry + words
        if len(words) < shingle:
            carry = words
            continue
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)), strict=True))
        ones += _ones(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))
        total += n
        carry = words[n:]
    if not total:
        if not carry:
            return 0
        ones, total = _ones(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    return made(text)


def _tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Links between two tiles; as many links as members at most, the rest follow from those."""
    found = []
    for i in range(0, len(a), 256):
        rows, cols = np.nonzero(np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius)
        rows += i
        found.append(np.stack([rows, cols]))
    rows, cols = np.concatenate(found, axis=1)
    if same:
        rows, cols = rows[keep := rows < cols], cols[keep]
    if len(rows) <= len(a) + len(b):
        return np.stack([a[rows], b[cols]], axis=1)
    label = np.arange(len(a) + len(b))
    cols = cols if same else cols + len(a)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    value = np.concatenate([a, b])
    own = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([value[own], value[label[own]]], axis=1)


def links(prints: DataFrame, radius: int = 2, blocks: int = 4, tile: int = 2048) -> DataFrame:
    """(a, b) links that join every two distinct values of column fp within `radius` bits into one component.

    A tile is a set of at most about `tile` fingerprints with equal population counts in each of
    `blocks` blocks; `blocks` changes only how many tile pairs are skipped, so it may grow with
    the corpus (4 up to some 10^8 fingerprints, 8 or 16 beyond). Tiles of one code are dealt by
    hash, so a code that holds many fingerprints becomes many tiles, not a large one.
    """
    width, base = 64 // blocks, 64 // blocks + 1
    mask = (1 << width) - 1
    part = [F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask) if mask < 1 << 63 else F.lit(-1))) for k in range(blocks)]
    code = sum((p.cast("long") * base**k for k, p in enumerate(part)), F.lit(0).cast("long"))
    coded = prints.select("fp").where("fp is not null").distinct().withColumn("code", code)
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / tile).alias("subs"))
    tiles = cut(
        coded.join(sizes, "code")
        .groupBy("code", F.pmod(F.xxhash64("fp"), F.col("subs")).alias("sub"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, d)) <= radius and d >= (0,) * blocks]
    near = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in steps])
    digit = [(F.col("code") / F.lit(base**k)).cast("long") % base + F.col(f"step.d{k}") for k in range(blocks)]
    ok = F.lit(True)
    for x in digit:
        ok = ok & x.between(0, width)
    left = (
        tiles.withColumn("step", F.explode(near)).where(ok)
        .select(F.col("code").alias("code_a"), F.col("sub").alias("sub_a"), F.col("fps").alias("fps_a"),
                sum((x * base**k for k, x in enumerate(digit)), F.lit(0)).alias("code"))
    )
    pairs = left.join(tiles, "code").where("code_a <> code or sub_a <= sub")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                _tile_links(np.asarray(a).view(np.uint64), np.asarray(b).view(np.uint64), radius, same)
                for a, b, same in zip(frame.fps_a, frame.fps, frame.same, strict=True)
            ]
            got = np.concatenate(out).view(np.int64) if out else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    return pairs.select("fps_a", "fps", F.expr("code_a = code and sub_a = sub").alias("same")).mapInPandas(compared, "a long, b long")


def classes(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, component_id) from (fp, first_id), one row a fingerprint: the smallest id of its component."""
    roots = components(links(nodes, radius, blocks), "a", "b").withColumnRenamed("node", "fp")
    rooted = cut(nodes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row of df; other columns are not looked at.

    component_id is the smallest id that links of at most `radius` differing bits reach, itself
    included. Null and empty texts have fingerprint zero and link like any other. Null ids never
    name a component unless it has no other id; repeated rows come back as often as they came.
    An empty table gives an empty result. Equal fingerprints meet only in a grouped minimum, so
    copies are never expanded into pairs.
    """
    prints = cut(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    return prints.join(classes(nodes, radius, blocks), "fp").select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id")


def numbered(df: DataFrame, made: Column) -> DataFrame:
    """(row, made, no) with each row of df whole in one struct, so that no column's name can clash, and numbered.

    The table is cut to the shared folder, so that a row lost and read again has the same number.
    """
    whole = F.struct(*[F.col(f"`{x}`") for x in df.columns])
    return cut(df.select(whole.alias("row"), made.alias("made"), F.monotonically_increasing_id().alias("no")))


def rank(id_col: str) -> Column:
    """By this order the first row of a group stays: rows with an id before those without, then the smaller id, then the earlier row."""
    key = F.col(f"row.`{id_col}`")
    return F.struct(key.isNull().alias("none"), key.alias("id"), F.col("no").alias("row"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """The rows of df, with all their columns, of which each group of near-duplicates keeps one: that with the smallest id.

    Rows with an id come before those without; among rows with equal ids the first in the table stays. Null and empty
    texts are near-duplicates of each other; an empty table gives an empty result; columns of df come back untouched, whatever their names.
    """
    rows = numbered(df, fingerprint_column(F.col(text_col), shingle))
    nodes = cut(rows.groupBy(F.col("made").alias("fp")).agg(F.min(rank(id_col)).alias("first_id")))
    kept = nodes.join(classes(nodes, radius, blocks), "fp").where(F.col("first_id.row") == F.col("component_id.row")).select(F.col("first_id.row").alias("no"))
    return rows.join(kept, "no", "left_semi").select("row.*")
