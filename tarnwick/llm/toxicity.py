"""Toxicity by non-negative positive-unlabelled learning over words and their beginnings."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import crc32_mod, cut
from tarnwick.llm.simhash_dedup import _word_blocks

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
BUCKETS = 1 << 22
#: Defaults of fit(): rows that the classifier is fitted on, at most (confirmed toxic ones, unlabelled ones), and features kept, at most. None takes all.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 10_000, 20_000, 4_096
_EDGE = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 128))


BEGINNINGS, LEVELS = (4, 5, 6), 4
#: Words that a scoring worker remembers as carrying no feature of the model.
REMEMBERED = 400_000


def _folded(word: bytes) -> str:
    return word.strip(_EDGE).decode("utf-8", "replace").lower()


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def buckets(found: set[str]) -> np.ndarray:
    """Sorted buckets of distinct words and of how they begin: one for a beginning, one more for each further word with it, up to LEVELS."""
    begun = Counter(w[:n] for w in found for n in BEGINNINGS if len(w) >= n)
    grams = [f"{w}$" for w in found] + [f"{b}^{k}" for b, n in begun.items() for k in range(min(n, LEVELS))]
    return np.unique(np.fromiter(map(_bucket, grams), np.int64, len(grams))) if grams else np.zeros(0, np.int64)


def features(text: str | None) -> np.ndarray:
    """Buckets of a whole text. Letters are folded in case, marks at the edges of words are dropped."""
    found: set[str] = set()
    for words in _word_blocks((text or "").encode("utf-8", "replace")):
        found.update(map(_folded, set(words)))
    found.discard("")
    return buckets(found)


class Reader:
    """Positions in `kept` of a text's buckets. Words without any are remembered, so that most cost a set difference."""

    def __init__(self, kept: np.ndarray) -> None:
        self.kept, self.wanted, self.plain = kept, set(kept.tolist()), set()

    def tells(self, word: str) -> bool:
        return _bucket(f"{word}$") in self.wanted or any(_bucket(f"{word[:n]}^{k}") in self.wanted for n in BEGINNINGS if len(word) >= n for k in range(LEVELS))

    def positions(self, text: str | None) -> np.ndarray:
        found: set[str] = set()
        if len(self.plain) > REMEMBERED:
            self.plain.clear()
        for words in _word_blocks((text or "").encode("utf-8", "replace")):
            for raw in set(words) - self.plain:
                word = _folded(raw)
                if word and self.tells(word):
                    found.add(word)
                else:
                    self.plain.add(raw)
        return _positions(buckets(found), self.kept)


@dataclass
class Model:
    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_margins(found, self.weights, self.bias), -40, 40)))


def _margins(found: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    sizes = [len(x) for x in found]
    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
    return bias + np.bincount(np.repeat(np.arange(len(found)), sizes), weights=weights[flat], minlength=len(found))


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on the whole of both sets.

    risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]), with logistic losses. Where the
    second term falls below zero, the step goes against it alone, so that the classifier doesn't learn unlabelled rows by heart.
    """
    both = [*positive, *unlabelled]
    n, m = len(positive), len(unlabelled)
    rows = np.repeat(np.arange(n + m), [len(x) for x in both])
    flat = np.concatenate(both) if both else np.zeros(0, np.int64)
    parameters, first, second = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    parameters[-1] = np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        margin = parameters[-1] + np.bincount(rows, weights=parameters[flat], minlength=n + m)
        chance = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        negative = np.logaddexp(0, margin)  # the loss of calling a row toxic when it is not
        rest = negative[n:].mean() - prior * negative[:n].mean()
        up = np.zeros(n + m)
        if rest >= 0:
            up[:n] = prior / n * (chance[:n] - 1) - prior / n * chance[:n]
            up[n:] = chance[n:] / m
        else:
            up[:n], up[n:] = prior / n * chance[:n], -chance[n:] / m
        slope = np.append(np.bincount(flat, weights=up[rows], minlength=n_features), up.sum())
        slope[:-1] += decay * parameters[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        parameters -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return parameters[:-1], float(parameters[-1])


def chosen(each: DataFrame, n: int, m: int, most: int | None = MOST_FEATURES, least: float = 4.0, purest: int = 20) -> tuple[np.ndarray, float]:
    """Buckets of each(bucket, pos, unl) that stand out among the n positive rows against the m unlabelled ones, the `most` most telling; and the share of
    unlabelled rows that are positive: what the `purest` most telling buckets have there against what they have among positive rows.

    Spark counts, ranks and cuts; the driver receives the kept ones.
    """
    a, b = F.col("pos") / n, F.col("unl") / m
    pooled = (F.col("pos") + F.col("unl")) / (n + m)
    z = (a - b) / F.sqrt(F.greatest(pooled * (1 - pooled) * (1 / n + 1 / m), F.lit(1e-12)))
    ranked = each.where(F.col("pos") >= 3).select("bucket", a.alias("a"), b.alias("b"), z.alias("z")).where((F.col("z") >= least) & (F.col("a") >= 2 * F.col("b"))).orderBy(F.desc("z"), "bucket")
    rows = (ranked if most is None else ranked.limit(most)).collect()
    top = rows[:purest]
    share = sum(r.b for r in top) / sum(r.a for r in top) if top else 1.0
    return np.sort(np.array([r.bucket for r in rows], np.int64)), share


def gathered(rows: DataFrame, kept: np.ndarray) -> dict[int, list[np.ndarray]]:
    """Positions in `kept` of each row's buckets, by p; they come packed, four bytes a position, some rows at a time."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_positions(np.asarray(x, np.int64), kept).astype("<i4") for x in frame.found]
            yield pd.DataFrame({"p": [frame.p.to_numpy("i1").tobytes()], "sizes": [np.array([len(x) for x in found], "<i4").tobytes()], "flat": [np.concatenate(found).tobytes() if found else b""]})

    sets: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in rows.select("p", "found").mapInPandas(packed, "p binary, sizes binary, flat binary").collect():
        parts = np.split(np.frombuffer(r.flat, "<i4").astype(np.int64), np.cumsum(np.frombuffer(r.sizes, "<i4"))[:-1]) if r.p else []
        for p, x in zip(np.frombuffer(r.p, "i1"), parts, strict=True):
            sets[int(p)].append(x)
    return {p: sorted(x, key=lambda v: (len(v), v.tobytes())) for p, x in sets.items()}


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_positive: int | None = MOST_POSITIVE, most_unlabelled: int | None = MOST_UNLABELLED, most_features: int | None = MOST_FEATURES,
) -> Model:
    """A model from confirmed toxic rows and rows taken as unlabelled, none of them in the held-out fold.

    Unlabelled rows are any rows but the confirmed ones' duplicates of id, whatever their label says; the prior is the share of toxic rows among the labelled, or what telling words say of the
    unlabelled rows, if that is less: with too high a prior the corrected risk falls below zero before the model has learnt.
    Both sets are bounded (rows with the smallest hash of their id), so what is counted, and the kept buckets of them that the driver receives, are too.
    """
    fold = crc32_mod(F.col("_id"), FOLDS)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id is not null and label is not null")
    known = known.where(fold != HELD_OUT).groupBy("_id").agg(F.max("label").alias("label"))
    n_known, n_toxic = known.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    n_rows = df.count()
    if not n_toxic or n_known == n_toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), -4.0 if not n_toxic else 4.0)
    prior = n_toxic / n_known
    h = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    share = lambda n, most: 1 << 20 if most is None else int((1 << 20) * min(1.0, most / max(n, 1)))
    drawn = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & (fold != HELD_OUT))
    confirmed = known.where("label = 1").where(h < share(n_toxic, most_positive)).select("_id")
    # ids of a bounded set of rows, 8 bytes each, unless the caller lifts the bound
    toxic = drawn.join(confirmed if most_positive is None else F.broadcast(confirmed), "_id").withColumn("p", F.lit(1))
    other = drawn.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 20)) < share(n_rows, most_unlabelled)).withColumn("p", F.lit(0))
    rows = cut(toxic.unionByName(other).select("p", features_column(F.col("_text")).alias("found")))
    sizes = dict(rows.groupBy("p").count().collect())
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    each = rows.select("p", F.explode("found").alias("bucket")).groupBy("bucket").agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("unl"))
    kept, share_seen = chosen(each, n, m, most_features)
    if not len(kept):
        return Model(kept, np.zeros(0), float(np.log(prior / (1 - prior))))
    sets = gathered(rows, kept)
    prior = min(0.9, max(1e-4, min(prior, share_seen)))
    weights, bias = learn(sets[1], sets[0], len(kept), prior)
    return Model(kept, weights, bias)


def features_column(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in texts], dtype=object)

    return made(text)


def _positions(found: np.ndarray, kept: np.ndarray) -> np.ndarray:
    at = np.searchsorted(kept, found)
    at[at == len(kept)] = 0
    return at[kept[at] == found] if len(kept) else np.zeros(0, np.int64)


def scored(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model.kept)
        for some in texts:
            yield pd.Series(model.score([reader.positions(x) for x in some]), dtype=float)

    return made(text)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row of df, learnt from labels outside the held-out fold.

    Null and empty texts have no features and get the score of the bias alone; null ids are never learnt from and count as not held
    out; repeated rows come back as often as they came; an empty table gives an empty result; equal texts get equal scores (ties), very long
    ones are read whole; without confirmed toxic rows all scores are near 0. Other columns are not looked at, whatever their names.
    """
    model = fit(df, labels, id_col, text_col, label_col)
    return df.select(F.col(id_col), (crc32_mod(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), scored(F.col(text_col), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
