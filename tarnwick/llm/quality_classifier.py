"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import crc32_mod, cut
from tarnwick.llm.simhash_dedup import _word_blocks

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
THRESHOLD = 0.3
#: Labelled rows that the model is fitted on, at most; those with the smallest hash of their id if there are more.
MOST_LABELLED = 200_000
BINS = 512
#: Texts that a Python worker turns into strings at once.
SLICE = 200

_MARKS = [b".", b",", b"!", b"?", b";:", b"|", b"#$%&*@^~+=<>\\", b"\"'`()[]{}", b"-_/"]
_CLASS = np.full(256, len(_MARKS) + 6)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 3, 4, 5
for _n, _some in enumerate(_MARKS):
    _CLASS[list(_some)] = 6 + _n
N_CLASSES = len(_MARKS) + 7
WIDTH = N_CLASSES + 11


def statistics(text: str | None) -> np.ndarray:
    """WIDTH numbers that describe a text: sizes, shares of kinds of characters, repetition of words and lines, compressibility."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(WIDTH)
    n = len(data)
    if not n:
        return out
    counts = np.zeros(256)
    n_words = letters = distinct = longest = shouted = marked = packed = 0
    tail = bytes(c for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in ".,")
    for words in _word_blocks(data):
        piece = b" ".join(words)
        packed += len(zlib.compress(piece, 1))
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        n_words, distinct = n_words + len(words), distinct + len(set(words))
        longest = max(longest, max(map(len, words), default=0))
        shouted += sum(map(bytes.isupper, words))
        marked += sum(w[-1] in tail for w in words)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    lines = data.split(b"\n")
    w = max(n_words, 1)
    np.add.at(out, _CLASS, counts)
    out[:N_CLASSES] = np.sqrt(out[:N_CLASSES] / n)
    out[N_CLASSES:] = (
        np.log1p(n), np.log1p(n_words), letters / w, distinct / w, np.log1p(longest), shouted / w, marked / w, packed / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    )
    return out


def table_of(texts: pa.Array) -> np.ndarray:
    """The statistics of texts, a row each; a few texts at a time become Python strings, however many there are."""
    rows = [statistics(x) for i in range(0, len(texts), SLICE) for x in texts.slice(i, SLICE).to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, WIDTH))


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(table_of(texts).ravel()), WIDTH).cast(pa.list_(pa.float64()))

    return made(text)


def score_column(model: Model, text: Column) -> Column:
    """The score of a text in one step, so that a task has one Python worker."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(table_of(texts)) if len(texts) else np.zeros(0))

    return scored(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        near = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.cos(near @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(rows), 1))], axis=1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated; a trace of the raw score keeps the order within flat stretches."""
        raw = self.raw(rows)
        return np.clip(0.998 * np.interp(raw, self.knots, self.levels) + 0.002 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30))), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to the values (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _summed(rows: DataFrame, made, columns: str = "no int, sums binary") -> np.ndarray:
    """The sum of what `made` returns for each partition's (rows, labels), added in the order of partitions."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = None
        for frame in frames:
            if len(frame):
                part = made(np.stack(frame.stats.to_numpy()), frame.label.to_numpy(float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"no": [TaskContext.get().partitionId()], "sums": [total.astype("<f8").tobytes()]})

    got = sorted((r.no, r.sums) for r in rows.select("stats", "label").mapInPandas(each, columns).collect())
    return sum(np.frombuffer(x, "<f8") for _, x in got) if got else np.zeros(0)


def fit(labelled: DataFrame, waves: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """A model from (stats, label, fold) rows: standardised, projected, solved from normal equations that partitions sum.

    The table is cut and has a bounded number of rows and partitions, so the driver receives some sums of (waves + 1)^2
    numbers. The fold CALIBRATION is left out of the ridge fit and calibrates it. Without labels
    of both kinds the score is the share of label 1 (or a half).
    """
    rng = np.random.default_rng(seed)
    moments = _summed(labelled, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)]))
    n, positive = (moments[0], moments[1]) if len(moments) else (0, 0)
    mean = moments[2 : 2 + WIDTH] / n if n else np.zeros(WIDTH)
    scale = np.sqrt(np.maximum(moments[2 + WIDTH :] / n - mean**2, 1e-8)) if n else np.ones(WIDTH)
    model = Model(mean, scale, rng.normal(0, 1 / width, (WIDTH, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.array([0.0]), np.array([positive / n if n else 0.5]))
    if not n or positive in (0, n):
        return model
    size = waves + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(labelled.where(F.col("fold") != CALIBRATION), equations)
    if not len(sums):
        return model
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    model.weights = np.linalg.solve(gram + ridge * max(gram[-1, -1], 1) / waves * np.eye(size), right)

    def tallied(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bins = np.clip((model.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(bins, minlength=BINS), np.bincount(bins, weights=y, minlength=BINS)])

    tally = _summed(labelled.where(F.col("fold") == CALIBRATION), tallied)
    if len(tally):
        seen, ones = tally[:BINS], tally[BINS:]
        used = np.flatnonzero(seen)
        model.knots = (used + 0.5) / BINS * 2 - 0.5
        model.levels = isotonic(ones[used] / seen[used], seen[used])
    return model


def known_labels(labels: DataFrame, id_col: str, label_col: str, most: int = MOST_LABELLED) -> DataFrame:
    """(_id, label) outside the held-out fold: at most about `most` rows, those with the smallest hash of their id."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).where("_id is not null and label is not null")
    known = known.where(crc32_mod(F.col("_id"), FOLDS) != HELD_OUT)
    n = known.count()
    return known if n <= most else known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))


def labelled_rows(stats: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """(stats, label, fold) of the known rows, in a bounded number of partitions; `known` is bounded, and so broadcast."""
    rows = stats.select(F.col(id_col).alias("_id"), "stats").join(F.broadcast(known), "_id")
    return cut(rows.select("stats", "label", crc32_mod(F.col("_id"), FOLDS).alias("fold"))).coalesce(16)


def scorer(model: Model):
    @F.pandas_udf("double")
    def scored(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0))

    return scored


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row of df, learnt from labels outside the held-out fold.

    Statistics of all texts are made once and cut to the shared folder; the fit uses labelled ones and the scores all of
    them. Null texts count as empty and get a score like any other; null ids are held out; repeated rows come
    back as often as they came, and equal texts score equally; very long texts are read whole; an empty table gives an empty result; other columns are not looked at.
    """
    stats = cut(df.select(F.col(id_col), statistics_column(F.col(text_col)).alias("stats")))
    model = fit(labelled_rows(stats, known_labels(labels, id_col, label_col), id_col))
    return stats.select(id_col, (crc32_mod(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), scorer(model)("stats").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, with all their columns whatever their names, that the classifier does not reject; nulls, repeats, long texts and empty tables as in score().

    Labelled rows are found first, so that statistics are made for them alone before the fit, and then for each row where it lies:
    no text is shuffled.
    """
    known = known_labels(labels, id_col, label_col)
    some = df.select(F.col(id_col), F.col(text_col)).join(F.broadcast(known.select(F.col("_id").alias(id_col))), id_col, "left_semi")
    model = fit(labelled_rows(some.select(id_col, statistics_column(F.col(text_col)).alias("stats")), known, id_col))
    return df.where(score_column(model, F.col(text_col)) >= threshold)
