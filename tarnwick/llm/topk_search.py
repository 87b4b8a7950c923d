"""Exact top-k search by inner product with MaxScore over shards of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import cut

#: Vectors of a shard, at most about; fewer if that keeps more tasks busy, but not below the second.
SHARD, LEAST_SHARD = 8_192, 1_024


class Shard:
    """Postings of one shard: for each term (component) the values of all vectors, and their bounds."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.lists = rows[order], ids[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)

    def top(self, query: np.ndarray, own: int, k: int, probe: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but that of row `own`, ties to the smaller id.

        A term adds between its least and its most in this shard, so each vector's score starts from the sum of all least
        ones. Terms that together cannot lift a vector to the k-th best score so far are non-essential: only the
        others are traversed, and vectors that could still reach that score are probed in the
        rest, a few terms at a time, the strongest first.
        """
        least = np.where(query >= 0, query * self.low, query * self.high)
        spread = np.where(query >= 0, query * self.high, query * self.low) - least
        terms = np.argsort(-spread, kind="stable")
        after = np.concatenate([np.cumsum(spread[terms][::-1])[::-1], [0]]) + 0  # what terms from here on can add
        base = least.sum()
        strongest = self.lists[terms[0]] * query[terms[0]]
        allowed = self.rows != own
        seed = np.argpartition(-strongest, min(4 * k + 1, len(strongest) - 1))[: 4 * k + 2]
        seed = seed[allowed[seed]]
        if len(seed) >= k:
            bar = np.sort(query @ self.lists[:, seed])[-k]
        else:
            bar = base
        essential = max(1, int(np.searchsorted(-(base + after), -bar, "right")))
        essential = min(essential, len(terms))
        first = terms[:essential]
        score = query[first] @ self.lists[first] + least[terms[essential:]].sum()
        alive = np.flatnonzero((score + after[essential] >= bar) & allowed)
        score = score[alive]
        for at in range(essential, len(terms), probe):
            some = terms[at : at + probe]
            score = score + query[some] @ self.lists[np.ix_(some, alive)] - least[some].sum()
            stay = score + after[min(at + probe, len(terms))] >= bar
            alive, score = alive[stay], score[stay]
            if len(score) > k:
                bar = max(bar, np.partition(score, -k)[-k])
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[best]], score[best]


def _matrix(vectors: list, width: int) -> np.ndarray:
    """floor(256 x) of each component, padded with zeros or cut to the width."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.floor(256 * np.asarray(v, np.float64))[:width]
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As they are if 53 bits hold every sum that can arise, else as Python's whole numbers."""
    if a.shape[1] * max(1, np.abs(a).max(initial=0)) * max(1, np.abs(b).max(initial=0)) * 4 < 2**53:
        return a, b
    return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b))


def searchable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score): the k best by inner product of floor(256 x) among all rows but the query's own.

    The queries are the rows for which is_query holds. Rows are numbered and dealt into shards. Each shard is sent to its task once and
    held there while all queries stream past it in batches, each answered by MaxScore; a shard returns at most k rows a query, and a window
    merges them. Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part; shorter vectors (empty
    ones too) count as padded with zeros, longer ones score by what both have. Repeated rows are candidates and queries as often as they come: a
    row excludes itself alone, and each of several queries with one id has its own ranks. Ties go to the smaller id. Scores beyond 64
    bits are held at the largest long. An empty table gives an empty result; other columns are not looked at.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(rows.where(F.col("id").isNotNull() & searchable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()))
    n, spread = rows.count(), 2 * df.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard), min(spread, n // LEAST_SHARD))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(0).alias("asks"), "row", "id", "v")
    asking = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"), "row", "id", "v")

    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gathered, part = None, [], None
        for frame in frames:
            for (number, asks), some in frame.groupby(["shard", "asks"], sort=True):
                if number != now:
                    now, gathered, part = number, [], None
                if not asks:
                    gathered.append(some)
                    continue
                if not gathered:
                    continue
                if part is None:
                    whole = pd.concat(gathered)
                    width = max(1, max(map(len, whole.v)))
                    matrix, part = _matrix(list(whole.v), width), whole
                queries = _matrix(list(some.v), width)
                stored, wanted = _exact(matrix, queries)
                if not isinstance(part, Shard) or part.lists.dtype != stored.dtype:
                    part = Shard(whole.row.to_numpy(), whole.id.to_numpy(), stored)
                out = []
                for row, own, query in zip(some.row, some.id, wanted, strict=True):
                    best, score = part.top(query, row, k)
                    out += [(row, own, i, max(-(2**63), min(2**63 - 1, int(s)))) for i, s in zip(best, score, strict=True)]
                yield pd.DataFrame(out, columns=["row", "query_id", "id", "score"])

    met = held.union(asking).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInPandas(answered, "row long, query_id long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
