"""Connected components of an edge table, as joins and grouped minima over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import cut, discard


def _minimum(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link up at most, and those that links lead to have none: each component is then a star around its root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node of its component.

    Alternates large-star and small-star: each round links a node's larger (then smaller)
    neighbours to the smallest one, which halves path lengths. The hub of a large component
    is met by grouped minima (map-side combined) and by a join whose hot side Spark may split,
    never by collecting a neighbourhood. Each round is cut to the shared folder, and they end when all components are stars;
    links always lead to a smaller node, so a star's root is its smallest. Nulls and self-links are ignored. A run that has not converged after
    `rounds` rounds raises rather than returning a partial result.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if _stars(now):
            break
        arcs = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            arcs.join(_minimum(arcs), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        down = large.join(_minimum(large), "u")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        last, now = now, cut(small.where("u <> v").distinct())
        discard(last)
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
