"""Faceted search: rows under chosen values, and what each other value would give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passes(values: dict[str, Column], chosen: dict[str, Sequence[str]]) -> Column:
    """AND across facets, OR within: a facet with nothing chosen lets everything pass."""
    out = F.lit(True)
    for facet, wanted in chosen.items():
        if wanted:
            out = out & F.coalesce(F.arrays_overlap(values[facet], F.array(*map(F.lit, wanted))), F.lit(False))
    return out


def faceted(df: DataFrame, values: dict[str, Column], chosen: dict[str, Sequence[str]], rank: Column, hours: Column, tie: str, recent: bool = False) -> DataFrame:
    """The rows that pass, the youngest first (unknown ages count 999 hours) or the best ranked (unknown 0)."""
    order = [F.coalesce(hours, F.lit(999)).asc()] if recent else [F.coalesce(rank, F.lit(0)).desc()]
    return df.where(passes(values, chosen)).orderBy(*order, tie)


def facet_counts(df: DataFrame, values: dict[str, Column], chosen: dict[str, Sequence[str]], where: Column | None = None) -> DataFrame:
    """(facet, value, n): how many rows each value would give under the values chosen of all other facets (and `where`).

    A row counts for a facet if it fails no other one. One pass: a row that fails none counts for all facets, one that fails a single one for that alone, others for none; values are
    counted before they are shuffled, so a value that most rows have is no hot key.
    """
    failed = F.array_compact(F.array(*[F.when(~passes(values, {f: w}), f) for f, w in chosen.items() if w])) if any(chosen.values()) else F.array().cast("array<string>")
    rows = df if where is None else df.where(where)
    rows = rows.select(failed.alias("failed_"), *[v.alias(f"v_{f}") for f, v in values.items()]).where(F.size("failed_") <= 1)
    counted = F.filter(F.array(*[F.struct(F.lit(f).alias("facet"), F.array_distinct(f"v_{f}").alias("values")) for f in values]), lambda x: (F.size("failed_") == 0) | (F.get("failed_", F.lit(0)) == x["facet"]))
    told = rows.select(F.explode(counted).alias("x")).select("x.facet", F.explode("x.values").alias("value"))
    return told.groupBy("facet", "value").agg(F.count("*").alias("n"))
