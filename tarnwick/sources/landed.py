"""Landed files of many sources as one table, their state, and a safe export."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tarnwick.functions.text import csv_safe


def union_sources(spark: SparkSession, sources: dict[str, tuple[str, str]], schema: StructType, column: str = "site") -> tuple[DataFrame, dict[str, str]]:
    """(rows, failures): all sources, each a (format, path), in the given schema with the source's name beside.

    Missing columns are null and others are left out. A source that cannot be opened is named in `failures` with the reason
    and gives no rows; the rest is read all the same. Row counts are for source_status(), in one pass over the union.
    """
    parts, failures = [], {}
    for name, (kind, path) in sources.items():
        try:
            reader = spark.read.format(kind)
            found = (reader if kind == "parquet" else reader.schema(schema)).load(path)
        except AnalysisException as e:
            failures[name] = e.getCondition() or "UNKNOWN"
            continue
        fields = [(F.col(f"`{f.name}`") if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        parts.append(found.select(F.lit(name).alias(column), *fields))
    empty = spark.createDataFrame([], StructType().add(column, StringType()).add("_", StringType())).select(column, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    return reduce(DataFrame.unionByName, parts, empty) if not parts else reduce(DataFrame.unionByName, parts), failures


def source_status(rows: DataFrame, names: list[str], failures: dict[str, str], column: str = "site") -> DataFrame:
    """Per source its rows, and success, warning (opened but empty) or error."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(n, failures.get(n)) for n in names], f"{column} string, reason string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    joined = known.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return joined.select(column, F.when(F.col("reason").isNotNull(), "error").when(F.col("n") == 0, "warning").otherwise("success").alias("status"), "n")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset to offset + size of a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV export whose text cells cannot be read as formulas and hold no line breaks."""
    cells = [csv_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)
