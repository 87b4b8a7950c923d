"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import WORD, cut

WEIGHTS = (3, 1, 2)
#: Inclusion weight of a document of 2^c words and more: PER // (1 + c). Integers, so that sums are exact.
PER = 27_720


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(df: DataFrame, parts: list[str], total: str, cap: str, weight: str, tie: str, out: str) -> DataFrame:
    """Adds `out`: `total` shared by weight within each part, none above its cap, the excess shared again by weight.

    Members are ordered by the level at which they fill up; the first that the rest does not fill sets the
    level of all after it, which is what sharing the excess again and again comes to.
    """
    within = Window.partitionBy(*parts)
    order = within.orderBy(F.col(cap) / F.col(weight), tie)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum(weight).over(within) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    ranked = df.withColumn("_level", level.cast("double")).withColumn("_no", F.row_number().over(order))
    ranked = ranked.withColumn("_open", F.min(F.when(F.col("_level") * F.col(weight) <= F.col(cap), F.struct("_no", "_level"))).over(within))
    share = F.when(F.col("_open").isNull(), F.col(cap).cast("double")).otherwise(F.least(F.col(cap).cast("double"), F.col("_open._level") * F.col(weight)))
    return ranked.withColumn(out, share).drop("_level", "_no", "_open")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so the windows here see as many rows as there are sources."""
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(no - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"), no.alias("no"), F.lit(0).alias("all"))
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy("all")) * F.lit(float(share))).withColumn("cap", F.col("source_size") * most)
    return water_fill(rows, ["all"], "total", "cap", "weight", "no", "target").select("source", "source_size", "target")


def uniform(key: Column) -> Column:
    """A number between 0 and 1 that depends on the key alone: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)


def _bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Cut, and marked for broadcast only if it has at most `most` (narrow) rows; beyond that joins shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def mix(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: int = 2) -> DataFrame:
    """(row, size, source_size, target, copies, taken) for each row of df; `row` holds its columns named in `keep`.

    A source's target is dealt to classes of documents (by powers of two of the size) with
    weights that fall with the size, none above `most` copies. A document's expected
    copies are its class's; the whole part is certain, the rest is its inclusion probability p. Documents
    are ranked by (u / (1-u)) / (p / (1-p)), u uniform and fixed by the id, and the first are taken until the
    source's words come as near to the rest of its target as whole documents allow.

    Sizes are counted once and cut to the shared folder with the kept columns. The rank is cut in two: about sqrt(n)
    ranges of a source are summed, and only the range in which the target falls is ordered
    document by document, so no task sees a whole source. Null texts have size 0 and are never taken;
    null sources are one source, the last; equal ids rank by their text; an empty table gives an
    empty result; columns that are not kept are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.struct(*keep).alias("row"), F.col(source_col).alias("src"), words(text).alias("size"), F.xxhash64(text).alias("tie"),
        uniform(F.coalesce(F.col(id_col).cast("string"), F.md5(text))).alias("u"),
    ).withColumn("class", (F.length(F.bin("size")) - 1).cast("int"))
    rows = cut(rows)
    classes = rows.groupBy("src", "class").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sizes = targets(classes.groupBy(F.col("src").alias("source")).agg(F.sum("words").alias("source_size")), share, most)
    known = classes.join(sizes, F.col("src").eqNullSafe(F.col("source"))).drop("source").withColumn("cap", F.col("words") * most)
    known = known.withColumn("weight", F.greatest(F.lit(1).cast("long"), F.col("words") * F.floor(F.lit(PER) / (F.col("class") + 1))))
    known = water_fill(known, ["src"], "target", "cap", "weight", "class", "share")
    known = known.withColumn("copies", F.when(F.col("words") > 0, F.col("share") / F.greatest("words", F.lit(1))).otherwise(0.0))
    known = known.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.floor("copies"))
    within = Window.partitionBy("src")
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(within)
    cuts = F.greatest(F.lit(1), F.ceil(F.sqrt(F.sum("n").over(within)))).cast("long")
    facts = _bounded(known.select(F.col("src").alias("s"), F.col("class").alias("c"), "source_size", "target", "whole", "p", rest.alias("rest"), cuts.alias("cuts")))
    rows = rows.join(facts, F.col("src").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, odds / (1 + odds))).withColumn("cut", F.floor(F.col("q") * F.col("cuts")))

    sums = rows.where("cut is not null").groupBy("src", "cut").agg(F.sum("size").alias("inside"), F.max("rest").alias("rest"))
    upto = F.sum("inside").over(Window.partitionBy("src").orderBy("cut"))
    sums = sums.withColumn("before", upto - F.col("inside"))
    edge = F.when(F.col("before") + F.col("inside") >= F.col("rest"), F.struct("cut", "before"))
    bound = _bounded(sums.groupBy(F.col("src").alias("bs")).agg(F.min(edge).alias("edge")))
    rows = rows.join(bound, F.col("src").eqNullSafe(F.col("bs")), "left")
    at_edge = F.coalesce(F.col("cut") == F.col("edge.cut"), F.lit(False))
    chosen = F.coalesce((F.col("cut") < F.coalesce("edge.cut", F.col("cuts") + 1)).cast("long"), F.lit(0))
    clear = rows.where(~at_edge).withColumn("more", chosen)
    order = Window.partitionBy("src").orderBy("q", "u", "tie").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("edge.before") + F.sum("size").over(order)
    edged = rows.where(at_edge).withColumn("more", (run - F.col("size") / 2 <= F.col("rest")).cast("long"))
    return clear.unionByName(edged).withColumn("copies", F.col("whole") + F.col("more")).select(
        "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
