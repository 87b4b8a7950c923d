"""Structured data inside pages: JSON in scripts as VARIANT, postings found at any depth, embedded states."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.dates import posted_date
from tarnwick.functions.text import let, plain_html, unescaped
from tarnwick.session import settled

#: Fixed keys that lead from one node of linked data to others.
LINKS = ("@graph", "itemListElement", "item", "mainEntity")
#: Fixed words of work from anywhere.
REMOTE = r"(?i)\b(remote|fully remote|100% remote|télétravail|teletrabajo|remoto|home ?office|fjernarbeid|distans|zdalna|praca zdalna|uzaktan|la distanță|la distanta|na dálku|etätyö|thuiswerk)\b"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of landed files, one page each; an empty file is none."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def scripts(html: Column, mark: str) -> Column:
    """The contents of the scripts whose tag holds `mark` (a pattern), in order; a script that is never closed is none.

    The page is split at the ends of scripts, and a tag ends before the next `<`, so that each character is read a few times at most.
    """
    pieces = F.split(F.coalesce(html, F.lit("")), r"(?i)</script\s*>", -1)
    tag = rf"(?is)<script(?=[^<>]*{mark})[^<>]*+>"
    closed = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: p.rlike(tag))
    return F.transform(closed, lambda p: F.regexp_extract(p, tag + "(.*)$", 1))


def json_after(text: Column, marker: str) -> Column:
    """The JSON value behind the first `marker`, white space and equals signs, as VARIANT; what follows the value is not read. Null if there is none."""
    at = F.locate(marker, F.coalesce(text, F.lit("")))
    return F.when(at > 0, F.try_parse_json(F.ltrim(F.substring(text, at + len(marker), F.char_length(text)), F.lit(" \t\r\n="))))


def next_data(html: Column) -> Column:
    """The state that one framework puts into its pages, as VARIANT; null if there is none or it is malformed."""
    return F.try_parse_json(F.get(scripts(html, re.escape('id="__NEXT_DATA__"')), F.lit(0)))


def linked_nodes(df: DataFrame, key: str, html: str = "html", kind: str = "JobPosting") -> DataFrame:
    """(key, block, place, node) of every node of type `kind` in the linked data of pages, at any depth under LINKS and in lists.

    block counts the page's scripts and place is the way to the node. All pages descend together, level by level, each level a written table, so the depth of the deepest page is the number of rounds. Malformed scripts have no
    nodes; a value followed by other text counts up to there, and an object that has a key twice is malformed.
    """
    roots = df.select(F.col(key), F.posexplode(F.transform(scripts(F.col(html), r"application/ld\+json"), F.try_parse_json)).alias("block", "node"))
    level = settled(roots.where("node IS NOT NULL").withColumn("place", F.lit("")))
    found = []
    while not level.isEmpty():
        node = F.col("node")
        own = F.coalesce(F.try_variant_get(node, "$['@type']", "array<string>"), F.array(F.try_variant_get(node, "$['@type']", "string")))
        found.append(level.where(F.array_contains(own, kind)))
        item = lambda at, v: F.struct(at.alias("at"), v.alias("v"))
        listed = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v, i: item(F.concat(F.lit("/"), i.cast("string")), v))
        below = F.array(*[item(F.lit(f"/{k}"), F.try_variant_get(node, f"$['{k}']", "variant")) for k in LINKS])
        level = settled(level.select(key, "block", "place", F.explode(F.coalesce(listed, below)).alias("x")).where("x.v IS NOT NULL").select(key, "block", F.concat("place", "x.at").alias("place"), F.col("x.v").alias("node")))
    out = found[0] if found else level
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(key, "block", "place", "node")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.coalesce(text, F.lit(""))), r"\s+", " "))


def with_country(place: Column, country: str, aliases: Sequence[str] = ()) -> Column:
    """The place, and the country behind it unless the place names it already."""

    def joined(p: Column) -> Column:
        named = F.lit(False)
        for name in (country, *aliases):
            named = named | F.lower(p).contains(name.lower()) if name else named
        return F.when(p == "", country).when(named, p).otherwise(F.concat(p, F.lit(f", {country}")))

    return let(F.trim(clean(place), F.lit(" ,-·|")), joined)


def posting_rows(nodes: DataFrame, key: str, country: str, today: Column, aliases: Sequence[str] = (), default_url: Column | None = None) -> DataFrame:
    """(key, title, company, place, url, description, posted, remote) of the nodes of linked_nodes(): expired ones and those without title or URL are left out.

    The place is the first address that names a town or region. A posting is remote if it says so by its type, or its title or place do.
    """
    node = F.col("node")
    said = lambda path: F.try_variant_get(node, path, "string")
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    firm = F.try_variant_get(node, "$.hiringOrganization", "variant")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    company = F.when(is_object(firm), F.try_variant_get(firm, "$.name", "string")).otherwise(F.try_variant_get(firm, "$", "string"))
    places = F.coalesce(F.try_variant_get(node, "$.jobLocation", "array<variant>"), F.array(F.try_variant_get(node, "$.jobLocation", "variant")))
    town = lambda v: F.array_join(F.filter(F.array(*[clean(F.try_variant_get(v, f"$.address.{c}", "string")) for c in ("addressLocality", "addressRegion")]), lambda x: x != ""), ", ")
    place = F.coalesce(F.get(F.filter(F.transform(places, town), lambda x: x != ""), F.lit(0)), F.lit(""))
    url = F.trim(F.coalesce(given(said("$.url")), default_url if default_url is not None else F.lit(""), F.lit("")))
    rows = nodes.select(
        key, clean(F.coalesce(given(said("$.title")), said("$.name"))).alias("title"), clean(company).alias("company"), with_country(place, country, aliases).alias("place"), url.alias("url"),
        plain_html(F.coalesce(said("$.description"), F.lit(""))).alias("description"), posted_date(said("$.datePosted"), today).alias("posted"), F.coalesce(posted_date(said("$.validThrough"), today) < today, F.lit(False)).alias("expired"),
        F.coalesce(F.upper(said("$.jobLocationType")) == "TELECOMMUTE", F.lit(False)).alias("far"),
    )
    rows = rows.where("title <> '' AND url <> '' AND NOT expired")
    return rows.withColumn("remote", F.col("far") | F.concat_ws(" ", "title", "place").rlike(REMOTE)).drop("expired", "far")
