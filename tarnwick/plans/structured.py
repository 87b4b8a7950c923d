"""Pages with structured data put into them, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.session import table
from tarnwick.sources import structured as S

TODAY = "2026-01-15"
_NODE = (
    '{"@type":%s,"title":"Cook &amp; baker <n>","name":"not this","url":%s,"validThrough":"%s","hiringOrganization":%s,"jobLocation":%s,"jobLocationType":%s,"description":"<p>Bake <b>bread<\\/b> &amp; pies<\\/p>","datePosted":%s}'
)
#: Nodes by the remainder of a page's id, and what stands around them; the fifth is cut off, the last has no script.
_KINDS = (
    _NODE % ('"JobPosting"', '"https://a.example/<n>"', "2026-02-01T00:00:00", '{"@type":"Organization","name":"Acme  Ltd"}', '{"address":{"addressLocality":"Iasi","addressRegion":"IS"}}', '"TELECOMMUTE"', '"2026-01-03"'),
    _NODE % ('"JobPosting"', "null", "", '"Baker Sons"', '[null,{"address":"street"},{"address":{"addressLocality":"Cluj, Romania"}}]', "null", "1767225600"),
    _NODE % ('"JobPosting"', '" https://b.example/<n> "', "2026-01-14", "null", "[]", "null", '"gestern"'),
    _NODE % ('["Thing","JobPosting"]', '""', "soon", '{"name":null}', '{"address":{"addressRegion":" - "}}', '"telecommute"', '"vor 3 Wochen"'),
)
_AROUND = ('%s', '[{"@type":"Organization"},%s]', '{"@context":"x","@graph":[{"@type":"WebSite"},[%s]]}', '{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":%s}]}', '{"@type":"WebPage","mainEntity":{"item":%s}}', '[%s', None)


def _pages(s: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    node = F.get(F.array(*map(F.lit, _KINDS)), (F.floor(n / 7) % 4).cast("int"))
    around = F.get(F.array(*map(F.lit, _AROUND)), (n % 7).cast("int"))
    script = F.concat(F.lit("<SCRIPT async type='application/ld+json'>\n"), F.replace(F.replace(around, F.lit("%s"), node), F.lit("<n>"), n.cast("string")), F.lit("\n</Script >"))
    return table(s, d, "pages").select("page_id", "url", F.concat(F.coalesce(script, F.lit("")), F.coalesce("html", F.lit("")), F.lit("<script type=application/ld+json>{\"@type\":")).alias("html"))


def page_postings(s: SparkSession, d: str) -> DataFrame:
    pages = _pages(s, d)
    nodes = S.linked_nodes(pages, "page_id").join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    return S.posting_rows(nodes, "page_id", "Romania", F.lit(TODAY).cast("date"), ("România", "RO"), F.col("page_url"))


def page_states(s: SparkSession, d: str) -> DataFrame:
    """States behind a marker and in a framework's script; every fifth is malformed."""
    n = F.col("page_id")
    cut = F.when(n % 5 == 0, "").otherwise("}")
    after = F.concat(F.lit("<script>var a=1; window.__STATE__ = \n {\"n\":"), n.cast("string"), F.lit(",\"tags\":[\"a}\",\"</b>\"]"), cut, F.lit("; var b={};</script>"), F.coalesce("html", F.lit("")))
    page = F.concat(after, F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"n":'), (n * 2).cast("string"), F.lit("}}"), cut, F.lit("</script>"))
    state: Column = S.json_after(page, "window.__STATE__")
    props = S.next_data(page)
    return table(s, d, "pages").select(
        "page_id", F.try_variant_get(state, "$.n", "long").alias("n"), F.try_variant_get(state, "$.tags[0]", "string").alias("tag"), F.try_variant_get(props, "$.props.pageProps.n", "long").alias("twice"), S.json_after(page, "no such marker").isNull().alias("none"),
    )


SQL = {
    "page_postings": f"""WITH p AS (SELECT page_id, url AS page_url, page_id // 7 % 4 AS k FROM pages WHERE page_id % 7 < 5),
        r AS (SELECT *, 'Cook & baker ' || page_id AS title, CASE k WHEN 0 THEN 'Acme Ltd' WHEN 1 THEN 'Baker Sons' ELSE '' END AS company, CASE k WHEN 0 THEN 'Iasi, IS, Romania' WHEN 1 THEN 'Cluj, Romania' ELSE 'Romania' END AS place,
            CASE k WHEN 0 THEN 'https://a.example/' || page_id ELSE page_url END AS url, CASE k WHEN 0 THEN DATE '2026-01-03' WHEN 1 THEN DATE '2026-01-01' ELSE DATE '{TODAY}' - 21 END AS posted, k IN (0, 3) AS remote FROM p WHERE k <> 2)
        SELECT page_id, title, company, place, url, 'Bake bread & pies' AS description, posted, remote FROM r""",
    "page_states": "SELECT page_id, CASE WHEN page_id % 5 > 0 THEN page_id END AS n, CASE WHEN page_id % 5 > 0 THEN 'a}' END AS tag, CASE WHEN page_id % 5 > 0 THEN page_id * 2 END AS twice, true AS none FROM pages",
}
QUERIES = {name: globals()[name] for name in SQL}
