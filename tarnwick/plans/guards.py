"""Guards over the supplied tables, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import hosts as H
from tarnwick.session import table

#: First bytes of the addresses that stand for pages' hosts: of reserved blocks and of public ones.
FIRST_BYTES = (10, 127, 169, 172, 192, 198, 203, 224, 8, 93)


def safe_urls(s: SparkSession, d: str) -> DataFrame:
    """Each page's URL, and the same path on a numeric host made of its id, written in one of five ways."""
    k = F.col("page_id")
    first = F.element_at(F.array(*map(F.lit, FIRST_BYTES)), (k % 10 + 1).cast("int"))
    number = (first.cast("long") * 16777216 + (k * 40503 * 16 + F.char_length("html") * 257) % 16777216).cast("long")
    part = lambda shift: F.shiftright(number, shift).bitwiseAND(255)
    octal = lambda x: F.concat(F.lit("0"), F.conv(x.cast("string"), 10, 8))
    spelled = (
        F.when(k % 5 == 0, F.concat_ws(".", part(24), part(16), part(8), part(0))).when(k % 5 == 1, number.cast("string")).when(k % 5 == 2, F.concat(F.lit("0x"), F.lower(F.hex(number))))
        .when(k % 5 == 3, F.concat_ws(".", octal(part(24)), octal(part(16)), number.bitwiseAND(65535))).otherwise(F.concat(F.lit("[2a00::"), F.lower(F.hex(part(16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(65535))), F.lit("]")))
    )
    moved = F.concat(F.lit("http://user@"), spelled, F.lit(":"), (k * 977 % 70000).cast("string"), F.lit("/"), F.element_at(F.split("url", "/"), -1))
    return table(s, d, "pages").select("page_id", H.public_url(F.col("url")).alias("public"), H.public_url(moved).alias("moved_public"))


_BYTE = "list_extract([" + ", ".join(map(str, FIRST_BYTES)) + "], CAST(page_id % 10 + 1 AS INTEGER))"
SQL = {
    "safe_urls": rf"""WITH p AS (SELECT page_id, url, {_BYTE} AS a, (page_id * 40503 * 16 + length(html) * 257) % 16777216 AS rest FROM pages),
        h AS (SELECT *, rest // 65536 AS b, rest // 256 % 256 AS c, rtrim(lower(regexp_extract(url, '^https?://(?:[^/?#]*@)?([^/?#:@]+)', 1)), '.') AS name FROM p)
        SELECT page_id, name <> '' AND name <> 'localhost' AND NOT regexp_matches(name, '\.(local|internal|localhost)$') AS public,
            page_id * 977 % 70000 <= 65535 AND (page_id % 5 = 4 OR NOT (a IN (10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2))
                OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))) AS moved_public
        FROM h""",
}
QUERIES = {name: globals()[name] for name in SQL}
