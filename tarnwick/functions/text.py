"""Text normalisation as column expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed words that carry no meaning in matching.
STOPWORDS = ("and", "are", "for", "from", "that", "the", "this", "was", "will", "with", "you", "your")
#: Fixed plural endings of which the last letter goes.
PLURALS = ("ers", "ors", "ists", "ysts", "ants", "ents", "ects")


def cleaned(text: Column) -> Column:
    """Lower case; letters, digits and _ + # - . / kept; white space one space. Null stays null."""
    # Lone spaces are passed over: only runs that change are replaced, in one pass.
    kept = r"\p{L}\p{N}_+#./\-"
    return F.trim(F.regexp_replace(F.lower(text), rf"[^{kept} ][^{kept}]*+| [^{kept}]++", " "))


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS, least: int = 3) -> Column:
    """Cleaned words without marks at their ends, stopwords and short words; null text gives none."""
    bare = F.transform(F.split(F.coalesce(cleaned(text), F.lit("")), " "), lambda x: F.btrim(x, F.lit(".-/")))
    return F.filter(bare, lambda x: (F.char_length(x) >= least) & ~x.isin(*stopwords))


def singular(token: Column) -> Column:
    """Plural endings of roles reduced: -ies to -y, -ers and the like without s; other words as they are."""
    out = F.when((F.char_length(token) > 4) & token.endswith("ies"), F.regexp_replace(token, "ies$", "y"))
    return out.when((F.char_length(token) > 4) & token.rlike(f"({'|'.join(PLURALS)})$"), F.regexp_replace(token, "s$", "")).otherwise(token)


ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescaped(text: Column) -> Column:
    """Character references with their semicolon decoded: the named ones of HTML 4, decimal and hexadecimal ones; unknown ones stay."""
    named = F.from_json(F.lit(json.dumps({f"&{name};": chr(code) for name, code in html.entities.name2codepoint.items()} | {"&apos;": "'"})), "map<string,string>")
    code = lambda e: F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)).when(e.startswith("&#"), F.regexp_extract(e, "([0-9]+)", 1)).try_cast("long")
    valid = lambda n: (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    sign = lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(F.when(valid(n), n)), 8, "0")), "UTF-32"))
    made = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda e: F.coalesce(F.element_at(named, e), sign(code(e)), e))
    pieces = F.zip_with(F.split(text, ENTITY, -1), made, lambda gap, e: F.concat(gap, F.coalesce(e, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def plain_html(page: Column) -> Column:
    """Text of a page: references decoded, scripts, styles and tags removed, what that leaves decoded again; white space one space."""
    upto = lambda t: F.substring(t, F.lit(1), F.char_length(t) - F.char_length(F.substring_index(t, ">", -1)))

    def unscripted(piece: Column) -> Column:
        """What stands before the end of a script or style, without that element; the end is kept as a tag if nothing began."""
        opened = upto(piece).rlike("(?i)<(?:script|style)")
        return F.when(opened, F.regexp_replace(piece, r"(?is)<(?:script|style)[^>]*>.*$", " ")).otherwise(F.concat(piece, F.lit("</s>")))

    def bared(text: Column) -> Column:
        pieces = F.split(text, r"(?i)</(?:script|style)>", -1)
        n = F.size(pieces)
        return F.concat(F.array_join(F.transform(F.slice(pieces, F.lit(1), n - 1), lambda p: let(p, unscripted)), ""), F.element_at(pieces, -1))

    # Tags are sought up to the last > only: there each < has its >, so that no search goes on in vain.
    untagged = lambda t: F.concat(F.regexp_replace(upto(t), r"<[^>]*>", " "), F.substring_index(t, ">", -1))
    bare = let(unescaped(page), lambda t: let(bared(t), untagged))
    return F.trim(F.regexp_replace(unescaped(bare), r"[ \t\r\n]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def csv_safe(cell: Column) -> Column:
    """Line breaks become a dot, and a leading formula sign is disarmed."""
    flat = F.regexp_replace(cell, r"[\r\n]+", " · ")
    return F.when(flat.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), flat)).otherwise(flat)
