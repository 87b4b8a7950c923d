"""Keys of companies, titles and places, under which postings of one opening meet."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.urls import canonical_url

#: Fixed spellings of letters that are more than a letter with a mark.
LETTERS = {"ø": "o", "æ": "ae", "å": "aa", "ö": "o", "ä": "ae", "ü": "u", "ß": "ss", "œ": "oe"}
#: Fixed endings of company names: legal forms and words for a group.
COMPANY_ENDINGS = (
    "a/s", "aps", "i/s", "p/s", "k/s", "ab", "oy", "oyj", "as", "asa", "ehf", "gmbh", "ag", "se", "kg", "ug", "mbh", "bv", "nv", "sarl", "sas", "sa", "srl", "spa", "sl",
    "plc", "ltd", "limited", "llp", "inc", "incorporated", "corp", "corporation", "llc", "co", "company", "group", "holding", "holdings", "technologies", "solutions", "labs",
)
#: Fixed marks of a work mode or of all genders in a title's tail, and the signs that begin a tail, in the order they are tried.
MODES = ("remote", "hybrid", "onsite", "h/f", "m/f", "f/h", "all genders")
TAILS = (" - ", " – ", " — ", ", ")
#: Fixed words that a posting's fingerprint leaves out.
LEGAL_WORDS = ("inc", "llc", "ltd", "limited", "corp", "corporation", "gmbh", "sarl", "sas", "co", "company", "group")
LEVEL_WORDS = ("senior", "sr", "junior", "jr", "remote", "hybrid", "on-?site", "contract", "full[- ]?time", "part[- ]?time")


def _marked_letters() -> tuple[str, str]:
    """Latin letters with marks, and the same without, by Unicode's decompositions."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            pairs[chr(code)] = bare
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Trimmed lower case without marks on Latin letters; null counts as empty."""
    out = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    for letter, spelling in LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(spelling))
    marked, bare = _marked_letters()
    return F.regexp_replace(F.translate(out, marked, bare), r"\p{Mn}", "")


def _without_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", " ")


def company_key(name: Column) -> Column:
    """Letters and digits of the name without brackets and any number of legal endings."""
    words = F.trim(F.regexp_replace(_without_brackets(folded(name)), "[^a-z0-9/]+", " "))
    longest_first = "|".join(sorted(COMPANY_ENDINGS, key=lambda x: (-len(x), x)))  # so that no turn of the possessive group needs another choice
    core = F.regexp_replace(words, rf"(?:\s*+\b(?:{longest_first})\.?+)++$", "")
    return F.regexp_replace(core, "[^a-z0-9]", "")


def title_key(title: Column) -> Column:
    """Letters, digits, + and # of the title without brackets and one short or mode-naming tail behind six characters or more."""
    plain = _without_brackets(folded(title))
    kept = None
    for sign in TAILS:
        part = lambda n: F.regexp_extract(plain, f"(?s)^(.*){sign}(.*)$", n)  # noqa: B023, E731
        cuts = plain.contains(sign) & (F.char_length(part(1)) >= 6) & ((F.char_length(part(2)) <= 22) | part(2).rlike("|".join(MODES)))
        kept = (F if kept is None else kept).when(cuts, part(1))
    return F.regexp_replace(kept.otherwise(plain), "[^a-z0-9+#]", "")


def _core(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for words in (LEGAL_WORDS, LEVEL_WORDS):
        out = F.regexp_replace(out, rf"\b(?:{'|'.join(words)})\b" + (r"\.?" if words is LEGAL_WORDS else ""), "")
    return F.regexp_replace(F.regexp_replace(out, r"\([^)]*\)", ""), "[^a-z0-9]", "")


def posting_fingerprint(company: Column, title: Column) -> Column:
    """company|title without legal, level and mode words; null if either has nothing left."""
    c, t = _core(company), _core(title)
    return F.when((c != "") & (t != ""), F.concat_ws("|", c, t))


def dedup_keys(url: Column, direct: Column, company: Column, title: Column, place: Column, unreal: tuple[str, ...] = ()) -> Column:
    """Keys in order: both URLs, then title, company and city, then title and company if both are long enough to tell.

    `unreal` are company keys that name no company (as "confidential"): they give no title key.
    """
    u, d = canonical_url(F.coalesce(url, F.lit(""))), canonical_url(F.coalesce(direct, F.lit("")))
    t, c = title_key(title), company_key(company)
    city = F.regexp_replace(folded(F.substring_index(F.coalesce(place, F.lit("")), ",", 1)), "[^a-z0-9]", "")
    named = (t != "") & (c != "") & ~c.isin(*unreal) if unreal else (t != "") & (c != "")
    keys = F.array(
        F.when(u != "", F.concat(F.lit("u:"), u)),
        F.when((d != "") & (d != u), F.concat(F.lit("u:"), d)),
        F.when(named, F.concat(F.lit("tc:"), F.concat_ws("|", t, c, city))),
        F.when(named & (F.char_length(t) >= 12) & (F.char_length(c) >= 4), F.concat(F.lit("tcr:"), F.concat_ws("|", t, c))),
    )
    return F.filter(keys, lambda k: k.isNotNull())
