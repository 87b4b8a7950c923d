"""URLs and addresses as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.text import let

#: Fixed second-level labels under two-letter country domains.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov")
#: Fixed patterns of boards whose URLs hold an id, in the order they are tried: name, pattern, the groups that make the id.
BOARDS = (
    ("linkedin", r"currentjobid=([0-9]+)", (1,)),
    ("linkedin", r"/jobs/view/(?:[^/?#]*-)?([0-9]{6,})", (1,)),
    ("indeed", r"[?&]jk=([a-z0-9]+)", (1,)),
    ("greenhouse", r"[?&]gh_jid=([0-9]+)", (1,)),
    ("greenhouse", r"greenhouse\.io/[^/?#]+/jobs/([0-9]+)", (1,)),
    ("lever", r"jobs\.lever\.co/([^/?#]+)/([0-9a-f-]{16,})", (1, 2)),
    ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)/([0-9a-f-]{16,})", (1, 2)),
    ("tanitjobs", r"tanitjobs\.com/job/([0-9]+)", (1,)),
    ("keejob", r"keejob\.com/offres-emploi/([0-9]+)", (1,)),
    ("ejobs", r"ejobs\.ro/user/locuri-de-munca/[^/?#]+/([0-9]+)", (1,)),
    ("hipo", r"hipo\.ro/locuri-de-munca/locuri_de_munca/([0-9]+)", (1,)),
    ("hellowork", r"hellowork\.com/fr-fr/emplois/([0-9]+)\.html", (1,)),
    ("reed", r"reed\.co\.uk/jobs/[^/?#]+/([0-9]+)", (1,)),
    ("karriere_at", r"karriere\.at/jobs/([0-9]+)", (1,)),
    ("itjobs_pt", r"itjobs\.pt/oferta/([0-9]+)", (1,)),
    ("rekrute", r"rekrute\.com/offre-emploi-[^/?#]*-([0-9]+)\.html", (1,)),
    ("seek", r"(?:seek\.com\.au|seek\.co\.nz|jobstreet\.com(?:\.[a-z]{2})?)/(?:id/)?job/([0-9]+)", (1,)),
    ("mycareersfuture", r"mycareersfuture\.gov\.sg/job/[^/?#]*-([0-9a-f]{32})", (1,)),
    ("wanted_kr", r"wanted\.co\.kr/wd/([0-9]+)", (1,)),
    ("djinni", r"djinni\.co/jobs/([0-9]+)-", (1,)),
    ("finn", r"finn\.no/job/[^/?#]+[?&]finnkode=([0-9]+)", (1,)),
    ("talent", r"talent\.com/view\?id=([a-z0-9]+)", (1,)),
)
#: Fixed parts of what looks like an address and is none: ends of file names, beginnings of mailboxes, hosts; words that a missing space glues to an address, and the ends they follow.
FILE_ENDS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "js", "css", "ico", "woff", "woff2", "ttf", "eot")
NO_PERSON = ("noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "privacy", "legal", "abuse")
NO_DOMAIN = ("example.com", "example.org", "test.com", "sentry.io", "sentry-next.wixpress.com")
TRAILING = ("please", "contact", "if", "we", "for", "to", "or", "and", "send", "reach", "do", "not", "apply", "email")
COMMON_ENDS = ("com", "org", "net", "edu", "gov", "io", "ai", "co", "tech", "app", "dev", "uk", "de", "fr", "ca", "us")
#: Patterns begin only where a run begins (lookbehind) or the match before ended (\G), and don't step back into a run (++), so that long runs cost one pass and no stack.
#: White space and word boundaries are those of ASCII.
_SPACE, _BOX = r"[ \t\n\f\r]", "[a-zA-Z0-9._%+-]"
SPELLED_AT = rf"(?i)(?:(?<!{_SPACE})|\G){_SPACE}*+(?:\[at\]|\(at\)|\[@\]|(?<![a-z0-9_])at(?![a-z0-9_])){_SPACE}*+"
SPELLED_DOT = rf"(?i)(?:(?<!{_SPACE})|\G){_SPACE}*+(?:\[dot\]|\(dot\)|(?<![a-z0-9_])dot(?![a-z0-9_])){_SPACE}*+"
SPACED = rf"(?:(?<!{_BOX})|\G)({_BOX}++){_SPACE}*+@{_SPACE}*+([a-zA-Z0-9.-]+){_SPACE}*\.{_SPACE}*+([a-zA-Z]{{2,10}})"
EMAIL = rf"(?:(?<!{_BOX})|\G){_BOX}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,10}}"
#: Fixed mail hosts open to all, and names of shared mailboxes.
FREE_MAIL = ("gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "gmx.de")
SHARED = ("hr", "jobs", "careers", "recruiting", "info", "contact", "hello", "support", "sales", "admin", "team")


def canonical_url(url: Column, boards: Sequence[tuple] = BOARDS) -> Column:
    """board:id where one of the boards tells an id, else the URL in lower case without scheme, www, query, fragment, last slash and session id."""
    low = F.lower(F.trim(url))
    known = [F.when(low.rlike(p), F.concat(F.lit(f"{name}:"), F.concat_ws("/", *[F.regexp_extract(low, p, g) for g in groups]))) for name, p, groups in boards]
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^[a-z]+://", ""), r"^www\.", ""), r"[?#].*$", "")
    return F.coalesce(*known, F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r";jsessionid=[^/?]*", ""))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)", 1)


def root_domain(name: Column) -> Column:
    """The last two labels of a host, three under country domains with a second level."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    three = (n >= 3) & (F.char_length(F.element_at(parts, -1)) == 2) & F.element_at(parts, F.when(n >= 2, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), n - F.when(three, 2).otherwise(1)), 3), ".")


def emails(text: Column) -> Column:
    """Distinct addresses in order of appearance, in lower case; spelled-out and spaced signs are read as such, false addresses left out."""

    def found(at: Column) -> Column:
        plain = F.when(at.rlike(r"(?i)dot"), F.regexp_replace(at, SPELLED_DOT, ".")).otherwise(at)
        each = F.transform(F.regexp_extract_all(F.regexp_replace(plain, SPACED, "$1@$2.$3"), F.lit(EMAIL), F.lit(0)), F.lower)
        return F.when(at.contains("@"), each).otherwise(F.array().cast("array<string>"))  # most texts end here

    raw = let(F.regexp_replace(F.coalesce(text, F.lit("")), SPELLED_AT, "@"), found)

    def trimmed(e: Column) -> Column:
        parts = F.split(e, r"\.")
        glued = (F.size(parts) >= 3) & F.element_at(parts, -1).isin(*TRAILING) & F.element_at(parts, F.when(F.size(parts) >= 2, -2).otherwise(-1)).isin(*COMMON_ENDS)
        return F.when(glued, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")).otherwise(e)

    def real(e: Column) -> Column:
        box, host_name = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
        false = e.rlike(rf"\.(?:{'|'.join(FILE_ENDS)})$") | box.rlike(rf"^(?:{'|'.join(NO_PERSON)})") | host_name.isin(*NO_DOMAIN)
        return ~false & (F.char_length(box) >= 2) & (F.char_length(host_name) >= 4)

    return F.array_distinct(F.filter(F.transform(raw, trimmed), real))


def email_tier(address: Column) -> Column:
    """1 a named mailbox of a firm, 2 a shared one, 3 a free mail host."""
    return F.when(F.substring_index(address, "@", -1).isin(*FREE_MAIL), 3).when(F.substring_index(address, "@", 1).isin(*SHARED), 2).otherwise(1)
