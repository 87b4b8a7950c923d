"""Rules that read dates, links, mailboxes and kinds of postings out of short texts, as column expressions; the day of reference is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.text import let
from tarnwick.functions.urls import COMMON_ENDS, FILE_ENDS, NO_DOMAIN, TRAILING, canonical_url, host

#: Fixed patterns of a posting's id in its URL, in the order they are tried.
JOB_IDS = (r"currentJobId=([0-9]+)", r"-([0-9]{7,12})(?:[/?#]|$)", r"/jobs/view/([0-9]+)(?:[/?#]|$)", r"/jobPosting/([0-9]+)", r"(?<![0-9])([0-9]{8,11})(?![0-9])")
#: Fixed words of an age in a posting's own words (English and French): pattern, hours for each unit; without a group the hours are the age.
AGES = (
    (r"just now|moment|second|minute|min ago|mins ago|less than an hour|moments ago|few seconds|à l'instant", 0.5), (r"\b(?:an?\s+hour|une\s+heure)\b", 1.0), (r"([0-9]+)\s*(?:hours?|hrs?|h|heures?)\b", 1.0),
    (r"yesterday|hier|\b1\s*days?\s*ago\b|\b1d\s*ago\b", 24.0), (r"\b(?:a\s+day\s+ago|un\s+jour)\b", 24.0), (r"([0-9]+)\s*(?:days?|d|jours?|j)\b", 24.0), (r"\b(?:a\s+week\s+ago|une\s+semaine)\b", 168.0),
    (r"([0-9]+)\s*(?:weeks?|wks?|w|semaines?)\b", 168.0), (r"\b(?:a\s+month\s+ago|un\s+mois)\b", 720.0), (r"([0-9]+)\s*(?:months?|mos?|mo|mois)\b", 720.0), (r"\b(?:a\s+year|an?\s+yr|un\s+an)\b", 8760.0),
    (r"([0-9]+)\s*(?:years?|yrs?|yr|y|ans?|an)\b", 8760.0),
)
#: Fixed names of months (English, short and long, and French).
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12, "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
}
#: Fixed phrases before a deadline; the group is what follows.
DEADLINE = (
    r"(?i)(?:application\s+deadline|apply\s+(?:by|before|no\s+later\s+than)|closing\s+date|applications?\s+close(?:\s+on)?|posting\s+closes(?:\s+on)?|date\s+limite(?:\s+de\s+candidature)?|bewerbungsfrist|sista\s+ans[oö]kningsdag)"
    r"\s*[:\-–]?\s*([^\n.;]{4,40})"
)
#: What every text with such a phrase holds in lower case: a cheap test before the pattern.
DEADLINE_HOLDS = ("application", "apply", "closing", "posting", "date", "bewerbungsfrist", "sista")
#: Fixed words of links to a career portal, and of links that never are one.
PORTAL = "career|karriere|job|opening|apply|workday|greenhouse|lever|emply|recruitee|vacanc"
NO_PORTAL = r"linkedin\.com/company|t\.me|twitter\.com|facebook\.com|instagram\.com|youtube\.com|unsubscribe"
#: Fixed words of remote work in several languages, of kinds of employment, and of French texts.
REMOTE = r"(?i)\b(?:remote|fully remote|100% remote|télétravail|teletrabajo|remoto|home ?office|fjernarbeid|distans|zdalna|praca zdalna|uzaktan|la distanță|la distanta|na dálku|etätyö|thuiswerk)\b"
JOB_TYPES = {"fulltime": r"(?i)full\s?time", "parttime": r"(?i)part\s?time", "internship": r"(?i)internship", "contract": r"(?i)contract"}
FRENCH = ("développeur", "développeuse", "recherchons", "rejoignez notre équipe", "télétravail", "candidature", "offre d'emploi", "temps plein", "postuler", "salaire")
#: Fixed words that a company's slug leaves out.
SLUG_OUT = "inc|llc|ltd|limited|corp|corporation|group|gmbh|sarl|sas|sa|plc|co|technologies|technology|solutions|labs|studio|global|international"
#: A snowflake id holds milliseconds above its lowest 22 bits; the first that counts is that of 2015.
SNOWFLAKE_BITS, SNOWFLAKE_FROM = 22, 1_420_070_400_000


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def job_id(url: Column) -> Column:
    """The posting's id by the first pattern that holds; null if none."""
    return F.coalesce(*[_group(url, p) for p in JOB_IDS])


def clean_job_url(url: Column) -> Column:
    """A key that keeps the id a query holds: greenhouse's, else canonical_url()."""
    held = _group(url, r"[?&]gh_jid=([0-9]+)")
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(held.isNotNull(), F.concat(F.lit("greenhouse:"), held)).otherwise(canonical_url(url))


def snowflake_ms(number: Column, now_ms: int) -> Column:
    """Milliseconds since 1970 at which an id was made; null outside 2015 to a day past now."""
    ms = F.shiftright(number.try_cast("long"), SNOWFLAKE_BITS)
    return F.when(ms.between(SNOWFLAKE_FROM, now_ms + 86_400_000), ms)


def slug_words(url: Column) -> Column:
    """The words in the path of a post: /posts/<author>_<words>-activity-<id>."""
    part = F.regexp_extract(url, r"^(?:[a-z]+://)?[^/]*/+posts/([^/?#]+)", 1)
    words = F.regexp_replace(F.regexp_extract(part, "^[^_]*_(.*)$", 1), r"(?i)-(?:activity|share|ugcPost)-[0-9]+.*$", "")
    return F.trim(F.regexp_replace(words, r"[-_\s]+", " "))


def age_of_words(text: Column) -> Column:
    """Hours that a posting says it is old, in English or French; null if it doesn't say."""
    low = F.lower(F.trim(text))
    known = ~low.isin("recently", "recent", "n/a", "none", "unknown", "")
    each = [F.when(low.rlike(p), _group(low, p).try_cast("double") * hours if "(" in p.replace("(?:", "") else F.lit(hours)) for p, hours in AGES]
    return F.when(known, F.coalesce(*each))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def loose_date(text: Column) -> Column:
    """The first date of a text: year-month-day, Month day, year or day Month year, with months in English or French."""
    months = F.create_map(*[x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))])
    iso, named, led = r"\b(20[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\b", r"([A-Za-zÀ-ÿ]{3,10})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+(20[0-9]{2})\b", r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Za-zÀ-ÿ]{3,10})\.?,?\s+(20[0-9]{2})\b"
    month = lambda text, p, n: F.element_at(months, F.lower(F.regexp_extract(text, p, n)))
    return let(text, lambda text: F.coalesce(
        _day(_group(text, iso, 1), _group(text, iso, 2), _group(text, iso, 3)), _day(_group(text, named, 3), month(text, named, 1), _group(text, named, 2)), _day(_group(text, led, 3), month(text, led, 2), _group(text, led, 1)),
    ))


def deadline(field: Column, description: Column, today: Column, urgent_days: int = 7) -> Column:
    """Struct (deadline, days, label) from a field of its own or what follows a phrase in the description; nulls if there is none."""

    def said(text: Column) -> Column:
        low = F.lower(text)
        return F.when(let(low, lambda x: F.exists(F.array(*map(F.lit, DEADLINE_HOLDS)), lambda w: x.contains(w))), F.regexp_extract(text, DEADLINE, 1)).otherwise("")

    day = F.coalesce(loose_date(F.coalesce(field, F.lit(""))), loose_date(let(F.coalesce(description, F.lit("")), said)))
    return let(day, lambda found: _told(found, today, urgent_days))


def _told(day: Column, today: Column, urgent_days: int) -> Column:
    left, iso = F.datediff(day, today), F.date_format(day, "yyyy-MM-dd")
    label = F.when(left < 0, F.concat(F.lit("Deadline passed ("), iso, F.lit(")"))).when(left == 0, "Closes today!").when(left <= urgent_days, F.concat(F.lit("Closes in "), left.cast("string"), F.lit("d ("), iso, F.lit(")"))).otherwise(F.concat(F.lit("Closes "), iso))
    return F.struct(day.alias("deadline"), left.alias("days"), F.when(day.isNotNull(), label).alias("label"))


def iso_stamp(value: Column) -> Column:
    """Epoch seconds or milliseconds, or a date with or without time, in ISO form; empty if neither."""
    text = F.trim(F.coalesce(value, F.lit("")))
    number = text.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    full = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"
    stamp = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))
    form = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(text.rlike("^[0-9]+$"), form(F.timestamp_seconds(F.floor(seconds)))).when(text.rlike(full) & stamp.isNotNull(), form(stamp)).otherwise(F.regexp_extract(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0))


def pay_label(least: Column, most: Column, text: Column) -> Column:
    """$least–$most with thousands marked, either alone, or the given text's first sixty characters."""
    money = lambda x: F.concat(F.lit("$"), F.format_number(F.floor(x), 0))
    low = F.when(F.coalesce(least, F.lit(0.0)) != 0, money(least)).otherwise("")
    high = F.when((F.coalesce(most, F.lit(0.0)) != 0) & (most != F.coalesce(least, F.lit(0.0))), F.concat(F.lit("–"), money(most))).otherwise("")
    label = F.concat(low, high)
    return F.when(label != "", label).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, 60))


def trimmed_address(address: Column) -> Column:
    """Without a word that a missing space glued to its end."""
    parts = F.split(address, r"\.")
    before = F.element_at(parts, F.when(F.size(parts) >= 2, -2).otherwise(-1))
    return F.when((F.size(parts) >= 3) & F.element_at(parts, -1).isin(*TRAILING) & before.isin(*COMMON_ENDS), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")).otherwise(address)


def valid_address(address: Column, boards: tuple[str, ...] = ()) -> Column:
    """Whether an address has the form of one, and its host is neither a stand-in nor a job board."""
    e = trimmed_address(F.lower(F.trim(F.coalesce(address, F.lit("")))))
    box, name = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    end = F.char_length(F.substring_index(name, ".", -1))
    formed = (F.size(F.split(e, "@")) == 2) & (F.char_length(box) >= 2) & (F.char_length(name) >= 4) & name.contains(".") & end.between(2, 10) & ~name.contains("..") & ~box.contains("..")
    return formed & ~e.rlike(rf"\.(?:{'|'.join(FILE_ENDS)})$") & ~name.isin(*NO_DOMAIN, *boards)


def hiring_mailbox(address: Column, hiring: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """Whether a valid address is a mailbox for hiring: its name holds one of `hiring` and is or begins with none of `other`."""
    box = F.lower(F.substring_index(address, "@", 1))
    bare = F.regexp_replace(box, r"[._\-+0-9]", "")
    named = bare.isin(*hiring)
    for word in hiring:
        named = named | box.contains(word)
    return valid_address(address) & named & ~box.isin(*other) & ~box.rlike(rf"^(?:{'|'.join(other)})[._-]") & ((F.char_length(box) >= 3) | (box == "hr"))


def portal_link(body: Column, fallback: Column) -> Column:
    """The first link that names careers or applying, else the first that is no social page, else the fallback."""
    links = F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"https?://[^\s<>\"')]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:]+$", ""))
    first = lambda test: F.get(F.filter(links, test), F.lit(0))
    return F.coalesce(first(lambda u: F.lower(u).rlike(PORTAL)), first(lambda u: ~F.lower(u).rlike(NO_PORTAL)), fallback)


def job_types(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in JOB_TYPES.items()]))


def language(text: Column, hints: tuple[str, ...] = (" à ", " au ", " aux ", " cdi ", " cdd ", " stage ", " alternance ", " entreprise ", " mission ", " formation ")) -> Column:
    """'fr' if a strong French word or two hints occur, else 'en'."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    count = sum((low.contains(h).cast("int") for h in hints), F.lit(0))
    return F.when(low.rlike("|".join(FRENCH)) | (count >= 2), "fr").otherwise("en")


def company_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"\b(?:{SLUG_OUT})\b", ""), "[^a-z0-9]", "")


def no_posting(title: Column, url: Column, company: Column, titles: str, urls: str, companies: tuple[str, ...]) -> Column:
    """Whether a row is a search page or place instead of a posting: by its title, its URL, or a company that only lists others' postings."""
    t = F.trim(F.coalesce(title, F.lit("")))
    name = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(company, F.lit("")))), r"^www\.", ""))
    unnamed = name.isin("", "confidential", "unknown", "n/a", "na", "none")
    return (F.char_length(t) <= 3) | t.rlike(r"^[A-Za-zÀ-ÿ\s.-]{1,18}\.$") | t.rlike(titles) | F.coalesce(url, F.lit("")).rlike(urls) | (name.isin(*companies) & ~unnamed)


def spam(title: Column, description: Column, company: Column, pattern: str) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(company, F.lit("")), F.coalesce(description, F.lit(""))).rlike(pattern)


def in_window(hours: Column, closed: Column, most: float | None, stale: float = 2160.0) -> Column:
    """Whether a posting is open and not stale, and within `most` hours if that is given (then of known age too)."""
    fresh = F.coalesce(hours <= stale, F.lit(True)) & ~F.coalesce(closed, F.lit(False))
    return fresh if most is None else fresh & F.coalesce(hours <= most, F.lit(False))


def first_party(direct: Column, url: Column, site: Column, hosts: dict[str, str], vendors: dict[str, str]) -> Column:
    """The vendor of the applicant system that a posting comes from directly; null if it does not."""
    by_host = [F.when(host(u).contains(name), vendor) for u in (direct, url) for name, vendor in hosts.items()]
    own = F.lower(F.coalesce(site, F.lit("")))
    by_site = [F.when(own == f"ats_{name}", vendor) for name, vendor in vendors.items()]
    return F.coalesce(*by_host, *by_site, F.when(own == "ats", "Company ATS"))
