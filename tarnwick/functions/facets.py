"""What a posting is by the facets of a search: level, place of work, kind, free words, age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.text import let

#: Fixed signs of levels and kinds of work: in the title (t) or in the description (d), any of them.
LEVELS = {
    "internship": (("t", "intern"), ("d", "stage"), ("d", "alternan")), "entry": (("t", "junior"), ("d", "entry level"), ("d", "premier emploi")), "associate": (("t", "mid"), ("d", "associate"), ("d", "confirmé")),
    "senior": (("t", "senior"), ("t", "lead"), ("d", "cadre")), "director": (("t", "director"), ("t", "directeur"), ("t", "head")), "executive": (("t", "vp"), ("t", "c-level"), ("t", "chief")),
}
KINDS = {
    "fulltime": (("d", "full-time"), ("d", "temps plein"), ("d", "cdi")), "contract": (("d", "contract"), ("d", "cdd"), ("d", "freelance")), "internship": (("d", "intern"), ("d", "stage"), ("d", "alternance")),
    "parttime": (("d", "part-time"), ("d", "temps partiel")),
}
#: Fixed signs of a posting that is open to people from abroad.
ABROAD = ("international candidate", "without a valid canadian work permit", "who can apply")
#: Fixed hours of the ages that may be asked for; the first four are less than a day or one. Without any of them what is older than MOST_HOURS goes.
AGES, SHORT_AGES, MOST_HOURS = {"1h": 1.0, "3h": 3.0, "6h": 6.0, "24h": 24.0, "week": 168.0, "month": 720.0}, ("1h", "3h", "6h", "24h"), 2160.0


def _signed(signs: dict[str, tuple], title: Column, text: Column) -> Column:
    hit = lambda places: sum((((title if where == "t" else text).contains(word)).cast("int") for where, word in places), F.lit(0)) > 0
    return F.array_compact(F.array(*[F.when(hit(places), name) for name, places in signs.items()]))


def levels(title: Column, text: Column) -> Column:
    return _signed(LEVELS, title, text)


def kinds(title: Column, text: Column) -> Column:
    return _signed(KINDS, title, text)


def workplaces(place: Column, text: Column, is_remote: Column) -> Column:
    """remote, hybrid or both; onsite if neither."""
    remote = F.coalesce(is_remote, F.lit(False)) | place.contains("remote") | text.contains("à distance") | text.contains("remote")
    hybrid = place.contains("hybrid") | text.contains("hybride") | text.contains("hybrid")
    return F.array_compact(F.array(F.when(remote, "remote"), F.when(hybrid, "hybrid"), F.when(~remote & ~hybrid, "onsite")))


def said(terms: Sequence[str], *texts: Column) -> Column:
    """Those of the terms (as given) that one of the texts holds, in lower case."""
    return F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: sum((x.contains(F.lower(t)).cast("int") for x in texts), F.lit(0)) > 0)


def flags(**given: Column) -> Column:
    """The names of the flags that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in given.items()]))


def posting_facets(title: Column, text: Column, company: Column, place: Column, is_remote: Column, n_emails: Column, easy: Column, abroad: Column, offered: dict[str, Sequence[str]]) -> dict[str, Column]:
    """The values that a posting has under each facet. `offered` gives the terms of companies, sectors, functions, titles and commitments that a search offers."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    t, d, mail = low(title), low(text), F.coalesce(n_emails, F.lit(0)) > 0
    open_abroad = F.coalesce(abroad, F.lit(False))
    for sign in ABROAD:
        open_abroad = open_abroad | d.contains(sign)
    return {
        "experience": levels(t, d), "workplace": workplaces(low(place), d, is_remote), "type": kinds(t, d), "company": said(offered.get("company", ()), low(company)), "sector": said(offered.get("sector", ()), d, t),
        "function": said(offered.get("function", ()), d, t), "title": said(offered.get("title", ()), t), "commitment": said(offered.get("commitment", ()), d), "verified": flags(yes=mail), "easy": flags(yes=F.coalesce(easy, F.lit(False)) | mail),
        "abroad": flags(yes=open_abroad),
    }


def of_age(closed: Column, hours: Column, is_new: Column, label: Column, wanted: str | None, now: Column) -> Column:
    """Whether a posting is open and of the wanted age (a key of AGES, else any): by its hours, by a mark that it is new, or by what its label says.

    A label that tells no age never passes a wanted one; dates without hours count from midnight, with half a day's grace for 24h.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    if wanted not in AGES:
        return ~known(closed) & ~known(hours > MOST_HOURS)
    most, short = AGES[wanted], wanted in SHORT_AGES
    number = lambda s, p: F.regexp_extract(s, p, 1).try_cast("long")

    def told(s: Column) -> Column:
        months, weeks, days, hrs = (r"([0-9]+)\s*(?:months?|mos?|mo|mois)\b", r"([0-9]+)\s*(?:weeks?|wks?|w|semaines?)\b", r"([0-9]+)\s*(?:d|days?|jours?)\b", r"([0-9]+)\s*(?:h|hrs?|hours?|heures?)\b")
        limit = lambda **by: by.get(wanted, by.get("short" if short else "long"))
        most_days = limit(**{"1h": None, "3h": None, "6h": None, "24h": 1, "week": 7, "month": 30})
        date = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.regexp_replace(s, r"(?<=^[0-9-]{10})t", " ")).try_cast("timestamp")
        since = (F.unix_micros(now) - F.unix_micros(date)) / 3.6e9
        grace = {"24h": 36.0}.get(wanted, most + 0.5 if short else most)
        return (
            F.when(s.isin("", "recently", "recent", "n/a"), False).when(s.rlike(r"\b(?:[0-9]+\s*(?:years?|yrs?|yr|y|ans?)|a\s+year|un\s+an)\b"), False)
            .when(s.rlike(months) | s.rlike(r"\b(?:a\s+month|un\s+mois)\b"), F.coalesce(number(s, months), F.lit(1)) <= 1 if wanted == "month" else F.lit(False))
            .when(s.rlike(weeks) | s.rlike(r"\b(?:a\s+week|une\s+semaine)\b"), F.coalesce(number(s, weeks), F.lit(1)) <= (1 if wanted == "week" else 4) if wanted in ("week", "month") else F.lit(False))
            .when(s.rlike(days), number(s, days) <= most_days if most_days else F.lit(False)).when(s.rlike(hrs), number(s, hrs) <= most if short else F.lit(True))
            .when(s.rlike("just now|minute|min|m ago|sec"), True).when(s.rlike("today|yesterday|hier"), wanted not in ("1h", "3h", "6h")).otherwise(F.coalesce(since <= grace, F.lit(False)))
        )

    by_label = let(F.lower(F.trim(F.coalesce(label, F.lit("")))), told)
    young = F.when(hours.isNotNull(), hours <= most).otherwise(known(is_new) & F.lit(wanted == "24h") | F.coalesce(by_label, F.lit(False)))
    return ~known(closed) & young
