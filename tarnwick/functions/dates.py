"""Ages and pay as column expressions; the time of reference is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of a range of pay: an amount, its k, and the same again.
RANGE = r"\$([0-9]+(?:,[0-9]+)?(?:\.[0-9]+)?)([kK]?)\s*[-—–]\s*\$?([0-9]+(?:,[0-9]+)?(?:\.[0-9]+)?)([kK]?)"


def age_hours(day: Column, as_of: Column) -> Column:
    """Hours since a date without time: today counts as 4, yesterday as 24, then whole days. Unknown stays null."""
    days = F.datediff(as_of, day)
    return F.when(days <= 0, 4.0).otherwise(days * 24.0)


def age_label(hours: Column) -> Column:
    number = lambda n, unit: F.concat(F.floor(hours / n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(hours.isNull(), None).when(hours < 1, "Just now").when(hours < 24, number(1, "h")).when(hours < 168, number(24, "d"))
        .when(hours < 840, number(168, "w")).when(hours < 8760, number(720, "mo")).otherwise(number(8760, "y"))
    )


def freshness(hours: Column) -> Column:
    """Points for age, 6 if unknown."""
    return F.when(hours.isNull(), 6).when(hours <= 24, 20).when(hours <= 72, 16).when(hours <= 168, 12).when(hours <= 720, 6).otherwise(2)


def salary(text: Column, hourly: int = 350, monthly: int = 30_000, low: int = 1_000, high: int = 700_000) -> Column:
    """Struct (interval, least, most, annual) of the first '$a - $b'; null if there is none or it is out of bounds.

    Amounts are cut to whole ones; a k on either side scales both, whatever their size. The least amount says what the interval is; a range whose two
    ends lie on different sides of an interval's limit gives nothing, and both ends must be within the bounds by the year.
    """
    part = lambda n: F.regexp_extract(text, RANGE, n)
    scale = F.when((F.lower(part(2)) == "k") | (F.lower(part(4)) == "k"), 1000.0).otherwise(1.0)
    amount = lambda n: F.floor(F.regexp_replace(part(n), ",", "").try_cast("double")).cast("double") * scale
    a, b = amount(1), amount(3)
    interval = F.when(a < hourly, "hourly").when(a < monthly, "monthly").otherwise("yearly")
    times = F.when(a < hourly, 2080).when(a < monthly, 12).otherwise(1)
    same = F.when(a < hourly, b < hourly).when(a < monthly, b < monthly).otherwise(True)
    ok = same & (b > 0) & (a * times).between(low, high) & (b * times).between(low, high) & (a < b)
    return F.when(ok, F.struct(interval.alias("interval"), a.alias("least"), b.alias("most"), (a * times).alias("annual")))


#: Fixed words of many languages in dates of postings: of today, of the day before, and beginnings of units with their days.
TODAY_WORDS = r"\b(today|just|now|heute|aujourd|hoy|hoje|azi|dnes|bugün|bugun|danas|dzisiaj|idag|i dag|tänään)\b"
YESTERDAY_WORDS = r"\b(yesterday|gestern|hier|ayer|ontem|ieri|včera|vcera|dün|dun|jučer|wczoraj|igår|i går|eilen)\b"
UNIT_WORDS = (
    ("min|sec|sek|seg|std|stund|hour|heure|hora|uur|tim|ore|ora|hod|saat|h$", 0),
    ("day|tag|jour|día|dia|dag|dni|dny|den|zi|gün|gun|dan|päiv|d$", 1),
    ("week|woche|semaine|semana|uke|uge|veck|tydz|týd|sapt|hafta|tjed|vik|w$", 7),
    ("month|monat|mois|mes|maand|måned|månad|miesi|měs|luni|lună|ay$|mjes|kuuk", 30),
    ("year|jahr|an|año|ano|jaar|år|rok|yıl|godin|vuo", 365),
)
_COUNTED = r"([0-9]+)\s*\+?\s*([a-zA-Zа-яÀ-ÿăâîșțşţčćđšžůěřýöüğı]+)"


def posted_date(raw: Column, today: Column) -> Column:
    """The date of a posting from seconds or milliseconds since 1970, an ISO date or time, day.month.year, or words of many languages for how long ago; null if none.

    Word boundaries are those of Unicode. Numbers of units over nine digits tell nothing.
    """
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")))
    number = F.when(s.rlike(r"^[0-9]{1,18}$"), s).cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    since = F.when((seconds > 1e8) & (seconds < 2.5e11), F.timestamp_seconds(seconds).cast("date"))
    iso = F.regexp_extract(s, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0).try_cast("date")
    part = lambda g: F.regexp_extract(s, r"\b([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})\b", g)
    dotted = F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))).try_cast("date")
    n, unit = F.regexp_extract(s, _COUNTED, 1).try_cast("int"), F.regexp_extract(s, _COUNTED, 2)
    back = F
    for words, days in UNIT_WORDS:
        back = back.when(unit.rlike(f"^(?:{words})"), F.lit(days).cast("long"))
    ago = F.when(n < 1_000_000, F.date_sub(today, (back * n).cast("int")))
    return F.coalesce(since, iso, dotted, F.when(s.rlike(f"(?U){TODAY_WORDS}"), today), F.when(s.rlike(f"(?U){YESTERDAY_WORDS}"), F.date_sub(today, 1)), ago)
