"""Verdicts over postings: pay, work permit, legitimacy, whether the page is still open, and the final rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMOUNT = r"(?i)(?:[$€£]|usd|eur|gbp)\s?(\d{2,3}(?:[,.]\d{3})+|\d{2,3}\s?k)"


def clamp(score: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Between low and high, to a tenth, sums being freed of float noise first; null stays null (greatest alone would skip it)."""
    return F.when(score.isNotNull(), F.round(F.round(F.least(F.lit(high), F.greatest(F.lit(low), score)), 6), 1))


def amounts(text: Column) -> Column:
    """Numbers behind a currency: '$80,000', 'EUR 80.000', '£80k'."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMOUNT), F.lit(1))
    number = lambda x: F.regexp_replace(x, "[^0-9]", "").cast("long") * F.when(x.rlike("[kK]$"), 1000).otherwise(1)
    return F.transform(found, number)


def annual(amount: Column, interval: Column) -> Column:
    """A pay in a year's terms; without an interval it is taken as a year's."""
    return amount * F.when(interval == "hourly", 2080).when(interval == "daily", 260).when(interval == "weekly", 52).when(interval == "monthly", 12).otherwise(1)


def pay_score(pay: Column, text: Column) -> Column:
    """4.5, 4 or 3.5 by the highest amount a year, 3 if low or unknown; amounts up to 20,000 are read as monthly."""
    stated = F.transform(F.regexp_extract_all(F.coalesce(pay, F.lit("")), F.lit(r"\d{1,3}(?:,\d{3})+|\d{4,6}"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("long"))
    top = F.array_max(F.filter(F.concat(stated, amounts(text)), lambda x: x.between(1_000, 1_000_000)))
    year = F.when(top > 20_000, top).otherwise(top * 12)
    return F.when(year >= 120_000, 4.5).when(year >= 70_000, 4.0).when(year >= 35_000, 3.5).otherwise(3.0)


def permit_score(text: Column, blockers: list[str], positives: list[str]) -> Column:
    """Struct (score, blocked): 2 for blockers alone, 3 for both, 4.8 for positives alone, 3.6 for neither."""
    bad, good = (F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in x)), F.lit(False)) for x in (blockers, positives))
    score = F.when(bad & good, 3.0).when(bad, 2.0).when(good, 4.8).otherwise(3.6)
    return F.struct(score.alias("score"), (bad & ~good).alias("blocked"))


def legitimacy(signals: list[tuple[Column, float]]) -> Column:
    """Struct (risk, tier, score) of weighted signals; an unknown signal adds nothing."""
    risk = sum((F.when(c, w).otherwise(0.0) for c, w in signals), F.lit(0.0))
    tier = F.when(risk >= 2.5, "Suspicious").when(risk >= 1.0, "Proceed with Caution").otherwise("High Confidence")
    return F.struct(F.round(risk, 2).alias("risk"), tier.alias("tier"), clamp(4.6 - risk).alias("score"))


def fit_score(percent: Column, too_senior: Column) -> Column:
    """A match of 0 to 100 as 1 to 5; unknown is 3."""
    base = clamp(1 + percent / 25)
    return F.coalesce(F.when(too_senior, clamp(base - 0.4)).otherwise(base), F.lit(3.0))


def verdict(fit: Column, legit: Column, permit: Column, pay: Column, closed: Column, expired: Column, language_gap: Column) -> Column:
    """Struct (score, verdict): .45 fit, .25 legitimacy, .15 permit, .15 pay; suspicious, closed and expired postings are capped and skipped."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    score = fit * 0.45 + legit["score"] * 0.25 + permit["score"] * 0.15 + pay * 0.15
    suspicious, over = legit["tier"] == "Suspicious", yes(closed) | yes(expired)
    score = F.when(over, F.least(score, F.lit(1.5))).when(suspicious, F.least(score, F.lit(2.5))).otherwise(score)
    score = clamp(score - F.when(permit["blocked"], 0.3).otherwise(0.0) - F.when(yes(language_gap), 0.6).otherwise(0.0))
    word = F.when(suspicious | over, "skip").when(score >= 4, "apply").when(score >= 3, "consider").otherwise("skip")
    return F.struct(score.alias("score"), word.alias("verdict"))


def liveness(status: Column, requested_id: Column, final_url: Column, body: Column, controls: Column, patterns: dict[str, str], least: int = 300) -> Column:
    """Code of the first rule that holds. `patterns` has the texts of bot pages, expired and listing pages, and apply controls."""
    says = lambda c, kind: F.coalesce(c.rlike("(?i)" + patterns[kind]), F.lit(False))
    text, url = F.coalesce(body, F.lit("")), F.lower(F.coalesce(final_url, F.lit("")))
    return (
        F.when(status.isin(404, 410), "http_gone").when(says(text, "bot"), "bot_challenge").when(status.isin(403, 429, 503), "access_blocked").when(status >= 500, "server_error")
        .when(url.rlike(r"[?&]error=true"), "expired_url").when(says(text, "expired"), "expired_body")
        .when(requested_id.isNotNull() & (url != "") & ~url.contains(F.lower(requested_id)), "redirected_off_posting")
        .when(says(controls, "apply"), "apply_control_visible").when(says(text, "soft"), "expired_body_soft").when(says(text, "listing"), "listing_page")
        .when(F.char_length(F.trim(text)) < least, "js_rendered").otherwise("no_apply_control")
    )


def final_rank(quality: Column, fit: Column, tier: Column, reposts: Column, first_party: Column, language_gap: Column) -> Column:
    """.55 fit + .45 quality where a fit is known, else the quality; then what tier, reposts, origin and language take or give."""
    base = F.coalesce(F.bround(F.round(0.55 * fit + 0.45 * quality, 6), 1), quality.cast("double"))
    less = F.when(tier == "Suspicious", 15).when(tier == "Proceed with Caution", 5).otherwise(0) + 3 * F.least(F.coalesce(reposts, F.lit(0)), F.lit(3))
    return F.round(base - less + F.when(first_party, 2.5).otherwise(0.0) - F.when(language_gap, 6.0).otherwise(0.0), 1)


def source_health(df: DataFrame, source: str, order: list[str], millis: str, rows: str, keep: float = 0.8) -> DataFrame:
    """Per source: calls, calls with rows, the hit rate, the longest call, and the moving average of the time of calls.

    The average starts at the first call and each later call moves it by (1 - keep). It is a sum of times weighted by their
    place from the end, so no history is gathered; unlike a running fold it is rounded once, at the end.
    """
    latest = Window.partitionBy(source).orderBy(*[F.desc(c) for c in order])
    placed = df.withColumn("_back", F.row_number().over(latest) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(source)))
    weight = F.pow(F.lit(keep), F.col("_back")) * F.when(F.col("_back") == F.col("_n") - 1, 1.0).otherwise(1 - keep)
    return placed.groupBy(source).agg(
        F.count("*").alias("calls"), F.count_if(F.col(rows) > 0).alias("with_rows"), F.bround(100.0 * F.count_if(F.col(rows) > 0) / F.count("*"), 1).alias("hit_rate"),
        F.max(millis).alias("max_ms"), F.round(F.sum(F.col(millis) * weight), 4).alias("avg_ms"),
    )


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows reached each stage, and each stage's share of the stage before, in per cent."""
    agg = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in stages])
    names = ["total", *[n for n, _ in stages]]
    shares = [F.when(F.col(a) > 0, F.bround(100.0 * F.col(b) / F.col(a), 1)).alias(f"{b}_rate") for a, b in zip(names, names[1:], strict=False)]
    return agg.select(*names, *shares)
