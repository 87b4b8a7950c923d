"""What a post or posting says of itself: hidden text, required languages, countries, hiring, authors, titles, amounts; as column expressions."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.names import folded
from tarnwick.functions.relevance import SearchWords, core_words, search_classes, search_tokens
from tarnwick.functions.text import let

#: Invisible characters, directives to a language model, and requests that show a reader's attention, each with its label.
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}\x{e0000}-\x{e007f}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INJECTIONS = {
    "Prompt-injection directive": r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|directions?)\b",
    "Role/delimiter hijack": r"(?i)\b(?:you\s+are\s+now|new\s+instructions?:|system\s+prompt:|assistant:|<\s*/?\s*(?:system|instruction|prompt)\s*>)",
    "Model chat-template token": r"(?i)(?:<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|<<SYS>>)",
    "Concealment instruction": r"(?i)\b(?:do\s+not\s+mention|never\s+mention|hide\s+this\s+from\s+the\s+user)\b",
}
ATTENTION = {
    "Recruiter attention check": r"(?i)\b(?:if\s+you(?:'ve|\s+have)?\s+read\s+this(?:\s+far)?|to\s+show\s+you\s+read\s+this|to\s+prove\s+you(?:'re|\s+are)\s+(?:human|not\s+a\s+bot|paying\s+attention))",
    "Secret keyword required in application": r"(?i)\b(?:include|mention|write|put|add)\s+(?:the\s+)?(?:word|phrase|code\s*word|secret\s+word)\s+['\"“”‘’]?[A-Za-z0-9_-]{3,30}['\"“”‘’]?\s+in\s+your\s+(?:application|cover\s+letter|resume|cv|message|note)",
}
#: Invisible characters from which on a text counts as hostile.
HOSTILE_FROM = 5
#: Languages that a posting may require, and the phrases around their names.
LANGUAGES = (
    "german", "dutch", "french", "spanish", "arabic", "italian", "portuguese", "danish", "swedish", "norwegian", "finnish", "polish", "mandarin", "chinese", "japanese", "korean", "hebrew", "turkish", "russian",
)
BEFORE_LANGUAGE = r"\b(?:fluent|fluency|proficient|proficiency|native|c1|c2|b2|business\s+level|mother\s+tongue|strong\s+command|written\s+and\s+spoken)\b[^.\n]{0,35}\b"
AFTER_LANGUAGE = r"\b[^.\n]{0,30}\b(?:fluent|fluency|required|mandatory|essential|c1|c2|native|is\s+a\s+must|speaking\s+required)\b"
MUST_SPEAK = r"\b(?:must|need\s+to)\s+speak\s+"
#: A site's own lines around a post, in the order they are taken out.
CHROME = (
    r"(?i)\b(?:\d+\s*million\+|1\s*billion\+?)?\s*members\s*\|\s*manage your professional identity\.?", r"(?i)manage your professional identity\.?\s*build and engage with your professional network\.?",
    r"(?i)build and engage with your professional network\.?\s*access knowledge,\s*insights and opportunities\.?", r"(?i)access knowledge,\s*insights and opportunities\.?", r"(?i)sign in to view more content.*$", r"(?i)create your free account or sign in.*$",
)
#: What every text with one of them holds in lower case: a cheap test before the patterns.
CHROME_HOLDS = ("manage your professional identity", "build and engage with your professional network", "access knowledge,", "sign in to view more content", "create your free account or sign in")
APPLY_LINK = r"(?i)https?://[^\s]+(?:apply|job|career|lever\.co|greenhouse\.io|workday|ashbyhq\.com|bamboohr\.com)"
HIRING_HEADLINE = r"(?i)\b(recruiter|talent acquisition|hiring manager|head of talent|technical recruiter|hr manager|lead recruiter|sourcer|hrbp|people operations)\b"
#: Kinds of words that a plausible posting has, and the least of its length and of such words.
POSTING_WORDS = (
    r"(?i)\b(?:responsibilities|requirements|qualifications|experience|skills|about\s+(?:the\s+role|us|the\s+job|you)|what\s+you(?:'ll|\s+will)|who\s+you\s+are|we\s+are\s+looking|role|position|team|benefits|mission|duties|years|degree|bachelor|engineer|developer"
    r"|software|design|build|maintain|collaborate|architecture)\b"
)
LEAST_POSTING, LEAST_WORDS = 140, 2
#: Hours that each range of time takes; a day is taken for two, as posts give their age in days.
RANGES = {"24h": 48.0, "week": 168.0, "month": 720.0}


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _labels(text: Column, patterns: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items()]), lambda x: x.isNotNull())


def guarded(text: Column) -> Column:
    """Struct (text, invisible, injections, attention, hostile): the text without hidden characters, and what it tries on a reader. Null is empty."""
    raw = F.coalesce(text, F.lit(""))
    hidden = F.regexp_count(raw, F.lit(INVISIBLE))
    clean = F.regexp_replace(F.regexp_replace(raw, INVISIBLE, ""), CONTROL, "")
    injections = _labels(clean, INJECTIONS)
    return F.struct(clean.alias("text"), hidden.alias("invisible"), injections.alias("injections"), _labels(clean, ATTENTION).alias("attention"), ((F.size(injections) > 0) | (hidden >= HOSTILE_FROM)).alias("hostile"))


def language_gate(title: Column, description: Column, cv: Column) -> Column:
    """Struct (score, required, missing): languages that a posting requires, and which of them a CV doesn't name (all, without a CV)."""
    return let(F.concat(_low(title), F.lit("\n"), _low(description)), lambda said: let(_low(cv), lambda own: _gated(said, own)))


def _gated(said: Column, own: Column) -> Column:
    asks = lambda x: said.contains(x) & said.rlike(rf"{BEFORE_LANGUAGE}{x}\b|\b{x}{AFTER_LANGUAGE}|{MUST_SPEAK}{x}\b")
    present = lambda test: F.filter(F.array(*[F.when(test(x), F.lit(x.capitalize())) for x in LANGUAGES]), lambda x: x.isNotNull())
    lacking = lambda required: F.array_except(required, present(lambda x: own.contains(x) & own.rlike(rf"\b{x}\b")))
    score = lambda required, missing: F.when(F.size(required) == 0, 4.5).when(F.size(missing) == 0, 4.8).when(own == "", 3.0).otherwise(1.8)
    return let(present(asks), lambda required: let(lacking(required), lambda missing: F.struct(score(required, missing).alias("score"), required.alias("required"), missing.alias("missing"))))


@dataclass(frozen=True)
class Country:
    names: tuple[str, ...]
    iso: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()


@dataclass(frozen=True)
class Atlas:
    """Countries by their canonical names: bring your own, this is a short one."""

    countries: dict[str, Country] = field(default_factory=lambda: {
        "romania": Country(("romania", "românia"), ("ro", "rou"), ("bucharest", "cluj", "iasi")), "germany": Country(("germany", "deutschland"), ("de", "deu"), ("berlin", "munich", "köln")),
        "france": Country(("france",), ("fr", "fra"), ("paris", "lyon")), "portugal": Country(("portugal",), ("pt", "prt"), ("porto", "lisbon")),
    })

    def canonical(self, said: str) -> str:
        low = said.strip().lower()
        return next((name for name, c in self.countries.items() if low == name or low in c.names + c.iso), low)


def country_canon(said: Column, atlas: Atlas) -> Column:
    """The canonical name of a country by any of its names or codes; other words stay as they are, in lower case."""
    low = F.trim(_low(said))
    names = {alias: name for name, c in reversed(atlas.countries.items()) for alias in (name, *c.names, *c.iso)}
    known = F.create_map(*[x for alias, name in names.items() for x in (F.lit(alias), F.lit(name))])
    return F.coalesce(F.element_at(known, low), low)


def _any_word(low: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text, as written or with plain letters in both."""
    if not words:
        return F.lit(False)
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if ord(c) < 128)
    either = lambda ws: r"\b(?:" + "|".join(re.escape(w) for w in ws) + r")\b"
    return low.rlike("(?U)" + either(words)) | folded(low).rlike(either([plain(w) for w in words]))


def in_countries(location: Column, title: Column, url: Column, wanted: list[str], atlas: Atlas) -> Column:
    """Whether a posting is in one of the wanted countries: neither its place nor its title may name another country alone; then the place counts, the title if
    the place says nothing, and a board's address for the country. Wanting none, or the whole world, takes everything."""
    asked = [w.strip().lower() for w in wanted if w and w.strip()]
    if not asked or {"worldwide", "global", "all", "remote", "anywhere"} & set(asked) or any(w.startswith("remote ") for w in asked):
        return F.lit(True)
    targets = [atlas.canonical(w) for w in asked]
    own = [atlas.countries[t] for t in targets if t in atlas.countries]
    allowed = {w for c in own for w in c.names + c.cities}
    foreign = tuple(w for name, c in atlas.countries.items() if name not in targets for w in c.names + c.cities if len(w) >= 4 and w not in allowed)
    named = tuple(w for c in own for w in c.names + c.cities) + tuple(t for t in targets if t not in atlas.countries)
    codes = tuple(i for c in own for i in c.iso)
    place, head, link = F.trim(_low(location)), F.trim(_low(title)), _low(url)

    def here(x: Column) -> Column:
        return _any_word(x, named) | (x.rlike(r"\b(?:" + "|".join(map(re.escape, codes)) + ")$") if codes else F.lit(False))

    contradicted = lambda x: _any_word(x, foreign) & ~here(x)
    boards = [i for i in codes if len(i) == 2]
    local = link.rlike(rf"://(?:{'|'.join(boards)})\.indeed\.") if boards else F.lit(False)
    silent = place.isin("", "remote", "hybrid", "onsite", *asked)
    return ~contradicted(place) & ~contradicted(head) & (here(place) | (silent & here(head)) | local)


def without_chrome(text: Column) -> Column:
    """A post without the lines that its site puts around it."""

    def bared(plain: Column) -> Column:
        out = plain
        for pattern in CHROME:
            out = F.regexp_replace(out, pattern, " ")
        framed = let(F.lower(plain), lambda low: F.exists(F.array(*map(F.lit, CHROME_HOLDS)), lambda w: low.contains(w)))
        return F.when(framed, out).otherwise(plain)

    return F.trim(F.regexp_replace(let(F.coalesce(text, F.lit("")), bared), r"\s+", " "))


def _links_to_apply(text: Column) -> Column:
    """Whether a link is one of APPLY_LINK. Each run of characters is tested once from its beginning, so long runs of links take linear time."""
    runs = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s]+"), F.lit(0))
    return F.exists(runs, lambda u: u.rlike(APPLY_LINK.replace("(?i)", "(?i)^").replace("+(", "+?(")))


def hiring_intent(text: Column, headline: Column, against: tuple[str, ...], signals: tuple[str, ...], words: tuple[str, ...]) -> Column:
    """Struct (hiring, signals) of a post: any pattern against rejects; a signal, a link to apply, a recruiter's headline or, failing those, a word accepts."""
    said = lambda clean: F.lower(F.trim(F.concat_ws(" ", clean, F.coalesce(headline, F.lit("")))))
    return let(without_chrome(text), lambda clean: let(said(clean), lambda low: _hires(clean, low, headline, against, signals, words)))


def _hires(clean: Column, said: Column, headline: Column, against: tuple[str, ...], signals: tuple[str, ...], words: tuple[str, ...]) -> Column:
    found = F.filter(F.array(*[F.nullif(F.trim(F.regexp_extract(said, p, 0)), F.lit("")) for p in signals], F.when(_links_to_apply(clean), F.lit("direct_apply_link")), F.when(F.coalesce(headline, F.lit("")).rlike(HIRING_HEADLINE), F.lit("recruiter_author"))), lambda x: x.isNotNull())
    weak = F.lit(False)
    for w in words:
        weak = weak | said.contains(w)
    none = F.array().cast("array<string>")
    signs = let(found, lambda f: F.when(F.size(f) > 0, f).when(weak, F.array(F.lit("verified_hiring_keyword"))).otherwise(none))
    out = (clean == "") | (F.char_length(said) < 20)
    for p in against:
        out = out | said.rlike(p)
    return let(F.when(out, none).otherwise(signs), lambda f: F.struct((F.size(f) > 0).alias("hiring"), f.alias("signals")))


def author_kind(name: Column, headline: Column, url: Column, bots: tuple[str, ...], recruiters: tuple[str, ...]) -> Column:
    """Struct (kind, delta): a page that reposts −15, a recruiter +8, a named member's post +3."""
    low = F.trim(_low(name))
    both = F.concat(low, F.lit(" "), F.trim(_low(headline)))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: both.contains(w))
    member = _low(url).contains("linkedin.com/posts/") & (low != "") & (low != "linkedin recruiter")
    kind = F.when(holds(bots), "aggregator_bot").when(holds(recruiters), "human_recruiter").when(member, "verified_member").otherwise("member_or_company")
    return F.struct(kind.alias("kind"), F.when(kind == "aggregator_bot", -15).when(kind == "human_recruiter", 8).when(kind == "verified_member", 3).otherwise(0).alias("delta"))


def amount(text: Column) -> Column:
    """A number written with either separator of thousands and decimals: one within the last three characters is the decimal one. Null if there is no number."""
    kept = F.regexp_replace(text, "[^-0-9.,]", "")
    cut = F.greatest(F.char_length(kept) - 3, F.lit(0))
    head, tail = F.substring(kept, F.lit(1), cut), F.substring(kept, cut + 1, F.lit(3))
    return F.round(F.concat(F.regexp_replace(head, "[.,]", ""), F.when(tail.contains("."), tail).otherwise(F.replace(tail, F.lit(","), F.lit(".")))).try_cast("double"), 2)


def plausible(text: Column) -> Column:
    """Whether a text is long enough for a posting and has two of a posting's words."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return (F.char_length(clean) >= LEAST_POSTING) & (F.regexp_count(clean, F.lit(POSTING_WORDS)) >= LEAST_WORDS)


def best_option(options: Column, wanted: Column, unreal: str) -> Column:
    """The first of `options` (structs of text, value, disabled) equal to what is wanted, else the first containing or contained in it; null if none."""
    target = F.trim(_low(wanted))
    clean = F.transform(options, lambda o: F.struct(F.trim(F.coalesce(o["text"], F.lit(""))).alias("text"), F.trim(F.coalesce(o["value"], F.lit(""))).alias("value"), F.coalesce(o["disabled"], F.lit(False)).alias("disabled")))
    real = F.filter(clean, lambda o: ((o["text"] != "") | (o["value"] != "")) & ~o["disabled"] & ~o["text"].rlike(unreal))
    exact = F.filter(real, lambda o: (F.lower(o["text"]) == target) | (F.lower(o["value"]) == target))
    part = F.filter(real, lambda o: F.contains(F.lower(o["text"]), target) | ((F.char_length(o["text"]) >= 2) & F.contains(target, F.lower(o["text"]))))
    return F.when(target != "", F.coalesce(F.get(exact, F.lit(0)), F.get(part, F.lit(0))))


def post_score(match: Column, fit: Column, asked_years: Column, own_years: Column) -> Column:
    """The better of match and nine tenths of fit; +4 (99 at most) with years enough, −10 (35 at least) with three too few. Without a match, fit."""
    base = F.greatest(match, F.floor(fit * 0.9).cast("int"))
    enough = F.when(own_years + 1 >= asked_years, F.least(F.lit(99), base + 4)).when(asked_years - own_years >= 3, F.greatest(F.lit(35), base - 10))
    return F.when(match.isNull(), fit).otherwise(F.coalesce(enough, base))


def in_range(hours: Column, said: Column, known_day: Column, best_effort: Column, preset: str) -> Column:
    """Whether a post is in a range of RANGES: by its age, by an age said to be less than something, or as best effort; other ranges take all."""
    if preset not in RANGES:
        return F.lit(True)
    fits = F.coalesce(hours <= RANGES[preset], F.coalesce(said, F.lit("")).startswith("<")) | F.coalesce(best_effort, F.lit(False))
    return fits | F.coalesce(known_day, F.lit(False)) if preset == "24h" else fits


def rolling(seen: Column, new: Column, most: int = 50) -> Column:
    """The last `most` of what was seen and what is new to it."""
    both = F.concat(seen, F.filter(new, lambda x: ~F.array_contains(seen, x)))
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - most + 1), F.lit(most))


def thinness(source_words: Column, out_words: Column, least: int = 120, share: float = 0.6) -> Column:
    """The percentage of a CV's words that an output keeps, where it is too small; null for short sources and outputs that keep enough."""
    return F.when((source_words >= least) & (out_words < share * source_words), F.floor(100 * out_words / source_words).cast("int"))


def strict_match(queries: list[str], title: Column, description: Column, url: Column, words: SearchWords) -> Column:
    """Whether a posting of a feed answers one of the searches: the phrase or all telling words in the title, their like with the role, or the role with each telling word three times in the description."""
    head, raw, classes, far = _low(title), search_tokens(title, words), search_classes(title, words), search_tokens(description, words)
    out = F.lit(False)
    for query in queries:
        core = core_words(query, words)
        if not core:
            continue
        telling, role = (core[:-1], core[-1]) if len(core) > 1 else (core, None)
        every = lambda test: F.forall(F.array(*map(F.lit, telling)), test)
        out = out | head.rlike(r"\b" + re.escape(query.lower().strip()) + r"\b") | every(lambda w: F.array_contains(raw, w))
        if role:
            alike = F.forall(F.array(*[F.lit(words.class_of(w)) for w in telling]), lambda c: F.array_contains(classes, c))
            often = every(lambda w: F.size(F.filter(far, lambda x: x == w)) >= 3)
            out = out | (F.array_contains(classes, words.class_of(role)) & (alike | often))
    return (head != "") & (F.coalesce(url, F.lit("")) != "") & out


def address_score(address: Column, named: Column, blocked: Column, routed: Column, hiring: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """Struct (confidence, recruitment, advice) of a mailbox: 50 for a named recruiter, 45 for a hiring mailbox, else 15, and 45 if its domain takes mail (`routed`, a column: nothing is looked up here)."""
    low = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    box = F.substring_index(low, "@", 1)
    bare = F.regexp_replace(box, r"[._\-+0-9]", "")
    hires = bare.isin(*hiring) | F.exists(F.array(*map(F.lit, hiring)), lambda w: box.contains(w))
    person = F.coalesce(named, F.lit(False))
    wrong = ~low.contains("@") | F.coalesce(blocked, F.lit(False)) | box.isin(*other) | box.rlike(rf"^(?:{'|'.join(other)})[._-]") | ~F.coalesce(routed, F.lit(False))
    confidence = F.when(wrong, 0).when(person, 95).when(hires, 90).otherwise(60)
    fit = ~wrong & (person | hires)
    advice = F.when(fit & (confidence >= 80), "send").when(confidence >= 50, "review").otherwise("do not send")
    return F.struct(confidence.alias("confidence"), fit.alias("recruitment"), advice.alias("advice"))


def indian_pay(text: Column) -> Column:
    """Struct (least, most) in rupees of a range in lakh (100,000) or crore (10,000,000); null if the text isn't one."""
    range_ = r"(?i)^(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*(Lacs|Lakh|Cr)"
    clean = F.trim(text)
    unit = F.when(F.lower(F.regexp_extract(clean, range_, 3)) == "cr", 1e7).otherwise(1e5)
    part = lambda n: F.floor(F.regexp_extract(clean, range_, n).try_cast("double") * unit).cast("long")
    return F.when(clean.rlike(range_), F.struct(part(1).alias("least"), part(2).alias("most")))


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """How often the keywords stand in a text as whole words, all together."""
    low = _low(text)
    return sum((F.regexp_count(low, F.lit(rf"(?<!\w){re.escape(k.lower())}(?!\w)")) for k in keywords if k), F.lit(0))


def span_months(y0: Column, m0: Column, y1: Column, m1: Column, present: Column, today: Column) -> Column:
    """Months that a span of a CV covers, both ends counted, at least 1. Without an end 1, or 3 if only a year is known; without a start 0. An unknown month is January at the start and December at the end."""
    open_ = F.coalesce(present, F.lit(False))
    last_year, last_month = F.when(open_, F.year(today)).otherwise(y1), F.when(open_, F.month(today)).otherwise(F.coalesce(m1, F.lit(12)))
    months = F.greatest(F.lit(1), (last_year - y0) * 12 + last_month - F.coalesce(m0, F.lit(1)) + 1)
    return F.when(y0.isNull(), 0).when(~open_ & y1.isNull(), F.when(m0.isNull(), 3).otherwise(1)).otherwise(months)


def found_in(query: Column, addresses: Column, mails: Column, fields: list[Column], emails_only: bool) -> Column:
    """Whether a search stands in one of an application's addresses, its messages' names or subjects or, unless only mail is searched, its own fields."""
    q = F.trim(F.lower(query))
    among = lambda values: F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), q))
    out = (F.coalesce(query, F.lit("")) == "") | among(addresses) | among(mails)
    return F.coalesce(out if emails_only else out | among(F.array(*fields)), F.lit(False))
