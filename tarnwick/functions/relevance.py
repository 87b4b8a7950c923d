"""How well a posting's title and description answer a search, as column expressions over a few given searches."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.text import PLURALS, let, singular

#: Fixed spellings that are one word for search, in the order they are replaced.
SPELLINGS = (
    ("full-stack", "fullstack"), ("full stack", "fullstack"), ("front-end", "frontend"), ("front end", "frontend"), ("back-end", "backend"), ("back end", "backend"), ("node.js", "nodejs"), ("react.js", "reactjs"),
    ("vue.js", "vuejs"), ("c++", "cpp"), ("c#", "csharp"), (".net", "dotnet"), ("softwareentwickler", "software entwickler"), ("softwareingenieur", "software ingenieur"), ("webentwickler", "web entwickler"),
    ("systemutvecklare", "software utvecklare"),
)
WORD = r"[a-zà-ÿ0-9+#]+"


@dataclass(frozen=True)
class SearchWords:
    """Words that don't count, words that count only alone, words that stand for each other, and techniques without which a title is no answer."""

    stop: tuple[str, ...] = ("and", "the", "of", "for", "in", "a", "at", "with")
    soft: tuple[str, ...] = ("senior", "junior", "lead", "remote", "hybrid")
    classes: tuple[tuple[str, ...], ...] = (("developer", "engineer", "programmer", "entwickler", "développeur"), ("golang", "go"), ("frontend", "ui"))
    anchors: tuple[str, ...] = ("python", "java", "react", "flutter", "golang", "rust", "nodejs", "csharp", "cpp")
    role: str = "developer"

    def class_of(self, word: str) -> str:
        return next((f"#{n}" for n, words in enumerate(self.classes) if word in words), word)


def search_tokens(text: Column, words: SearchWords) -> Column:
    """Words of a text for search: one spelling, stop words out, plurals of roles reduced."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for written, meant in SPELLINGS:
        low = F.replace(low, F.lit(written), F.lit(meant))
    return F.transform(F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*words.stop)), singular)


def search_classes(text: Column, words: SearchWords) -> Column:
    """search_tokens() with words that stand for each other made one."""
    members = {w: f"#{n}" for n, group in enumerate(words.classes) for w in group}
    known = F.create_map(*[x for w, key in members.items() for x in (F.lit(w), F.lit(key))])
    return F.transform(search_tokens(text, words), lambda w: F.coalesce(F.element_at(known, w), w))


def core_words(query: str, words: SearchWords) -> list[str]:
    """The words of a search without soft ones (unless there are no others). Searches are few and known when the plan is made."""
    low = query.lower()
    for written, meant in SPELLINGS:
        low = low.replace(written, meant)
    out = []
    for w in re.findall(WORD, low):
        if w not in words.stop:
            out.append(w[:-3] + "y" if len(w) > 4 and w.endswith("ies") else w[:-1] if len(w) > 4 and w.endswith(PLURALS) else w)
    return [w for w in out if w not in words.soft] or out


def relevance(query: str, title: Column, description: Column, words: SearchWords) -> Column:
    """0 to 100: the phrase in the title 100, all its words 90, some 40 to 80, the description alone at most 38; a technique must be named."""
    return F.get(relevances([query], title, description, words), F.lit(0))


def relevances(queries: list[str], title: Column, description: Column, words: SearchWords) -> Column:
    """Array of relevance() of each query: title and description are read once for all of them."""
    low = lambda text: F.lower(F.coalesce(text, F.lit("")))
    each = lambda t, x, named, described: F.array(*[_judged(q, t, x, named, described, words) for q in queries])
    return let(low(title), lambda t: let(low(description), lambda x: let(search_classes(t, words), lambda named: let(search_classes(x, words), lambda described: each(t, x, named, described)))))


def _judged(query: str, plain_title: Column, plain_text: Column, named: Column, described: Column, words: SearchWords) -> Column:
    core = core_words(query, words)
    if not core:
        return F.lit(50)
    low = query.lower().strip()
    asked = [words.class_of(w) for w in core]
    anchors = sorted({words.class_of(w) for w in core if w in words.anchors})
    lit = lambda values: F.array(*map(F.lit, values))
    hits = sum((F.array_contains(named, a).cast("int") for a in asked), F.lit(0))
    far = sum((F.array_contains(described, a).cast("int") for a in asked), F.lit(0))
    out = F.when(plain_title.rlike(rf"\b{re.sub(r'([^\w\s])', r'\\\1', low)}\b"), 100)
    if anchors:
        missing = ~F.arrays_overlap(named, lit(anchors))
        out = out.when(missing & ~F.arrays_overlap(described, lit(anchors)), 0).when(missing, F.when(F.array_contains(named, words.class_of(words.role)), 38).otherwise(25))
    some = F.floor(40 + 30.0 * hits / len(asked) + F.when(F.array_contains(named, asked[-1]), 10).otherwise(0)).cast("int")
    return out.when(hits == len(asked), 90).when(hits > 0, some).when(plain_text == "", 0).when(plain_text.contains(low), 35).otherwise(F.floor(25.0 * far / len(asked)).cast("int"))


def best_relevance(queries: list[str], title: Column, description: Column, words: SearchWords) -> Column:
    asked = [q for q in queries if q]
    return F.greatest(F.lit(0), F.array_max(relevances(asked, title, description, words))) if asked else F.lit(0)
