"""Phrases and names of tools in postings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.text import let

#: Fixed words that end a phrase, that begin a duty, of people, of languages, and short forms in capitals.
STOP = (
    "a an the and or of to in on for with by at as is are be we you our your will can must should have has that this these those it its their them who what which from into across within via such etc "
    "plus also including other any all more most very well per e.g i.e looking hiring seeking join team role position candidate ideal company experience experienced knowledge understanding familiarity proficiency proficient "
    "ability able skills skill strong excellent good solid proven great deep required requirements requirement preferred nice bonus responsibilities qualifications years year minimum least degree bachelor bachelor's master master's relevant "
    "related field similar equivalent new using use used based work working environment opportunity help make ensure need needs like want someone day "
    "le la les des du de et ou en un une pour avec sur dans nous vous votre notre est sont aux au par"
).split()
VERBS = (
    "build building maintain maintaining design designing develop developing create implement implementing ensure ensuring collaborate collaborating communicate provide providing troubleshoot troubleshooting manage managing document documenting install "
    "configure handle handling resolve resolving meet escalate support supporting lead leading drive own deliver delivering write writing test testing deploy deploying monitor monitoring optimize optimizing improve improving analyze analyse "
    "analyzing perform conduct participate contribute coordinate review mentor train define plan track report prepare assist process respond answer identify migrate integrate integrating automate automating scale architect gather translate"
).split()
PEOPLE = "scientists engineers developers stakeholders colleagues managers members teammates clients users partners peers people staff analysts".split()
LANGUAGES = "english french spanish german arabic italian portuguese chinese russian turkish dutch romanian anglais français francais espagnol allemand arabe".split()
SHORT_FORMS = "etl elt api apis rest sql nosql ci cd ci/cd aws gcp kpi kpis sla slas crm erp ui ux qa it bi ml ai nlp seo hr itil saas b2b b2c os macos ios mvp".split()
SPELLED = {"macos": "macOS", "ios": "iOS", "apis": "APIs", "kpis": "KPIs", "slas": "SLAs"}
#: Fixed words with a capital that name no tool, and short forms that don't either.
NO_TOOLS = (
    "we you our the a an and or for with in on to of as is are experience strong excellent knowledge must nice plus bonus requirements required responsibilities about what who why how join senior junior lead remote "
    "hybrid full time part contract bachelor master degree phd years year team company role position job salary benefits location office work monday friday january february march april may june july august september october november "
    "december europe usa uk eu ok etc i it all any please apply"
).split()
#: Fixed signs between clauses, of a clause about degrees, of words, of names, and after which a sentence begins.
CLAUSES = r"(?i)[\n.;:!?()•·]|\s[-–—/]\s|,\s|\band\b|\bor\b|\bet\b|\bou\b"
DEGREES = r"(?i)\b(degree|bachelor|master|diploma|licen[cs]e|dipl[oô]me|phd|bac\s*\+)"
WORD, NAME = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9+#./'-]*", r"[A-Za-z][A-Za-z0-9+#]*+(?:[./][A-Za-z0-9+#]++)*+"
BEGINS, LONGEST = ".!?:•·-–—(", 4
#: A mark before a word that may end a run, and a run with the word that ends it.
_MARK = "\x01"
_RUN = f"({_MARK}?[^{_MARK}]*+)(?:{_MARK}[^ {_MARK}]*+ ?)?"


def _words_of(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _trimmed(run: Column) -> Column:
    """The last words of a run without verbs and stop words at its beginning and stop words at its end."""

    def inner(low: Column, words: Column) -> Column:
        first = F.array_position(F.transform(low, lambda w: w.isin(*STOP, *VERBS)), False).cast("int")
        last = F.array_position(F.transform(F.reverse(low), lambda w: w.isin(*STOP)), False).cast("int")
        kept = lambda at: F.size(low) - at["first"] - at["last"] + 2
        return let(F.struct(first.alias("first"), last.alias("last")), lambda at: F.when((at["first"] > 0) & (kept(at) > 0), F.slice(words, at["first"], kept(at))).otherwise(F.array().cast("array<string>")))

    words = F.split(F.translate(F.substring_index(F.rtrim(run), " ", -LONGEST), _MARK, ""), " ")
    return let(words, lambda w: let(F.transform(w, F.lower), lambda low: inner(low, w)))


def phrase_runs(text: Column) -> Column:
    """The runs of two to four words of a text, in order, each as its words: clause by clause, broken at stop words (of and de hold them together).

    A stop word that would begin a run does not break it, so of stop words in a row every other one does. Clauses about degrees are left out.
    """
    clauses = F.filter(F.split(F.coalesce(text, F.lit("")), CLAUSES), lambda c: ~c.rlike(DEGREES))
    breaks = [w for w in STOP if w not in ("of", "de")]
    marked = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda t: F.when(F.lower(t).isin(*breaks), F.concat(F.lit(_MARK), t)).otherwise(t)), " ")
    several = lambda r: F.instr(F.rtrim(r), " ") > 0
    runs = F.flatten(F.transform(clauses, lambda c: F.filter(F.regexp_extract_all(marked(c), F.lit(_RUN), F.lit(1)), several)))
    return F.filter(F.transform(runs, _trimmed), lambda r: F.size(r) >= 2)


def telling(run: Column, title: Column, tools: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a run says something of the work: no people, not only tools, languages or the title's words, not beginning with a number, and not excluded."""

    titled = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)

    def judged(low: Column, title_words: Column) -> Column:
        key, of = F.array_join(low, " "), lambda words: F.forall(low, lambda w: w.isin(*words) if len(words) else F.lit(False))
        tooled = (key.isin(*tools) | of(tools)) if tools else F.lit(False)
        return ~F.exists(low, lambda w: w.isin(*PEOPLE)) & ~tooled & ~of(LANGUAGES) & ~F.forall(low, lambda w: F.array_contains(title_words, w)) & ~F.get(low, F.lit(0)).rlike(r"^[0-9]+\+?$") & (~key.isin(*exclude) if exclude else F.lit(True))

    return let(F.transform(run, F.lower), lambda low: let(titled, lambda words: judged(low, words)))


def shown(run: Column, spelled: Mapping[str, str] | None = None) -> Column:
    """A run as it is shown: known tools and short forms as they are spelled, other words in lower case with a capital."""
    known = F.create_map(*[F.lit(x) for kv in ({w: w.upper() for w in SHORT_FORMS} | SPELLED | dict(spelled or {})).items() for x in kv])
    return F.array_join(F.transform(run, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), F.when(w == F.lower(w), F.concat(F.when(w.startswith("ß"), "Ss").otherwise(F.upper(F.substring(w, 1, 1))), F.substring(w, 2, 1 << 30))).otherwise(w))), " ")


def unnested(keys: Column, most: int) -> Column:
    """The first `most` of the keys of which none holds another or is held by one that came before."""
    none = F.array().cast("array<string>")
    return F.aggregate(keys, none, lambda kept, k: F.when((F.size(kept) < most) & ~F.exists(kept, lambda o: o.contains(k) | k.contains(o)), F.concat(kept, F.array(k))).otherwise(kept))


def named_tools(text: Column, known: Column, title: Column, company: Column, most: int = 8) -> Column:
    """The first `most` names of tools in a text, each once whatever its case: in camel case, of two to six capitals, or with a capital inside a sentence.

    Names that `known` (a CV) holds, words of title and company, languages and usual words are left out.
    """
    text = F.coalesce(text, F.lit(""))
    names, gaps = F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), F.split(text, NAME, -1)
    skip = F.transform(F.concat(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0)) for c in (title, company)]), F.lower)
    low_cv = F.lower(F.coalesce(known, F.lit("")))

    def is_tool(x: Column, skipped: Column, cv: Column) -> Column:
        w, gap = x["name"], F.rtrim(x["gap"], F.lit(" \t\r\n\x0b\x0c"))
        low = F.lower(w)
        camel, capitals, capital = w.rlike("[a-z][A-Z]"), w.rlike("^[A-Z]{2,6}$"), w.rlike("^[A-Z][^A-Z]*[a-z][^A-Z]*$")
        begins = F.when(gap == "", x["no"] == 0).otherwise(F.lit(BEGINS).contains(F.substring(gap, -1, 1)))
        usual = low.isin(*NO_TOOLS, *STOP, *LANGUAGES) | F.array_contains(skipped, low) | (F.char_length(w) < 2) | (capitals & low.isin("it", "hr", "ok"))
        in_cv = cv.contains(low) & F.rlike(cv, F.concat(F.lit(r"(?<!\w)\Q"), low, F.lit(r"\E(?!\w)")))
        return (camel | capitals | (capital & ~begins)) & ~usual & ~in_cv

    pairs = F.zip_with(names, gaps, lambda w, gap: F.struct(w.alias("name"), gap.alias("gap")))  # one gap more than names: the last has no name
    each = F.filter(F.transform(pairs, lambda x, i: F.struct(x["name"].alias("name"), x["gap"].alias("gap"), i.alias("no"))), lambda x: x["name"].isNotNull())
    tools = let(skip, lambda skipped: let(low_cv, lambda cv: F.transform(F.filter(each, lambda x: is_tool(x, skipped, cv)), lambda x: x["name"])))
    firsts = let(tools, lambda t: let(F.transform(t, F.lower), lambda low: F.transform(F.slice(F.array_distinct(low), F.lit(1), F.lit(most)), lambda k: F.get(t, F.array_position(low, k).cast("int") - 1))))
    return firsts
