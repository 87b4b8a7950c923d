"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.html_pages import labelled_pages

#: Labelled pages that the field is trained on, at most.
MOST_LABELLED = 5_000

#: Fixed element names: text of the first is never shown as text; the next do not end a block; the next have no content; what an element closes.
_RAW = "script|style|title|textarea|noscript|template|svg|iframe|select|object|canvas"
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div section article aside main body header footer nav form blockquote td th li dd figure".split())

#: What stands in a tag behind its name. As in a browser, a quote opens a value only behind an equals sign; elsewhere it is a sign like any other.
_REST = r"""(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]+|=)*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>]|\Z){_REST}(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>{_REST})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW.split("|")}
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed groups of names found in classes, ids and roles.
_NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topnav subnav pagination pager toc tabs tab skip",
    "header": "header masthead topbar top branding logo banner hero",
    "footer": "footer foot bottom colophon copyright legal imprint contentinfo",
    "side": "sidebar side aside widget widgets related recommended recommendations rail trending popular more complementary teaser teasers also latest",
    "ad": "ad ads advert adverts advertisement advertising adsbox sponsored sponsor sponsors promo promos promotion promoted dfp adsense outbrain taboola partner",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal newsletter subscribe subscription paywall overlay toast dialog privacy signup disclaimer warning message notification",
    "form": "form search login signin register contact input field captcha",
    "comment": "comment comments reply replies disqus discussion responses respond commentlist feedback reviews thread reader readers",
    "meta": "share sharing social tags tag meta byline author date toolbar tools print email rating buttons follow",
    "main": "content main article post entry story body text maincontent articlebody postbody page blog prose",
}
_GROUP = {name: group for group, names in _NAMES.items() for name in names.split()}
#: Words after which a name tells of a state or of what else is on the page, as in has-sidebar or content-with-sidebar; groups of tags.
_STATE = frozenset("has have no not with without is js enable enabled disable disabled show hide free".split())
_TAG_GROUP = {"nav": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "button": "form", "label": "form", "select": "form", "article": "main", "main": "main"}
#: Fixed words that hint at a part by its text.
_HINT = re.compile(r"\b(cookies?|subscribe|newsletter|sponsored|advertisement|copyright|all rights reserved|share|log ?in|sign (?:in|up)|comments?|repl(?:y|ies)|read more|related|privacy)\b", re.I)


#: Features of blocks in elements of other parts than the article, by tag or by name, and of those in an article's element.
_OTHER_TAGS = frozenset(f"t:{x}" for x in "nav header footer aside form button label select".split()) | {"hidden"}
_OTHER = _OTHER_TAGS | {f"g:{x}" for x in _NAMES if x not in ("main", "meta")}
_BODY = frozenset({"t:article", "t:main"})
#: Features of blocks whose nearest named element is of another part.
_APART = frozenset(f"n:{x}" for x in _NAMES if x not in ("main", "meta"))
#: An element with more than this share of a page's text that holds all of its articles is a wrapper, whose names say nothing.
_WRAPS = 0.6


@dataclass
class Block:
    text: str
    above: frozenset[str]
    tag: str
    linked: int


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order: runs of text that no block element interrupts, white space made one space.

    `above` has the features of all ancestors (tags, groups and words of their classes, ids and roles), of which only
    `known` ones are kept, so that a deep page stays small, and the group of the nearest named one, which is
    that of its outermost part: what a comment calls its content is no article. Names of html and body and of wrappers don't count.
    """
    runs: list[tuple[str, int, str, int]] = []
    # element by element in page order: the one around it, its tag, its features, its groups
    around, names, own_of, groups_of = [-1], [""], [frozenset()], [frozenset()]
    stack: list[tuple[str, int, str]] = [("", 0, "")]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    links = linked = 0
    at = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                runs.append((text, stack[-1][1], stack[-1][2], linked))
            pieces.clear()
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal links
        for tag, _, _ in stack[n:]:
            open_tags[tag] -= 1
            links -= tag == "a"
        del stack[n:]

    unclosed: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if links > 0:
                linked += m.start() - at
        at = m.end()
        if m["raw"]:
            # An unclosed element loses only its tag, but script and style run to the end of the page; each name is sought in vain once.
            name = m["raw"].lower()
            if name not in unclosed and not (name == "svg" and m[0].endswith("/>")):
                if end := _RAW_END[name].search(page, at):
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(name)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        inline = tag in _INLINE
        if not inline:
            flush()
        if m["end"]:
            if open_tags[tag] > 0:
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                pop_to(n)
            continue
        if tag in _VOID:
            continue
        if not inline:
            closes = _CLOSES.get(tag, ())
            if open_tags["p"] > 0 or any(open_tags[x] > 0 for x in closes):
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == "p" or stack[n][0] in closes:
                        pop_to(n)
                        break
                    if stack[n][0] in _SCOPE:
                        break
        own = {f"t:{tag}"} if not inline or tag == "a" else set()
        groups = {_TAG_GROUP[tag]} if tag in _TAG_GROUP else set()
        if m["attrs"]:
            for a in _ATTR.finditer(m["attrs"]):
                name, value = a[1].lower(), (a[2] or "").strip("\"'")
                if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    own.add("hidden")
                elif name not in ("style", "aria-hidden") and tag not in ("html", "body"):
                    for token in value.split():
                        # A name made of several words, as comments-policy, says less of what an article is than its tag does.
                        words = [token.lower()] if tag in ("article", "main") else list(map(str.lower, _PIECES.findall(token)))
                        told = next((i for i, w in enumerate(words) if w in _STATE), len(words))
                        own.update(f"c:{w}" for w in words)
                        groups.update(_GROUP[w] for w in words[:told] if w in _GROUP)
        around.append(stack[-1][1])
        names.append(tag)
        own_of.append(frozenset(own if known is None else own & known))
        groups_of.append(frozenset(groups))
        stack.append((tag, len(around) - 1, stack[-1][2] if inline else tag))
        open_tags[tag] += 1
        links += tag == "a"
    if at < len(page):
        pieces.append(page[at:])
        if links > 0:
            linked += len(page) - at
    flush()
    return _placed(runs, around, names, own_of, groups_of, known)


def _placed(runs: list, around: list[int], names: list[str], own_of: list[frozenset], groups_of: list[frozenset], known: frozenset[str] | None) -> list[Block]:
    """The blocks with what their elements say: elements come after those around them, so one pass up sums texts and one down spreads names."""
    n = len(around)
    size, articles, titled = [0] * n, [0] * n, [False] * n
    for text, at, _, _ in runs:
        size[at] += len(text)
    for i in range(n - 1, 0, -1):
        articles[i] += groups_of[i] <= {"main", "meta"} and "main" in groups_of[i]
        titled[i] |= names[i] == "h1"
        size[around[i]] += size[i]
        articles[around[i]] += articles[i]
        titled[around[i]] |= titled[i]
    above: list[frozenset[str]] = [frozenset()] * n
    near: list[str] = ["none"] * n
    inside = [False] * n
    out: dict[int, frozenset[str]] = {}
    for i in range(1, n):
        groups, up = groups_of[i], around[i]
        own_articles = groups <= {"main", "meta"} and "main" in groups
        outside = articles[0] - articles[i]
        wraps = size[i] > _WRAPS * size[0] and not outside and (articles[i] > own_articles or titled[i]) and names[i] not in _TAG_GROUP
        own = own_of[i]
        if wraps:
            groups, own = groups & {"main"}, frozenset(x for x in own if x[:2] not in ("c:", "g:"))
        else:
            marked = frozenset(f"g:{g}" for g in groups)
            own = own | (marked if known is None else marked & known)
        other = groups - {"main"}
        if near[up] == "comment" or (near[up] not in ("none", "main", "meta") and names[i] not in ("article", "main")):
            near[i] = near[up]
        elif other:
            near[i] = "comment" if "comment" in other else next(g for g in _NAMES if g in other)
        else:
            near[i] = "main" if "main" in groups else near[up]
        inside[i] = inside[up] or near[up] == "main"
        above[i] = above[up] | own if own - above[up] else above[up]
    for i in {at for _, at, _, _ in runs}:
        told = frozenset({f"n:{near[i]}", f"n:{near[i]}{'+' if inside[i] else '-'}"})
        out[i] = above[i] | (told if known is None else told & known)
    return [Block(text, out[at], tag, linked) for text, at, tag, linked in runs]


def _traits(b: Block) -> tuple[str, ...]:
    """What a block says by its own text."""
    text = b.text
    n = len(text)
    spaces = text.count(" ")
    stops, commas = text.count(". ") + (text[-1] in ".!?…\"'»”"), text.count(",")
    out = [f"w{min(8, (spaces + 1).bit_length())}", f"l{min(4, 4 * b.linked // n)}", f"e{text[-1] in '.!?…»”'}", f"s{min(3, stops)}", f"k{min(3, commas)}", f"b:{b.tag}"]
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text:
        out.append("bars")
    if n < 160 and (hit := _HINT.search(text)):
        out.append("h:" + hit[1].lower())
    return tuple(out)


def described(found: list[Block]) -> Iterator[Iterable[str]]:
    """Features of each block: its ancestors', its own, its neighbours' and its place."""
    traits = [_traits(b) for b in found]
    last = len(found) - 1
    for i, b in enumerate(found):
        out = [*b.above, *traits[i]]
        out += [f"<{x}" for x in traits[i - 1][:2]] if i else ["<none"]
        out += [f">{x}" for x in traits[i + 1][:2]] if i < last else [">none"]
        if not last:
            out.append("only")
        if i < 3:
            out.append(f"first{i}")
        if i > last - 2:
            out.append(f"last{last - i}")
        yield out


@dataclass
class Field:
    """Weights for 'main' against 'rest', and scores of label pairs (before, after) with 0 for rest and 1 for main."""

    weights: dict[str, float]
    pairs: list[list[float]]

    def labels(self, found: list[Block], among: list[bool] | None = None) -> list[int]:
        """The most probable labels, by Viterbi; with `among`, those under which at least one block for which it holds is main."""
        if not found:
            return []
        weights, known = self.weights, self.weights.__contains__
        # States are (label, whether a block of `among` has been main so far); without `among` it counts as so from the start.
        states = [(0, True), (1, True)] if among is None else [(0, False), (1, False), (0, True), (1, True)]
        score: dict[tuple[int, bool], float] = {}
        back: list[dict[tuple[int, bool], tuple[int, bool]]] = []
        for i, own in enumerate(described(found)):
            gain = sum([weights[x] for x in own if known(x)])
            counts = among is not None and among[i]
            now, came = {}, {}
            for label, met in states:
                if counts and label and not met:
                    continue
                before = states if not counts or not label else [(x, y) for x, y in states if y == met or met]
                best = None
                for x, y in before if i else []:
                    if (x, y) in score and (y == met or (met and counts and label)):
                        value = score[x, y] + self.pairs[x][label]
                        if best is None or value > best:
                            best, came[label, met] = value, (x, y)
                if not i:
                    best = 0.0 if met == (among is None or bool(counts and label)) else None
                if best is not None:
                    now[label, met] = best + gain * label
            score = now
            back.append(came)
        ends = [s for s in score if s[1]]
        if not ends:
            return [0] * len(found)
        at = max(ends, key=lambda s: (score[s], -s[0]))
        out = []
        for came in reversed(back):
            out.append(at[0])
            at = came.get(at, at)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        """The main text. A page has one unless all of its blocks stand in elements of other parts: if no block seems main, the best that don't are taken."""
        found = blocks(page, self.known | _OTHER | _BODY | _APART)
        labels = self.labels(found)
        if found and not any(labels):
            free = [not b.above & (_OTHER_TAGS | _APART) for b in found]
            if not any(free):
                free = [bool(b.above & _BODY) and not b.above & _OTHER_TAGS for b in found]
            if any(free):
                labels = self.labels(found, free)
        return " ".join(b.text for b, main in zip(found, labels, strict=True) if main)

    def __post_init__(self) -> None:
        self.known = frozenset(self.weights)


def truth(found: list[Block], main: str) -> list[int]:
    """Which blocks make up the main text, in order; the last block of a page may be cut off."""
    at, out = 0, []
    for b in found:
        hit = main.startswith(b.text, at) and (b is found[-1] or at + len(b.text) == len(main) or main[at + len(b.text)] == " ")
        at += (len(b.text) + 1) * hit
        out.append(int(hit))
    return out


def train(pages: Iterable[tuple[str, str]], rounds: int = 120, rate: float = 0.1, decay: float = 2e-4, least: int = 5) -> Field:
    """The field that maximises the penalised likelihood of (html, main text) pages, by Adam on gradients from the forward and backward sums of all of them at once."""
    seen = [(found, truth(found, main)) for page, main in pages if (found := blocks(page))]
    if not seen:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    told = [list(map(list, described(found))) for found, _ in seen]
    counts = Counter(x for page in told for own in page for x in set(own))
    names = sorted(x for x, n in counts.items() if n >= least)
    place = {x: i for i, x in enumerate(names)}
    n, depth = len(seen), max(len(found) for found, _ in seen)
    gold, held = np.zeros((n, depth), int), np.zeros((n, depth), bool)
    where, what = [], []
    for p, (page, (_, labels)) in enumerate(zip(told, seen, strict=True)):
        gold[p, : len(labels)], held[p, : len(labels)] = labels, True
        for i, own in enumerate(page):
            ids = [place[x] for x in own if x in place]
            where += [p * depth + i] * len(ids)
            what += ids
    where, what = np.array(where), np.array(what)
    size = len(names)
    theta, first, second = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    both = held[:, 1:]
    total = held.sum()
    gold_pairs = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[both], minlength=4)
    gold_units = np.bincount(what, weights=gold.ravel()[where], minlength=size)
    for t in range(1, rounds + 1):
        unit = np.zeros((n, depth, 2))
        unit[:, :, 1] = np.bincount(where, weights=theta[what], minlength=n * depth).reshape(n, depth)
        pair = theta[size:].reshape(2, 2)
        forward, backward = np.zeros((depth, n, 2)), np.zeros((depth, n, 2))
        forward[0] = unit[:, 0]
        for i in range(1, depth):
            step = np.logaddexp(forward[i - 1][:, 0, None] + pair[0], forward[i - 1][:, 1, None] + pair[1]) + unit[:, i]
            forward[i] = np.where(held[:, i, None], step, forward[i - 1])
        for i in range(depth - 2, -1, -1):
            ahead = unit[:, i + 1] + backward[i + 1]
            step = np.logaddexp(pair[:, 0] + ahead[:, 0, None], pair[:, 1] + ahead[:, 1, None])
            backward[i] = np.where(held[:, i + 1, None], step, 0)
        log_z = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - log_z).T
        joint = np.exp(forward[:-1, :, :, None] + pair + (unit.transpose(1, 0, 2)[1:] + backward[1:])[:, :, None, :] - log_z[None, :, None, None])
        slope = np.concatenate([
            np.bincount(what, weights=np.where(held, chance, 0).ravel()[where], minlength=size) - gold_units,
            joint[both.T].sum(axis=0).ravel() - gold_pairs,
        ]) / total + decay * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Field({x: float(w) for x, w in zip(names, theta, strict=False)}, theta[size:].reshape(2, 2).tolist())


def extract_main(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: DataFrame | None = None) -> DataFrame:
    """(id, url, text, n_chars) for each row of df; text is the main text, empty if there is none.

    `labelled` has columns html and main (blocks joined by one space); at most MOST_LABELLED rows of it are used, and without it
    the field is trained on generated pages. Pages are then read one by one in Python workers: nothing is
    shuffled. Null and empty pages give an empty text, null ids and urls stay null, repeated rows come back
    as often as they came (equal pages alike), very long pages are read whole, an empty table gives an empty result, and other columns are not
    looked at, whatever their names.
    """
    if labelled is None:
        pages = labelled_pages()
    else:
        pages = [tuple(r) for r in labelled.select("html", "main").where("html is not null and main is not null").orderBy(F.xxhash64("html")).limit(MOST_LABELLED).collect()]
    field = train(pages)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [field.extract(x) for x in frame[html_col]]
            yield pd.DataFrame({id_col: frame[id_col], url_col: frame[url_col], "text": texts, "n_chars": list(map(len, texts))})

    return df.select(id_col, url_col, html_col).mapInPandas(read, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
