"""Labelled pages for the HTML extractor: varied layouts in invented prose, with the main text of each."""

from __future__ import annotations

import html
import random

#: Fixed names that sites give to parts of a page, by part: (tags, classes or ids).
PARTS = {
    "header": (["header", "div", "div"], ["header", "site-header", "masthead", "top-bar", "branding", "page-header"]),
    "nav": (["nav", "div", "ul", "div"], ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "topnav", "navigation", "pagination"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "page-footer", "copyright", "colophon", "foot"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "right-rail", "more-stories", "trending", "popular"]),
    "ad": (["div", "aside", "ins", "section"], ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "advertisement", "adsbox"]),
    "notice": (["div", "section", "aside"], ["cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"]),
    "form": (["form", "form", "div"], ["search", "login", "signup", "contact-form", "subscribe-form", "form"]),
    "comments": (["section", "div", "ol", "div"], ["comments", "comment-list", "replies", "disqus", "discussion", "responses", "comments-area"]),
    "share": (["div", "ul"], ["share", "social", "tags", "meta", "byline", "post-meta", "toolbar"]),
    "main": (["article", "main", "div", "section", "div", "article"], ["content", "post", "article-body", "entry-content", "story", "main-content", "post-body", "text", "article"]),
}
#: Names of wrappers and of pages that tell of their layout or state, not of what stands in them.
WRAPPERS = "content-with-sidebar has-sidebar no-sidebar layout-sidebar-left page-wrapper site-container with-banner no-ads menu-open page-with-comments header-fixed main-wrap outer search-hidden row".split()
STATES = "no-banner page-popup-open has-sidebar js menu-closed cookie-bar-shown single-post post-template logged-in home search-open".split()
_SIGNS = ["&amp;", "&quot;", "&eacute;", "&#8217;", "&lt;", "&ndash;", "&nbsp;"]
_LETTERS = ["aeioutrnslhd", "eéèauoirntls", "eäöünrstchg", "aeoñíósrdlc", "оеаинтсрвл"]


class Writer:
    """One random page: write() gives its HTML and the texts of its main blocks in order."""

    def __init__(self, seed: int) -> None:
        self.r, self.s = random.Random(seed), random.Random(seed + 1)  # the second for what stands around
        self.letters, self.main = self.r.choice(_LETTERS), []
        self.plain = self.r.random() < 0.15  # classes that say nothing
        self.loose = self.r.random() < 0.4  # end tags left out
        self.style = self.r.choice(["", "", "", "", "", "bars", "loud", "noise"])  # junk is main text too

    def word(self) -> str:
        w = "".join(self.r.choices(self.letters, k=self.r.randint(1, 9)))
        return w.capitalize() if self.r.random() < 0.06 else w

    def prose(self, least: int, most: int) -> str:
        out = []
        while len(out) < least or (len(out) < most and self.r.random() < 0.93):
            w = self.word()
            if self.r.random() < 0.02:
                w += self.r.choice(_SIGNS)
            out.append(w + ("," if self.r.random() < 0.08 else "." if self.r.random() < 0.1 else ""))
        if self.style == "bars":
            return " | ".join(out)
        if self.style == "loud":
            return "!! ".join(out).upper().replace("&NBSP;", "&nbsp;")
        if self.style == "noise":
            return " ".join(w + self.r.choice(["***", "%%%", "$$$", "###"]) for w in out)
        return " ".join(out).capitalize().rstrip(",.") + "."

    def phrase(self, most: int = 5) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, most)))

    def dress(self, text: str) -> str:
        """Inline markup around some of the words."""
        words = text.split(" ")
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            i = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", "a", "span", "code"])
            words[i] = f'<{tag} href="/{i}">{words[i]}</a>' if tag == "a" else f"<{tag}>{words[i]}</{tag}>"
        return " ".join(words)

    def own(self, text: str) -> str:
        """Marks a text as main and returns it dressed."""
        self.main.append(" ".join(html.unescape(text).split()))
        return self.dress(text)

    def wrap(self, part: str, inner: str) -> str:
        tags, names = PARTS[part]
        tag = self.r.choice(tags)
        name = self.r.choice(names)
        bare = tag in ("header", "nav", "footer", "aside", "form", "article", "main") and self.r.random() < 0.4
        if self.plain and part not in ("comments", "ad", "notice") and tag in ("header", "nav", "footer", "aside", "form", "article", "main"):
            name = self.r.choice(["c1", "col-8", "row", "box", "x", "wrap"])
        attr = "" if bare else self.r.choice([' class="{}"', ' id="{}"', " class='w {}'", ' class="{} box" data-n="1"', ' class="{}" role="region"']).format(name)
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self) -> str:
        n = self.r.randint(2, 9)
        items = [f'<a href="/{k}">{self.phrase(3)}</a>' for k in range(n)]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}" + ("" if self.loose else "</li>") for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), " ".join(items)])

    def part(self, part: str) -> str:
        r = self.r
        few = lambda a, b: "".join(f"<p>{self.prose(a, b)}</p>" for _ in range(r.randint(1, 2)))
        made = {
            "header": lambda: r.choice([f"<h1>{self.phrase()}</h1><p>{self.phrase()}</p>", f'<a href="/">{self.phrase(2)}</a>' + self.links(), f"<div>{self.prose(3, 12)}</div>"]),
            "nav": self.links,
            "footer": lambda: r.choice(["&copy; 2024 " + self.phrase(), f"<p>&copy; {self.phrase()} &middot; {self.prose(3, 20)}</p>", self.links() + f"<p>{self.prose(3, 20)}</p>"]),
            "sidebar": lambda: r.choice([f"<h3>{self.phrase()}</h3>" + self.links(), f"<h2>{self.phrase()}</h2>" + few(5, 30), few(4, 40)]),
            "ad": lambda: r.choice([self.prose(3, 15), few(3, 30), f'<a href="/buy">{self.phrase()}</a>', f"<p>{self.prose(3, 12)}</p><a href='/x'>{self.phrase(3)}</a>"]),
            "notice": lambda: r.choice([few(5, 40), f"<p>{self.prose(5, 30)}</p><button>{self.phrase(2)}</button>", self.prose(4, 20)]),
            "form": lambda: f'<label>{self.phrase(3)}</label><input name="q"><p>{self.phrase()}</p><select><option>{self.word()}<option>{self.word()}</select><button>{self.phrase(2)}</button>',
            "comments": lambda: f"<h3>{self.phrase(3)}</h3>" + "".join(r.choice(["<div class='comment'><b>{}</b> <p>{}</p></div>", "<article class='comment'><p>{}</p><p>{}</p></article>", "<li><p>{}</p><p>{}</p></li>", "<p>{}: {}</p>"]).format(self.phrase(2), self.prose(3, 60)) for _ in range(r.randint(1, 5))),
            "share": lambda: r.choice([self.links(), f"<span>{self.phrase()}</span>", f"<p>{self.phrase(4)} 2024-01-02</p>"]),
        }[part]()
        return self.wrap(part, made)

    def body(self) -> list[str]:
        """Main blocks, one string each."""
        r, out = self.r, []
        if r.random() < 0.9:
            tag = r.choice(["h1", "h1", "h2"])
            title = f"<{tag}>{self.own(self.prose(3, 14)[: r.choice([30, 60, 200])].rsplit('&', 1)[0])}</{tag}>"
            out.append(title if self.s.random() < 0.85 else f"<header{self.s.choice(['', ' class=entry-header'])}>{title}</header>")
        end = lambda tag: "" if self.loose else f"</{tag}>"
        as_div = r.random() < 0.15
        for _ in range(r.choice([0, 1, *range(1, 12)]) if out else r.randint(1, 12)):
            kind = r.random()
            if kind < 0.62:
                tag = "div" if as_div else "p"
                out.append(f"<{tag}>{self.own(self.prose(1, r.choice([4, 20, 60, 150])))}" + (end("p") if tag == "p" else "</div>"))
            elif kind < 0.72:
                out.append(f"<h{(n := r.randint(2, 4))}>{self.own(self.phrase())}</h{n}>")
            elif kind < 0.80:
                out.append(f"<p><b>{self.own(self.prose(1, 8))}<br>" if self.loose else f"<p>{self.own(self.prose(3, 40))}<br>{self.own(self.prose(3, 40))}</p>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.own(self.prose(1, 25))}" + end("li") for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{self.own(self.prose(4, 40))}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.own(self.phrase(3))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.97:
                out.append(f'<figure><img src="a.png" alt="{self.word()}"><figcaption>{self.own(self.prose(2, 12))}</figcaption></figure>')
            else:
                out.append(f"<pre>{self.own(self.prose(2, 20))}</pre>")
        return out

    def write(self) -> tuple[str, str]:
        r = self.r
        alone = r.random() < 0.1  # an article and nothing else
        some = lambda parts, p: [self.part(x) for x in parts if not alone and r.random() < p]
        before = some(["notice"], 0.25) + some(["header"], 0.5) + some(["nav"], 0.7) + some(["form", "nav"], 0.15) + some(["ad"], 0.4) + some(["sidebar"], 0.15)
        blocks = self.body()
        for extra, p in (("ad", 0.2), ("share", 0.25), ("notice", 0.1), ("sidebar", 0.1), ("form", 0.06), ("nav", 0.05)):
            if not alone and r.random() < p:
                at = r.randint(0, len(blocks))
                opened = at and blocks[at - 1].startswith("<p") and not blocks[at - 1].endswith("</p>")
                blocks.insert(at, ("</p>" if opened else "") + self.part(extra))
        if not alone and r.random() < 0.12:
            blocks.append(self.part("comments"))
        if not alone and self.s.random() < 0.15:  # a hidden part, which no reader sees
            mark = self.s.choice(["hidden", "style='display:none'", "style='visibility: hidden'", "aria-hidden='true'"])
            blocks.append(self.s.choice(["<p {}>{}</p>", "<div {}><p>{}</p></div>"]).format(mark, self.prose(3, 40)))
        inside = "".join(f"{x}\n" if r.random() < 0.3 else x for x in blocks)
        layout = r.random()
        core = inside if layout < 0.04 else self.wrap("main", inside) if layout < 0.8 else f'<div class="container"><div id="wrapper">{self.wrap("main", inside)}</div></div>'
        wrapper, state = self.s.random(), self.s.random()
        if wrapper < 0.15:  # the article stands in a wrapper alone
            core = f"<div class='{self.s.choice(WRAPPERS)}'>{inside if wrapper < 0.05 else core}</div>"
        opened, closed = ("", "") if self.s.random() < 0.75 else (f"<div class='{' '.join(self.s.sample(WRAPPERS, 2))}'>", "</div>")
        body = "<body>" if state < 0.6 else f"<body class='{' '.join(self.s.sample(STATES, 3))}'>"
        after = some(["share"], 0.15) + some(["comments"], 0.3) + some(["sidebar"], 0.4) + some(["form"], 0.15) + some(["ad", "notice"], 0.15) + some(["footer"], 0.8)
        page = f"<!DOCTYPE html><html><head><title>{self.phrase()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>{body}{opened}" + "".join(before) + ("<!-- main -->" if r.random() < 0.3 else "") + core + "".join(after) + closed
        if r.random() < 0.12:  # cut off somewhere
            return page[: r.randint(len(page) // 3, len(page))].rpartition(" ")[0], " ".join(self.main)
        return page + ("" if r.random() < 0.1 else "</body></html>"), " ".join(self.main)


def labelled_pages(n: int = 800, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) of n pages; the same ones for the same seed."""
    return [Writer(seed * 1_000_003 + k).write() for k in range(n)]
