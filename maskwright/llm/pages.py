"""Main text of web pages: boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants consistent.

A page is parsed to block-level nodes. Each node has features of its tag, the words of its class, id and role, its
depth, its siblings, and the density of text, links and marks in its subtree; what its ancestors have of these is
inherited. Trees give each node the odds of being main text. Then every node is outside (holds both kinds), main or
side: below an outside node may be any, below main ones main or side, below side ones only side. The labelling of
highest likelihood under that rule is found from the leaves up, and the text blocks of main nodes are the result.

There are no labelled pages, so the trees are fitted on pages that sample_page() makes, which don't depend on the
input.

Cases: a null or empty html has the empty text; text outside of any tag is judged as a block of the body; unclosed and
misnested tags are closed as their parents end; a head without an end tag ends at the first thing that can't be in it, an
option at the next one or as its parent ends, and a button, a list to choose from or a player, of which no end tag
follows, as its parent ends or the first block begins; comments end as in HTML (also by --!>); broken character references stay as they are; equal rows get equal
results; very long pages are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted, fitted

TRAIN_PAGES = 900
#: One in so many of them has no blocks.
PLAIN = 10
_OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_COMMENT_ENDS = re.compile(r"--!?>")
_VALUE_OR_END = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"\b(class|id|role|data-y)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title noscript template iframe object svg math textarea select button option head canvas audio video".split())
_HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
_OPEN = frozenset("option button select object canvas audio video".split())
_NESTED = frozenset("svg math template".split())
_CODE = frozenset("script style title textarea iframe noscript".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"}
_OWN_KIND = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_KINDS = ["article main", "nav menu", "header hgroup", "footer", "aside", "form fieldset search", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd", "table tr td th tbody thead tfoot", "section", "figure figcaption"]
_KIND = {t: k for k, ts in enumerate(_KINDS) for t in ts.split()}
_NAMES = [
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense outbrain taboola",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "comment comments disqus reply replies respond discussion",
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login warning toast",
    "side sidebar rail related widget recommended trending popular more share social follow tags",
    "footer foot copyright legal colophon bottom",
    "header head masthead top logo branding search toolbar",
    "content article post entry story main body text page maincontent",
]
_NAME = {w: k for k, ws in enumerate(_NAMES) for w in ws.split()}
_SIDE_KINDS, _SIDE_NAMES = (1, 2, 3, 4, 5), (0, 1, 2, 3, 4, 5, 6)
N_FEATURES = 2 * (len(_KINDS) + len(_NAMES)) + 20


class Tag:
    """A tag, or with a name of None what is none: a comment, a declaration, or character data (`data`)."""

    def __init__(self, start: int, end: int, name: str | None, ends: bool = False, attrs: str = "", data: str = ""):
        self.start, self.end, self.name, self.ends, self.attrs, self.data = start, end, name, ends, attrs, data


def tag_after(source: str, at: int, broken: list[bool]) -> Tag | None:
    """The next tag from `at` on, None if none ends. A quote hides what ends a tag only where a value begins, and no longer
    once one was found that is never closed, which `broken` remembers: so a page is read in linear time."""
    m = _OPENS.search(source, at)
    if not m:
        return None
    start, at, what = m.start(), m.end(), m[0]
    if what == "<!--":
        for short in (">", "->"):
            if source.startswith(short, at):
                return Tag(start, at + len(short), None)
        end = _COMMENT_ENDS.search(source, at)
        return Tag(start, end.end() if end else len(source), None)
    if what == "<![CDATA[" and not broken[1]:
        end = source.find("]]>", at)
        if end >= 0:
            return Tag(start, end + 3, None, data=source[at:end])
        broken[1] = True
    if m[2] is None:
        end = source.find(">", at)
        return Tag(start, end + 1, None) if end >= 0 else None
    here = at
    while not broken[0]:
        e = _VALUE_OR_END.search(source, here)
        if not e:
            break
        if e[0] == ">":
            return Tag(start, e.end(), m[2].lower(), bool(m[1]), source[at : e.start()])
        close = source.find(e[0][-1], e.end())
        if close < 0:
            break
        here = close + 1
    broken[0] = True
    end = source.find(">", at)
    return Tag(start, end + 1, m[2].lower(), bool(m[1]), source[at:end]) if end >= 0 else None


class Page:
    """Nodes in page order (parent before child) and text blocks, each with its node."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.depth, self.truth = ["body"], [-1], [frozenset()], [0], [None]
        self.blocks: list[tuple[int, str]] = []
        self.chars, self.linked, self.marks, self.sentences = [0], [0], [0], [0]
        self._read(source)

    def _node(self, tag: str, attrs: str, parent: int) -> int:
        names, truth = frozenset(), None
        if attrs and "=" in attrs:
            words = set()
            for m in _ATTR.finditer(attrs):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "data-y":
                    truth = {"1": 1, "0": 0}.get(value)
                elif m[1].lower() in ("class", "id", "role"):
                    words.update(_WORD.findall(value))
            names = frozenset(_NAME[w] for w in words if w in _NAME)
        self.tag.append(tag), self.parent.append(parent), self.names.append(names), self.depth.append(self.depth[parent] + 1), self.truth.append(truth)
        for counts in (self.chars, self.linked, self.marks, self.sentences):
            counts.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]
        pieces: list[str] = []
        at, links, drop = 0, 0, ""
        inner: list[str] = []  # what is open in what is dropped
        low, ends = "", {}  # the source in lower case, and where an element's last end tag is, once asked for
        unclosed = False

        def text(s: str) -> None:
            nonlocal drop
            if drop == "head" and s.strip():
                drop = ""
            if s and not drop:
                pieces.append(entities.unescape(s) if "&" in s else s)
                if links:
                    self.linked[stack[-1][1]] += len(s)

        def flush() -> None:
            nonlocal pieces
            if pieces:
                got = " ".join("".join(pieces).split())
                if got:
                    node = stack[-1][1]
                    self.blocks.append((node, got))
                    self.chars[node] += len(got)
                    self.sentences[node] += got.count(". ") + got.count(", ") + (got[-1] in ".!?:")
                pieces = []

        length = len(source)
        broken, within = [False, False], 0
        while at < length:
            m = tag_after(source, at, broken)
            if not m:
                break
            text(source[at : m.start])
            at = m.end
            name = m.name
            if name is None:
                if m.data:
                    text(m.data)
                continue
            if not m.ends:
                # the end tags of head and option may be left out
                if drop == "head" and (name not in _HEAD or name == "template") or drop == "option" and name == "optgroup" and not inner or unclosed and drop and name in _BLOCK:
                    drop = ""
                if name in _CODE:
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = close.end() if close else length
                    continue
                if drop:
                    within += drop in _NESTED and name == drop and not m.attrs.endswith("/")
                    if drop in ("option", "button") and name == drop:
                        inner.clear()
                    elif drop in _OPEN and name not in _VOID and not m.attrs.endswith("/"):
                        inner.append(name)
                    continue
                if name in _RAW and not m.attrs.endswith("/"):
                    drop, within = name, 1
                    inner.clear()
                    if name in _OPEN and name != "option":
                        if name not in ends:
                            low = low or source.lower()
                            ends[name] = low.rfind(f"</{name}")
                        unclosed = ends[name] < at
                    else:
                        unclosed = False
                    continue
                self.marks[stack[-1][1]] += 1
                if name == "a":
                    links += 1
                elif name == "br" or name == "wbr":
                    pieces.append(" " if name == "br" else "")
                if name in _VOID and name != "hr":
                    continue
                if name in _BLOCK:
                    flush()
                    links = links if name == "a" else 0 if not any(t == "a" for t, _ in stack) else links
                    if name in ("html", "body", "hr"):
                        if name == "body" and m.attrs:
                            pass
                        continue
                    if name in _ENDS_P:
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] == "p":
                                del stack[k:]
                                break
                            if stack[k][0] in ("td", "th", "table", "button"):
                                break
                    if name in _OWN_KIND:
                        same, border = _OWN_KIND[name]
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] in border:
                                break
                            if stack[k][0] in same and (name != "tr" or stack[k][0] == "tr"):
                                del stack[k:]
                                break
                    stack.append((name, self._node(name, m.attrs, stack[-1][1])))
                continue
            if drop in _OPEN and name in inner:
                del inner[len(inner) - 1 - inner[::-1].index(name) :]
                continue
            if drop == "option" and name not in ("option", "body", "html") or drop in _OPEN and name != drop and any(t == name for t, _ in stack[1:]):
                drop = ""  # its parent ends
            if drop:
                within -= name == drop
                if name == drop and (within <= 0 or drop not in _NESTED) or name in ("body", "html"):
                    drop = ""
            elif name == "a":
                links = max(0, links - 1)
            elif name in _BLOCK:
                if name in ("html", "body"):
                    flush()
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        flush()
                        del stack[k:]
                        links = 0
                        break
                    if name not in ("table", "article", "main", "section", "div", "body", "nav", "aside", "header", "footer", "form") and stack[k][0] in ("table", "td", "article", "main"):
                        break
        text(source[at:])
        flush()

    def features(self) -> list[list[float]]:
        n = len(self.tag)
        chars, linked, marks, sentences = self.chars[:], self.linked[:], self.marks[:], self.sentences[:]
        paras, below, kids, last = [int(t == "p") for t in self.tag], [1] * n, [0] * n, [0] * n
        order = [0] * n
        parent = self.parent
        for i in range(1, n):
            p = parent[i]
            order[i] = kids[p]
            kids[p] += 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            sentences[p] += sentences[i]
            paras[p] += paras[i]
            below[p] += below[i]
        before, seen = [0] * n, 0
        for i in range(n):
            before[i] = seen
            seen += self.chars[i]
        total = max(1, chars[0])
        nk, nn = len(_KINDS), len(_NAMES)
        out, log = [], math.log1p
        for i in range(n):
            p = parent[i]
            row = [0.0] * N_FEATURES
            k = _KIND.get(self.tag[i])
            if k is not None:
                row[k] = 1.0
            for w in self.names[i]:
                row[nk + w] = 1.0
            if p >= 0:
                up = out[p]
                for j in range(nk + nn):
                    row[nk + nn + j] = up[j] or up[nk + nn + j]
            c = chars[i]
            pc, sib = (chars[p], kids[p]) if p >= 0 else (total, 1)
            row[2 * (nk + nn) :] = [
                log(c), log(self.chars[i]), linked[i] / (c + 1), marks[i] * 10 / (c + 10), c / below[i], sentences[i] * 50 / (c + 50), log(sentences[i]), log(paras[i]),
                c / total, c / (pc + 1), self.depth[i], order[i], sib, order[i] / sib, kids[i], before[i] / total, linked[p] / (pc + 1) if p >= 0 else 0.0,
                paras[p] if p >= 0 else 0, log(pc), log(below[i]),
            ]
            out.append(row)
        return out

    def main_nodes(self, odds) -> list[bool]:
        """Whether each node is main, by the likeliest consistent labelling given the log-odds of each being main."""
        n = len(self.tag)
        main, side, outside = [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(n):
            z = float(odds[i])
            yes = -math.log1p(math.exp(-z)) if z > -30 else z
            main[i], side[i] = yes, yes - z
            outside[i] = -0.8 + (side[i] if self.chars[i] else 0.0)
        outside[0] = 0.0 if not self.chars[0] else outside[0] + 0.8
        best_main, best_any = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            p = self.parent[i]
            best_main[i] = max(main[i], side[i])
            best_any[i] = max(main[i], side[i], outside[i])
            if p >= 0:
                main[p] += best_main[i]
                outside[p] += best_any[i]
                side[p] += side[i]
        label = [""] * n
        for i in range(n):
            up = label[self.parent[i]] if i else "o"
            if up == "s":
                label[i] = "s"
            elif up == "m":
                label[i] = "m" if main[i] >= side[i] else "s"
            else:
                label[i] = "m" if main[i] >= best_any[i] else "s" if side[i] >= best_any[i] else "o"
        return [x == "m" for x in label]


def sample_page(rng: random.Random) -> str:
    """A made-up page; data-y tells of its nodes whether they are main text."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + rng.choice(["", "", ", " + words(2, 6)]) + rng.choice("....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def named(tags: str, names: str, y: int, inner: str, bare: float = 0.35) -> str:
        attrs = "" if rng.random() < bare else f' {rng.choice(["class", "id", "class"])}="{rng.choice(names.split())}{rng.choice(["", "", "-" + word(), " " + word()])}"'
        tag = rng.choice(tags.split())
        return f'<{tag}{attrs} data-y="{y}">{inner}</{tag}>'

    items = lambda n, y: f'<ul data-y="{y}">' + "".join(f'<li data-y="{y}">{link()}</li>' for _ in range(n)) + "</ul>"
    nav = lambda: named("nav nav div", "nav menu navbar breadcrumb", 0, items(rng.randint(3, 9), 0) if rng.random() < 0.8 else " | ".join(link() for _ in range(5)), 0.4)
    ad = lambda: named("div div aside section", "ad ads advert sponsored promo banner", 0, rng.choice([sentence(), prose(1, 3), f'<p data-y="0">{prose(1, 2)}</p>', link() + " " + words(3, 9)]), 0.0)
    header = lambda: named("header header div", "header masthead top", 0, rng.choice([words(1, 4), f'<h2 data-y="0">{words(1, 4)}</h2>']) + rng.choice(["", f'<p data-y="0">{words(3, 8)}</p>']), 0.2)
    footer = lambda: named("footer footer div", "footer legal copyright", 0, rng.choice(["&copy; " + words(1, 3), "&copy; " + words(1, 3) + " &middot; " + prose(1, 2), f'<p data-y="0">{prose(1, 2)}</p>' + items(4, 0)]), 0.2)
    notice = lambda: named("div section aside", "cookie consent notice newsletter alert popup", 0, f'<p data-y="0">{prose(1, 3)}</p>' + rng.choice(["", "<button>ok</button>"]), 0.0)
    aside = lambda: named("aside aside div", "sidebar related widget side recommended", 0, f'<h3 data-y="0">{words(1, 3)}</h3>' + rng.choice([items(5, 0), f'<p data-y="0">{prose(1, 3)}</p>']), 0.1)
    form = lambda: f'<form data-y="0"><p data-y="0">{words(2, 6)}</p><input name="x"></form>'
    comments = lambda: named("section div", "comments comment discussion replies", 0, f'<h3 data-y="0">{words(1, 2)}</h3>' + "".join(named("div li article", "comment reply", 0, f'<p data-y="0">{prose(1, 3)}</p>', 0.3) for _ in range(rng.randint(1, 5))), 0.0)

    stub = rng.random() < 0.25

    def para() -> str:
        body = rng.choice([words(1, 6), sentence(1, 6), sentence(2, 12)]) if stub else prose(1, 7)
        if rng.random() < 0.2:
            body += " " + link() + " " + sentence()
        if rng.random() < 0.15:
            body = f"<b>{words(2, 6)}</b><br>" + body
        return f'<p data-y="1">{body}' + rng.choice(["</p>", "</p>", "</p>", ""])

    def table() -> str:
        cell = lambda t: f'<{t} data-y="1">{rng.choice([words(1, 4), str(rng.randint(0, 9999)), sentence(2, 8), link() if rng.random() < 0.2 else word()])}</{t}>'
        cols = rng.randint(2, 5)
        rows = [f'<tr data-y="1">{"".join(cell("th" if k == 0 and rng.random() < 0.8 else "td") for _ in range(cols))}</tr>' for k in range(rng.randint(1, 7))]
        caption = f'<caption data-y="1">{words(2, 7)}</caption>' if rng.random() < 0.3 else ""
        inner = caption + (f'<thead data-y="1">{rows[0]}</thead><tbody data-y="1">{"".join(rows[1:])}</tbody>' if rng.random() < 0.4 else "".join(rows))
        return f'<table data-y="1">{inner}</table>'

    def odd() -> str:
        """What articles hold beside paragraphs, headings, lists and tables."""
        terms = "".join(f'<dt data-y="1">{words(1, 3)}</dt><dd data-y="1">{sentence()}</dd>' for _ in range(rng.randint(1, 4)))
        steps = "".join(f'<li data-y="1">{sentence(1, 9)}</li>' for _ in range(rng.randint(1, 5)))
        return rng.choice([f'<dl data-y="1">{terms}</dl>', f'<ol data-y="1">{steps}</ol>', f'<pre data-y="1">{words(2, 12)}</pre>', f'<figure data-y="1"><img src="x.png"><figcaption data-y="1">{sentence()}</figcaption></figure>'])

    def main() -> str:
        parts = [f'<h1 data-y="1">{words(2, 12)}</h1>'] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 1, 2] if stub else [1, 1, 2, 3, 5, 8, 12])):
            x = rng.random()
            parts.append(table() if x < 0.07 else odd() if x < 0.13 else para() if x < 0.78 else f'<h2 data-y="1">{words(2, 6)}</h2>' + para() if x < 0.86 else '<ul data-y="1">' + "".join(f'<li data-y="1">{sentence()}</li>' for _ in range(rng.randint(2, 5))) + "</ul>" if x < 0.92 else f'<blockquote data-y="1">{prose(1, 3)}</blockquote>' if x < 0.95 else f'<div data-y="1">{prose(1, 4)}</div>')
        for extra in (ad, aside, notice, form):
            if rng.random() < 0.08:
                parts.insert(rng.randint(0, len(parts)), extra())
        if rng.random() < 0.06:
            parts.append(comments())
        if rng.random() < 0.08:
            parts.insert(0, f'<header data-y="1"><p data-y="1">{sentence()}</p></header>')
        inner = "".join(parts)
        if rng.random() < 0.25:
            inner = f'<div data-y="1">{inner}</div>'
        x = rng.random()
        return f'<article data-y="1">{inner}</article>' if x < 0.5 else f'<main data-y="1">{inner}</main>' if x < 0.62 else f'<main><article data-y="1">{inner}</article></main>' if x < 0.72 else named("div section", "content article post entry story main text", 1, inner, 0.15)

    top = [f() for f, p in ((header, 0.4), (nav, 0.75), (notice, 0.2), (ad, 0.5), (form, 0.1)) if rng.random() < p]
    rng.shuffle(top)
    end = [f() for f, p in ((aside, 0.35), (comments, 0.25), (ad, 0.25), (nav, 0.1), (notice, 0.1), (form, 0.1)) if rng.random() < p]
    rng.shuffle(end)
    middle = [main(), *end]
    if rng.random() < 0.15:
        middle = [aside(), *middle]
    wrap = rng.random() < 0.4
    return "".join(top) + ("<div>" if wrap else "") + "".join(middle) + ("</div>" if wrap else "") + (footer() if rng.random() < 0.8 else "")


def plain_page(rng: random.Random) -> str:
    """A made-up page of text without blocks, all of it main."""
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9))) for _ in range(n))
    lines = [words(rng.randint(1, 14)).capitalize() + rng.choice(["", ".", ".", "!", ", and so on."]) for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 16, 30]))]
    return rng.choice(["\n", " ", "<br>", "<br>\n"]).join(f"<b>{x}</b>" if rng.random() < 0.05 else x for x in lines)


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> Boosted:
    rng = random.Random(seed)
    x: list[list[float]] = []
    y: list[int] = []
    for k in range(pages):
        plain = k % PLAIN == 0
        page = Page(plain_page(rng) if plain else sample_page(rng))
        page.truth[0] = int(plain)
        for row, truth in zip(page.features(), page.truth, strict=True):
            if truth is not None:
                x.append(row)
                y.append(truth)
    return fitted(np.array(x), np.array(y, dtype=float))


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    odds = model.raw(np.array([r for p in pages for r in p.features()]))
    out, at = [], 0
    for p in pages:
        keep = p.main_nodes(odds[at : at + len(p.tag)])
        at += len(p.tag)
        out.append("\n\n".join(t for node, t in p.blocks if keep[node]))
    return out


def extracted(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                got = main_texts([h or "" for h in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
