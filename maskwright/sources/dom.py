"""Scanning HTML pages: interactive elements, text blocks and rasters, as nested snapshots.

There is no layout engine: boxes are null, and what is visible follows from `hidden`, `type=hidden`, and inline display,
visibility and opacity. Ids are dense in page order: elements, then rasters, then texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed as X
from ..functions import scalars as S
from ..operators import detect as D

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INTERACTIVE = frozenset("input textarea select button summary".split())
NO_TEXT = frozenset("script style noscript template textarea select svg".split())
NOT_LABEL_TEXT = frozenset("select textarea script style".split())
NEVER_VALUE = frozenset("label legend button a h1 h2 h3 h4 h5 h6 th".split())
RASTERS = frozenset("img canvas video iframe embed object svg".split())
ARIA_ROLES = ["button", "link", "checkbox", "radio", "textbox", "combobox"]
BUTTON_TYPES = ["submit", "button", "reset", "image", "file"]
OTHER_TYPES = ["range", "color"]
CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "section", "form", "h1", "h2", "h3", "dl", "article"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
WHITE = re.compile(r"\s+")
SILENT, UNASKED, DRAWN = 1, 2, 4
# What html.parser would read the same in more steps: tags without attributes, of elements whose content is read as ever.
PLAIN_START, PLAIN_END = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)>"), re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
NOT_PLAIN = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
WITHIN = {SILENT: NO_TEXT | {"head", "title"}, UNASKED: NEVER_VALUE, DRAWN: frozenset({"svg"})}


BITS = {tag: sum(bit for bit, tags in WITHIN.items() if tag in tags) for tag in frozenset().union(*WITHIN.values())}


class Node:
    """An element. prev is the element before it under the same parent; hidden, and what `within` holds of the tag sets
    below, are those of its ancestors too, worked out as the page is read from its start."""

    __slots__ = ("tag", "attrs", "parent", "children", "order", "prev", "last", "hidden", "within", "interactive", "_short")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.children, self.order = tag, attrs, parent, [], order
        self.prev, self.last = (parent.last if parent else None), None
        self.hidden = (parent.hidden if parent else False) or bool(attrs) and _hides(attrs)
        self.within = (parent.within if parent else 0) | BITS.get(tag, 0)
        self._short: str | None = None
        self.interactive = False  # whether it or anything in it is, known once the page is read
        if parent:
            parent.last = self

    def up(self) -> Iterator[Node]:
        n: Node | None = self
        while n is not None:
            yield n
            n = n.parent

    def walk(self) -> Iterator[Node]:
        left = [self]
        while left:
            n = left.pop()
            yield n
            left += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        left: list[Node | str] = [self]
        while left:
            n = left.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in NOT_LABEL_TEXT:
                left += reversed(n.children)


def _hides(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or re.search(r"opacity:0(?![.\d])", style) is not None


class Tree(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None, 0)
        self.n = 0
        self.feed(source)
        self.close()

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None or (tag := plain[1].lower()) in NOT_PLAIN:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [])
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _open(self, tag, attrs):
        if self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        self.n += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.n)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        for n in self.at.up():
            if n.tag == tag:
                self.at = n.parent or self.root
                return

    def handle_data(self, data):
        self.at.children.append(data)


def shown_text(node: Node | None, most: int = 120) -> str:
    """The first `most` characters of the text in a node; no more of it is read than they need."""
    if node is None:
        return ""
    if len(node.children) == 1 and isinstance(node.children[0], str):
        return "" if node.tag in NOT_LABEL_TEXT else WHITE.sub(" ", node.children[0]).strip()[:most]
    parts, n = [], 0
    for part in node.strings():
        parts.append(part)
        n += len(WHITE.sub("", part))
        if n > most:
            break
    return WHITE.sub(" ", "".join(parts)).strip()[:most]


def short_text(node: Node | None) -> str:
    if node is None:
        return ""
    if node._short is None:
        text = shown_text(node, 80)
        node._short = text if len(text) <= 60 else ""
    return node._short


def is_visible(node: Node) -> bool:
    return not node.hidden and not (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


def is_interactive(n: Node) -> bool:
    if not n.attrs:
        return n.tag in INTERACTIVE
    return n.tag in INTERACTIVE or n.tag == "a" and "href" in n.attrs or n.attrs.get("role") in ARIA_ROLES or n.attrs.get("contenteditable", "false").lower() in ("", "true")


def role_of(n: Node) -> str:
    kind = n.attrs.get("type", "text").lower()
    if n.attrs.get("role") in ARIA_ROLES:
        return n.attrs["role"]
    if n.tag == "input":
        if kind in ("password", "checkbox", "radio"):
            return kind
        return "button" if kind in BUTTON_TYPES else "other" if kind in OTHER_TYPES else "textbox"
    fixed = {"textarea": "textbox", "select": "combobox", "button": "button", "summary": "button", "a": "link"}
    return fixed.get(n.tag) or ("textbox" if "contenteditable" in n.attrs else "other")


def label_of(n: Node, role: str, by_id: dict[str, Node], labels: dict[str, list[Node]]) -> str:
    a = n.attrs
    told = " ".join(shown_text(by_id.get(i)) for i in a.get("aria-labelledby", "").split()).strip()
    if told:
        return told
    if a.get("aria-label", "").strip():
        return a["aria-label"].strip()
    if role in ("button", "link"):
        image = next((c for c in n.walk() if c.tag == "img"), None)
        return (shown_text(n) or a.get("value", "") or a.get("title", "") or (image.attrs.get("alt", "") if image else "")).strip()[:120]
    own = [*labels.get(a.get("id", "\0"), []), *[p for p in n.up() if p.tag == "label"]]
    told = " ".join(shown_text(x) for x in own).strip()
    return told or nearby_label(n) or a.get("placeholder") or a.get("title") or a.get("name") or ""


def nearby_label(n: Node) -> str:
    """Short text of the element before, or of the one before the parent."""
    for at in (n, n.parent):
        if at is not None and (text := short_text(at.prev)):
            return text
    return ""


def value_of(n: Node, role: str) -> tuple[str, bool]:
    """(value, whether there is one); a password's value is never read."""
    raw = n.attrs.get("value", "")
    if n.tag == "input":
        if role == "password":
            return "", bool(raw)
        return ("", False) if role in ("checkbox", "radio", "button") else (raw, bool(raw))
    if n.tag == "textarea":
        raw = "".join(c for c in n.children if isinstance(c, str))
        return raw[:500], bool(raw)
    if n.tag == "select":
        options = [c for c in n.walk() if c.tag == "option"]
        chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
        text = WHITE.sub(" ", "".join(c for c in chosen.children if isinstance(c, str))).strip() if chosen else ""
        return text, bool(text)
    if "contenteditable" in n.attrs:
        text = "".join(n.strings())[:500]
        return text, bool(text.strip())
    return "", False


def _size(v: str | None) -> float | None:
    m = re.match(r"\s*(\d+(?:\.\d+)?)", v or "")
    return float(m[1]) if m else None


def scan(source: str) -> dict:
    """title, elements, texts and rasters of a page; texts have `prev_label`, the label before them, null where the text
    can't be a value."""
    root = Tree(source or "").root
    nodes = list(root.walk())
    for n in reversed(nodes):
        n.interactive = n.interactive or is_interactive(n)
        if n.parent is not None and n.interactive:
            n.parent.interactive = True
    by_id = {n.attrs["id"]: n for n in reversed(nodes) if n.attrs.get("id")}
    labels: dict[str, list[Node]] = {}
    for n in nodes:
        if n.tag == "label" and n.attrs.get("for"):
            labels.setdefault(n.attrs["for"], []).append(n)
    elements, rasters, texts = [], [], []
    for n in nodes:
        if is_interactive(n) and is_visible(n):
            role = role_of(n)
            value, has = value_of(n, role)
            elements.append({
                "vid": 0, "role": role, "tag": n.tag, "type": n.attrs.get("type", "text" if n.tag == "input" else "").lower(), "label": label_of(n, role, by_id, labels), "value": value, "hasValue": has,
                "placeholder": n.attrs.get("placeholder", ""), "name": n.attrs.get("name", ""), "idAttr": n.attrs.get("id", ""), "autocomplete": n.attrs.get("autocomplete", ""), "required": "required" in n.attrs,
                "disabled": "disabled" in n.attrs, "checked": "checked" in n.attrs if role in ("checkbox", "radio") else None,
                "options": [WHITE.sub(" ", "".join(c for c in o.children if isinstance(c, str))).strip() for o in n.walk() if o.tag == "option"] if n.tag == "select" else None, "bbox": None, "valueBox": None,
            })
    for n in nodes:
        if n.tag in RASTERS and not (n.tag == "svg" and n.parent and n.parent.within & DRAWN) and is_visible(n):
            least = 96 if n.tag == "svg" else 48
            w, h = _size(n.attrs.get("width")), _size(n.attrs.get("height"))
            if all(x is None or x >= least for x in (w, h)):
                alt = n.attrs.get("alt") or n.attrs.get("aria-label") or n.attrs.get("title") or ""
                rasters.append({"vid": 0, "kind": n.tag, "alt": alt, "bbox": [0.0, 0.0, w, h] if w is not None and h is not None else None, "src": n.attrs.get("src") if n.tag == "iframe" else None, "inner": None})
    for n in nodes:
        own = [c for c in n.children if isinstance(c, str) and c.strip()]
        if own and n.parent is not None and not n.within & SILENT and is_visible(n):
            text = "".join(own)
            as_label = lambda e: short_text(e) if e is not None and not e.interactive else ""
            label = None
            if len(text.strip()) <= 120 and not n.within & UNASKED:
                label = as_label(n.prev) or as_label(n.parent.prev)
                label = label if label and len(label) <= 40 else None
            texts.append({"vid": 0, "text": text, "bbox": None, "prev_label": label})
            if len(texts) >= X.MAX_BLOCKS:
                break
    for vid, x in enumerate([*elements, *rasters, *texts], start=1):
        x["vid"] = vid
    title = next((WHITE.sub(" ", "".join(c for c in n.children if isinstance(c, str))).strip() for n in nodes if n.tag == "title"), "")
    return {"title": title, "elements": elements, "texts": texts, "rasters": rasters}


ELEMENTS = "array<struct<vid:int,role:string,tag:string,type:string,label:string,value:string,hasValue:boolean,placeholder:string,name:string,idAttr:string,autocomplete:string,required:boolean,disabled:boolean,checked:boolean,options:array<string>,bbox:array<double>,valueBox:array<double>>>"
SCANNED = f"title string, elements {ELEMENTS}, texts array<struct<vid:int,text:string,bbox:array<double>,prev_label:string>>, rasters array<struct<vid:int,kind:string,alt:string,bbox:array<double>,src:string,inner:array<double>>>"


SLICE = 128


def scan_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the snapshot of each page, with the spans of its texts: worked out once for texts of a page that are alike
    and stand after the same label."""
    schema = SCANNED.replace("prev_label:string>>", "of:int>>") + ", alike array<struct<text:string,prev_label:string>>"
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema)]

    def told(page: dict) -> dict:
        alike: dict[tuple, int] = {}
        for t in page["texts"]:
            t["of"] = alike.setdefault((t["text"], t.pop("prev_label")), len(alike))
        return page | {"alike": [{"text": text, "prev_label": label} for text, label in alike]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                found = [told(scan(h)) for h in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[c] for f in found], kind) for c, kind in kinds]], names=[key, *[c for c, _ in kinds]])

    rows = pages.select(key, html).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {schema}")
    spans = F.transform("alike", lambda t: D.block_spans(t["text"], S.class_from_context(t["prev_label"])))
    text = lambda t, found: F.struct(t["vid"].alias("vid"), t["text"].alias("text"), t["bbox"].alias("bbox"), F.get(found, t["of"]).alias("spans"))
    return rows.withColumn("texts", S.bound(spans, lambda found: F.transform("texts", lambda t: text(t, found)))).drop("alike")
