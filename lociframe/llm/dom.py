"""Pages as trees of block elements and runs of text, with features of each node for telling main text from the rest."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(r"<!--|<!\[CDATA\[|<([/]?)([a-zA-Z][^\s/>]*)|<[!?]")
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SILENT = frozenset("script style head title template noscript iframe noembed noframes svg math object select button textarea xmp canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_SAME = frozenset("li option tr td th dt dd p".split())
#: Elements of one kind that end one another within the same list or table.
FAMILY = {"dt": "dl", "dd": "dl", "td": "row", "th": "row"}
_ENDED_BY = {t: ("p", t, *(u for u in FAMILY if u != t and FAMILY[u] == FAMILY.get(t))) for t in CLOSES_SAME if t != "p"}
SCOPE = frozenset("ul ol dl table tbody thead tfoot article section main aside nav header footer div body html form blockquote".split())

TAGS = ("html", "body", "div", "section", "article", "main", "p", "h", "li", "list", "table", "nav", "header", "footer", "aside", "form", "figure", "quote", "other")
_GROUP = {t: t for t in TAGS} | {f"h{k}": "h" for k in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "td": "table", "tr": "table", "tbody": "table", "th": "table", "blockquote": "quote", "pre": "p", "dd": "li", "dt": "li", "fieldset": "form", "legend": "form", "figcaption": "figure", "dialog": "aside", "address": "footer"}

#: Words of class, id and role that name a part of a page, by kind.
NAMES = {
    "main": "article articlebody body content entry main post story text",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc toolbar",
    "edge": "banner bottom copyright foot footer head header legal masthead site top",
    "side": "aside popular recent related recommended rail side sidebar tags trending widget",
    "notice": "alert consent cookie cookies gdpr modal notice overlay popup subscribe newsletter signup paywall message",
    "advert": "ad ads adv advert advertisement adsense promo promoted promotion sponsor sponsored",
    "form": "contact form input login register search",
    "talk": "comment comments commentlist discussion disqus feedback replies reply respond responses review reviews thread",
    "share": "author byline follow meta share sharing social",
}
_NAMED = {w: k for k, ws in enumerate(NAMES.values()) for w in ws.split()}
KINDS = len(NAMES)
_TAG_KIND = {"nav": 1, "header": 2, "footer": 2, "aside": 3, "form": 6}


@dataclass
class Page:
    """Nodes in page order, parents first. A run of text is a node with tag -1."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    named: list[int] = field(default_factory=list)  # bits of NAMES
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters within links
    label: list[int] = field(default_factory=list)  # from data-y while training, else -1

    def add(self, tag: int, parent: int, named: int, text: str, linked: int, label: int) -> int:
        for column, value in zip((self.tag, self.parent, self.depth, self.named, self.text, self.linked, self.label), (tag, parent, self.depth[parent] + 1 if parent >= 0 else 0, named, text, linked, label), strict=True):
            column.append(value)
        return len(self.tag) - 1


def _tag_end(page: str, at: int) -> int:
    """Just after the > that ends a tag; one within quotes does not."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quote = min((q for q in (page.find('="', at, end), page.find("='", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end + 1
        close = page.find(page[quote + 1], quote + 2)
        if close < 0:
            return end + 1
        at = close + 1


def names_in(attributes: dict[str, str]) -> int:
    bits = 0
    for key in ("class", "id", "role", "itemprop", "aria-label"):
        for word in _TOKEN.findall(attributes.get(key, "")):
            kind = _NAMED.get(word.lower())
            if kind is not None:
                bits |= 1 << kind
    return bits


def parse(source: str) -> Page:
    page = Page()
    root = page.add(TAGS.index("html"), -1, 0, "", 0, -1)
    stack: list[tuple[str, int]] = [("html", root)]  # tag, nearest block node
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, but the root
    scopes: list[int] = [0]
    run: list[str] = []
    state = {"linked": 0, "links": 0, "silent": 0, "label": -1}

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.add(-1, stack[-1][1], 0, text, min(state["linked"], len(text)), page.label[stack[-1][1]])
            run.clear()
        state["linked"] = 0

    def say(piece: str) -> None:
        if piece and not state["silent"]:
            piece = html.unescape(piece)
            run.append(piece)
            if state["links"]:
                state["linked"] += len(piece.strip())

    def pop(to: int) -> None:
        while len(stack) > to:
            tag, _ = stack[-1]
            if tag not in INLINE:
                flush()
            stack.pop()
            places[tag].pop()
            if tag in SCOPE:
                scopes.pop()
            state["links"] -= tag == "a"
            state["silent"] -= tag in SILENT

    def push(tag: str, node: int) -> None:
        places[tag].append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append((tag, node))

    at = 0
    while True:
        found = _TAG.search(source, at)
        if not found:
            say(source[at:])
            break
        say(source[at : found.start()])
        head = found.group()
        if head == "<!--":
            end = source.find("-->", found.end())
            at = len(source) if end < 0 else end + 3
            continue
        if head == "<![CDATA[":
            end = source.find("]]>", found.end())
            say(html.escape(source[found.end() : len(source) if end < 0 else end]))
            at = len(source) if end < 0 else end + 3
            continue
        at = _tag_end(source, found.end())
        if found.group(2) is None:
            continue
        tag = found.group(2).lower()
        if found.group(1):
            # The innermost open element of the name; an inline one not beyond the nearest scope.
            if places[tag] and (tag not in INLINE or places[tag][-1] >= scopes[-1]):
                pop(places[tag][-1])
            continue
        if tag == "html":
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        body = source[found.end() : at].rstrip(">")
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(body)} if body.strip(" /") else {}
        if tag in INLINE:
            push(tag, stack[-1][1])
            state["links"] += tag == "a"
        else:
            flush()
            # What this start ends: the innermost of these within the nearest scope.
            ends = max((places[t][-1] for t in _ENDED_BY.get(tag, ("p",)) if places[t]), default=-1)
            if ends >= max(1, scopes[-1]):
                pop(ends)
            label = int(attributes["data-y"]) if attributes.get("data-y", "") in ("0", "1") else page.label[stack[-1][1]]
            group = _GROUP.get(tag, "other")
            named = names_in(attributes) | (1 << _TAG_KIND[tag] if tag in _TAG_KIND else 0)
            push(tag, page.add(TAGS.index(group), stack[-1][1], named, "", 0, label) if not state["silent"] and tag not in SILENT else stack[-1][1])
            state["silent"] += tag in SILENT
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(source, at)
            end = close.start() if close else len(source)
            say(source[at:end])
            at = end
        elif body.endswith("/") and tag in ("svg", "math"):
            pop(len(stack) - 1)
    pop(1)
    flush()
    return page


FEATURES = ("tag", "parent_tag", "depth", "length", "share", "parent_share", "grand_share", "link", "parent_link", "grand_link", "runs", "parent_runs", "mean", "parent_mean", "stops", "parent_stops", "tags", "siblings", "place", "same", "first", "begin", "own_names", "above_names", "is_text") + tuple(
    f"{where}_{k}" for where in ("own", "above") for k in NAMES
)


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    tag, parent = np.array(page.tag), np.array(page.parent)
    length = np.array([len(t) for t in page.text], float)
    stops = np.array([t.count(".") + t.count(",") for t in page.text], float)
    begin = np.concatenate(([0.0], np.cumsum(length)[:-1]))
    sums = np.stack([length, np.array(page.linked, float), (tag == -1).astype(float), stops, (tag >= 0).astype(float)])
    above = np.zeros(n, np.int64)
    named = np.array(page.named)
    children = np.zeros(n)
    order = np.zeros(n)
    alike: dict[tuple[int, int], int] = {}
    same = np.zeros(n)
    for k in range(1, n):
        p = page.parent[k]
        above[k] = above[p] | named[p]
        order[k] = children[p]
        children[p] += 1
        same[k] = alike[p, page.tag[k]] = alike.get((p, page.tag[k]), 0) + 1
    for k in range(n - 1, 0, -1):
        sums[:, page.parent[k]] += sums[:, k]
    total = max(1.0, sums[0, 0])
    up = np.where(parent < 0, 0, parent)
    up2 = up[up]
    size = np.maximum(1.0, sums[0])
    share, link, mean, stop = sums[0] / total, sums[1] / size, sums[0] / np.maximum(1, sums[2]), sums[3] / size
    same_all = np.array([alike.get((page.parent[k], page.tag[k]), 1) for k in range(n)])
    bits = lambda x: [(x >> k) & 1 for k in range(KINDS)]
    columns = [
        tag, tag[up], np.array(page.depth), np.log1p(sums[0]), share, share[up], share[up2], link, link[up], link[up2], np.log1p(sums[2]), np.log1p(sums[2][up]),
        np.log1p(mean), np.log1p(mean[up]), stop, stop[up], sums[4] / size, np.log1p(children[up]), order / np.maximum(1, children[up]), np.log1p(same_all), same,
        begin / total, named > 0, above > 0, tag == -1, *bits(named), *bits(above),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


def decode(page: Page, p: np.ndarray) -> list[str]:
    """The text runs of the likeliest labelling in which nothing below a node that is not main text, or holds none, is main text."""
    n = len(page.tag)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    all_no = list(no)
    best = list(yes)
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        all_no[up] += all_no[k]
        best[up] += max(best[k], all_no[k])
    keep = [True] * n
    for k in range(n):
        up = page.parent[k]
        keep[k] = (up < 0 or keep[up]) and best[k] > all_no[k]
    return [page.text[k] for k in range(n) if keep[k] and page.tag[k] == -1]

