"""Main text of web pages by gradient-boosted trees over the nodes of the page.

The trees are fitted on a bounded sample of pages. Labels come from the markup where it says what is what (article and main against nav, header, footer,
aside, form and attribute words such as "comments" or "cookie"). To carry over to pages whose markup says less, each page is used again in layouts composed of its
paragraphs and other pages' sentences, with plain containers, sidebars, notices, forms and comments around the article. Nodes are block
elements and runs of text; the labelling chosen is the likeliest in which no node is main text below one that is not.

Defined results: a null or empty html gives an empty text; a page whose nodes are all rejected too; broken markup is closed where it
ends; a model fitted on no labelled page takes every run of text.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm import dom
from lociframe.llm.tokens import map_batches

#: Bounds of the fit: pages in the sample, characters of a page in it, layouts composed of each.
FIT_PAGES, FIT_CHARS, LAYOUTS = 400, 60_000, 3
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 60, 5, 32, 0.25, 8
NODES_TOGETHER = 20_000
_MAIN = {dom.TAGS.index("article"), dom.TAGS.index("main")}
_REST_BITS = sum(1 << k for k, name in enumerate(dom.NAMES) if name not in ("main",))


@dataclass
class Trees:
    """Full binary trees: a feature and a cut for each inner node, a value for each leaf."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    inner, bias = 2**DEPTH - 1, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    trees = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, inner + 1)), bias)
    total = np.full(n, bias)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            nodes, base = 2**level, 2**level - 1
            best, pick, bin_of = np.full(nodes, 1e-3), np.zeros(nodes, np.int64), np.full(nodes, BINS)
            for f in range(width):
                key = (at - base) * (BINS + 1) + binned[:, f]
                sums = [np.cumsum(np.bincount(key, w, minlength=nodes * (BINS + 1)).reshape(nodes, -1), axis=1) for w in (g, h, None)]
                (gl, hl, nl), (ga, ha, na) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(nl < LEAST_LEAF) | (na - nl < LEAST_LEAF)] = -1
                gain[:, len(cuts[f]) :] = -1
                top = gain.argmax(axis=1)
                better = gain[np.arange(nodes), top] > best
                best[better], pick[better], bin_of[better] = gain[np.arange(nodes), top][better], f, top[better]
            trees.feature[t, base : base + nodes] = pick
            trees.cut[t, base : base + nodes] = [cuts[f][b] if b < BINS else np.inf for f, b in zip(pick, bin_of, strict=True)]
            at = 2 * at + 1 + (binned[np.arange(n), pick[at - base]] > bin_of[at - base])
        leaf = at - inner
        sums = [np.bincount(leaf, w, minlength=inner + 1) for w in (g, h)]
        trees.leaf[t] = RATE * sums[0] / (sums[1] + 1)
        total += trees.leaf[t][leaf]
    return trees


def by_markup(page: dom.Page) -> np.ndarray | None:
    """Labels of a page whose markup names its main part; None if it names none."""
    n, inside, outside = len(page.tag), np.zeros(len(page.tag), bool), np.zeros(len(page.tag), bool)
    for k in range(1, n):
        up = page.parent[k]
        outside[k] = outside[up] or bool(page.named[k] & _REST_BITS)
        inside[k] = inside[up] or page.tag[k] in _MAIN
    main = inside & ~outside & (np.array(page.tag) == -1)
    return _upward(page, main) if main.any() else None


def _upward(page: dom.Page, main: np.ndarray) -> np.ndarray:
    """An element is positive if it holds main text."""
    y = main.copy()
    for k in range(len(y) - 1, 0, -1):
        y[page.parent[k]] |= y[k]
    return y


def layout(rng: random.Random, title: str, paragraphs: list[str], pool: list[str]) -> str:
    """A page of the given article among parts made of other pages' sentences; data-y marks what is main."""
    say = lambda low=1, high=2: html.escape(" ".join(rng.choice(pool) for _ in range(rng.randint(low, high))))
    name = lambda kind: rng.choice(["", f' class="{rng.choice(dom.NAMES[kind].split())}"', f' id="{rng.choice(dom.NAMES[kind].split())}-{rng.randint(1, 9)}"'])
    links = lambda low, high: "<ul>" + "".join(f'<li><a href="/{k}">{html.escape(rng.choice(pool).split(" ")[0])}</a></li>' for k in range(rng.randint(low, high))) + "</ul>"
    pick = lambda kind, *tags: (rng.choice(tags), name(kind))

    def part(kind: str, inner: str, *tags: str) -> str:
        tag, attribute = pick(kind, *tags)
        if tag == "div" and not attribute:  # something must tell it from the article
            attribute = f' class="{rng.choice(dom.NAMES[kind].split())}"'
        return f'<{tag}{attribute} data-y="0">{inner}</{tag}>'

    wrap = lambda text: rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(text)
    body = [f"<h1>{html.escape(title)}</h1>"] + [wrap(html.escape(p)) for p in paragraphs]
    extras = [part("advert", f"<p>{say()}</p>", "div", "aside"), part("share", links(2, 4), "div"), part("notice", say(), "div")]
    for extra in rng.sample(extras, rng.randint(0, 2)):
        body.insert(rng.randint(1, len(body)), extra)
    tag = rng.choice(["article", "main", "div", "div", "section"])
    article = f'<{tag}{name("main")} data-y="1">{"".join(body)}</{tag}>'
    comments = part("talk", rng.choice(["<h2>Comments</h2>", ""]) + "".join(f"<{t}><p>{say(1, 3)}</p></{t}>" for t in rng.choices(["div", "li", "section"], k=rng.randint(1, 5))), "section", "div")
    before = [part("menu", links(3, 9), "nav", "div", "ul"), part("edge", f"<p>{say(1, 1)}</p>", "header", "div"), part("notice", f"<p>{say()}</p>", "div"), part("advert", say(1, 1), "div")]
    after = [comments, part("side", links(2, 6) + f"<p>{say()}</p>", "aside", "div"), part("form", f"<label>{say(1, 1)}</label><input>", "form"), part("edge", f"&copy; {say(1, 1)}", "footer", "div"), part("side", f"<h3>{say(1, 1)}</h3>{links(2, 5)}", "aside", "div")]
    top, end = rng.sample(before, rng.randint(1, 4)), rng.sample(after, rng.randint(1, 5))
    if rng.random() < 0.3:
        article = f"<div>{article}{end.pop()}</div>"
    return f"<html><head><title>{html.escape(title)}</title></head><body>{''.join(top)}{article}{''.join(end)}</body></html>"


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = FIT_PAGES) -> Trees:
    """Fit on about ``most`` pages of at most FIT_CHARS characters, chosen by a hash of the id."""
    usable = pages.where(F.length(F.col(html_col)).between(1, FIT_CHARS))
    n = usable.count()
    chance = usable.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 62)) < F.lit((most << 62) // n)) if n > most else usable
    sources = [r[0] for r in chance.select(F.col(html_col), F.col(id_col)).orderBy(id_col).limit(2 * most).collect()]
    rng, xs, ys = random.Random(7), [], []
    parsed = [dom.parse(s) for s in sources]
    labelled = [(p, y) for p in parsed if (y := by_markup(p)) is not None]
    articles = [[t for t, k, g in zip(p.text, y, p.tag, strict=True) if k and g == -1] for p, y in labelled]
    pool = [s for a in articles for t in a for s in t.split(". ")[:3]] or ["-"]
    for (page, y), texts in zip(labelled, articles, strict=True):
        xs.append(dom.features(page))
        ys.append(y)
        for _ in range(LAYOUTS):
            made = dom.parse(layout(rng, texts[0], texts[1:][: rng.randint(1, 40)] or texts, pool))
            xs.append(dom.features(made))
            ys.append(_upward(made, (np.array(made.label) == 1) & (np.array(made.tag) == -1)))
    if not xs:
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32), np.zeros((0, 2)), 9.0)
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(model: Trees, sources: list[str | None]) -> list[str]:
    out: list[str] = []
    held: list[dom.Page] = []

    def settle() -> None:
        if held:
            p = model.probability(np.concatenate([dom.features(x) for x in held]))
            for page, part in zip(held, np.split(p, np.cumsum([len(x.tag) for x in held])[:-1]), strict=True):
                out.append("\n".join(dom.decode(page, part)))
            held.clear()

    size = 0
    for source in sources:
        held.append(dom.parse(source or ""))
        size += len(held[-1].tag)
        if size > NODES_TOGETHER:
            settle()
            size = 0
    settle()
    return out


def extracted(pages: DataFrame, model: Trees, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            texts = main_texts(shared.value, part.column(part.num_columns - 1).to_pylist())
            yield {c: part.column(k) for k, c in enumerate(rest)} | {"text": texts, "n_chars": [len(t) for t in texts]}

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return map_batches(pages.select(*[F.col(c) for c in rest], F.col(html_col).cast("string")), run, f"{kinds}, text string, n_chars long")
