"""Main text of html pages by a tree-structured graphical model.

Each block element of a page is a binary variable, content or not. A unary potential looks at the block (its tag, its
names, its text and links), a pairwise potential at parent and child. Messages are passed from the leaves to the root and
back (sum-product, exact on a tree), and a block's text is kept if its marginal says content. Potentials are trained on
labelled pages."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, without
from .html_tree import blocks

#: Pages of the (bounded) sample from which training pages are made, and training pages made of each.
TRAINING_PAGES, LAYOUTS_EACH = 60, 12

#: Tags that features look at, and names by kind of block. A name counts as a word of a class, id or role, or
#: inside a longer word if it has five letters or more.
TAGS = "#page html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset button select option menu dialog noscript template address details summary iframe svg object canvas".split()
NAMES = {
    "menu": "nav navbar navigation menu topnav breadcrumb pager pagination toolbar skip toc",
    "head": "header head masthead topbar entete kopfzeile cabecera logo branding",
    "foot": "footer foot copyright legal disclaimer imprint impressum fusszeile pied colophon",
    "side": "sidebar side aside widget rail seitenleiste laterale lateral",
    "comment": "comment comments reply replies discuss discussion disqus respond kommentar commentaire comentario",
    "advert": "ad ads adv advert adverts sponsor sponsored promo promotion banner werbung anzeige publicite publicidad anuncio",
    "notice": "cookie consent gdpr notice alert popup modal overlay hinweis avis aviso paywall",
    "form": "form search login signup subscribe newsletter register contact",
    "more": "share social related recommend recommended more popular trending teaser",
    "about": "meta byline tags author date timestamp",
    "hidden": "hidden sr-only",
    "content": "content article post entry main story text body prose",
}

#: Starts of class names that tell what an article is about, not what a block is.
TOPICS = ("category-", "tag-", "type-", "format-", "status-", "topic-", "author-", "post-")

_WORD = re.compile(r"[a-z]+")
_KIND = {w: i for i, words in enumerate(NAMES.values()) for w in words.split()}
_LONG = [(w, i) for w, i in _KIND.items() if len(w) > 4]
_CONTENT = list(NAMES).index("content")
_OTHER = frozenset("nav aside footer form dialog menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("li dt dd td th option".split())


@lru_cache(8192)
def _kinds(marks: str) -> tuple[int, ...]:
    """The kinds of block that an element's own names speak of."""
    found = set()
    for token in marks.split():
        if token.startswith(TOPICS) and token.partition("-")[2] not in ("content", "body", "text", "meta", "comments", "footer", "header"):
            continue
        for w in _WORD.findall(token):
            k = _KIND.get(w, _KIND.get(w[:-1]) if w.endswith("s") else None)
            if k is not None:
                found.add(k)
            elif len(w) > 5:
                found.update(i for name, i in _LONG if name in w)
    return tuple(sorted(found))


#: Where a block stands: above the core, the core, in it, before it, after it.
_PLACES = 5
_STARTS = np.cumsum([0, 2 * (len(TAGS) + 1), len(NAMES), 5 * 3, 5 * 4, _PLACES * 4, 4 * 2, 3, 2, 1]).tolist()
FEATURES = _STARTS[-1]


def set_apart(nodes: list) -> list[bool]:
    """Whether a block is, or is inside, one whose tag or names say that it is something else than the page's text. Blocks
    around an article are not."""
    around, apart = [False] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        around[nodes[i].parent] |= around[i] or nodes[i].tag in ("article", "main")
    for i, node in enumerate(nodes[1:], 1):
        kinds = _kinds(node.marks)
        named = bool(kinds) and _CONTENT not in kinds and node.tag not in ("body", "html")
        apart[i] = apart[node.parent] or not around[i] and (node.tag in _OTHER or named)
    return apart


def core_of(nodes: list, words: list[int], apart: list[bool]) -> int:
    """The block whose own children hold most words of running text: the middle of the page's text. Links are left out, and
    blocks that are set apart."""
    score, leaf = [0.0] * len(nodes), [True] * len(nodes)
    for node in nodes[1:]:
        leaf[node.parent] = False
    for i, node in enumerate(nodes):
        if node.chars and node.tag not in _CELLS and words[i] > 2 and not apart[i]:
            at = node.parent if leaf[i] and node.parent >= 0 else i
            score[at] += words[i] * (1 - node.link_chars / node.chars)
    return max(range(len(nodes)), key=lambda i: (score[i], -i))


def features(nodes: list, runs: list[tuple[int, str]]) -> list[list[int]]:
    """Indices of the features that hold for each block: its tag, inside an article and elsewhere; the kinds of its names;
    the links and the length of its own text, by sort of tag; where it stands to the core of the page, by the length of all
    its text; the links in all its text; whether its text is all that the page has; whether it is in a block set apart."""
    n = len(nodes)
    words = [0] * n
    for i, text in runs:
        words[i] += text.count(" ") + 1
    chars, links, total = [x.chars for x in nodes], [x.link_chars for x in nodes], list(words)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        total[p] += total[i]
    apart = set_apart(nodes)
    core = core_of(nodes, words, apart)
    above, inside, within = [False] * n, [False] * n, [False] * n
    at = core
    while at >= 0:
        above[at] = True
        at = nodes[at].parent
    one_text = sum(1 for w in words if w) == 1
    out = []
    for i, node in enumerate(nodes):
        p, tag = node.parent, node.tag
        inside[i] = p >= 0 and (inside[p] or p == core)
        within[i] = p >= 0 and (within[p] or nodes[p].tag in ("article", "main"))
        found = [_STARTS[0] + (TAGS.index(tag) if tag in TAGS else len(TAGS)) * 2 + within[i]]
        found += [_STARTS[1] + k for k in _kinds(node.marks)]
        sort = 0 if tag == "p" else 1 if tag in _HEADINGS else 2 if tag in _CELLS else 3 if p < 1 or tag == "body" else 4
        if node.chars:
            linked = node.link_chars / node.chars
            found.append(_STARTS[2] + 3 * sort + (linked > 0.2) + (linked > 0.6))
            found.append(_STARTS[3] + 4 * sort + (words[i] > 4) + (words[i] > 12) + (words[i] > 40))
        place = 1 if i == core else 0 if above[i] else 2 if inside[i] else 3 if i < core else 4
        found.append(_STARTS[4] + 4 * place + (total[i] > 0) + (total[i] > 12) + (total[i] > 60))
        if chars[i]:
            linked = links[i] / chars[i]
            found.append(_STARTS[5] + 2 * ((linked > 0.2) + (linked > 0.5) + (linked > 0.8)) + inside[i])
        if place == 1:
            found.append(_STARTS[6] + (total[i] > 20) + (total[i] > 100))
        if words[i] and one_text:
            found.append(_STARTS[7] + (p >= 1))
        if p >= 0 and apart[p]:
            found.append(_STARTS[8])
        out.append(found)
    return out


class Model(NamedTuple):
    """weights of the features and a bias: log odds of content; pair[parent][child]: log potential."""

    weights: list[float]
    bias: float
    pair: list[list[float]]


def _odds(a: float, b: float) -> float:
    """log((e^a) + (e^b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(parents: list[int], unary: list[float], pair: list[list[float]]) -> list[float]:
    """Log odds of each node's marginal, by one pass of messages up the tree and one down. Parents come before children."""
    n = len(parents)
    (p00, p01), (p10, p11) = pair
    up, message = list(unary), [0.0] * n
    for i in range(n - 1, 0, -1):
        u = up[i]
        message[i] = m = _odds(p10, p11 + u) - _odds(p00, p01 + u)
        up[parents[i]] += m
    whole = list(up)
    for i in range(1, n):
        rest = whole[parents[i]] - message[i]
        whole[i] = up[i] + _odds(p01, p11 + rest) - _odds(p00, p10 + rest)
    return whole


def training_pages(pages: list[str]) -> list[str]:
    """Labelled pages: the paragraphs of each sampled page, set into LAYOUTS_EACH layouts made up at random, with text of
    the next page where a layout asks for other text."""
    texts = []
    for page in pages:
        nodes, runs, _ = blocks(page)
        inside = [False] * len(nodes)
        for i, node in enumerate(nodes):
            inside[i] = node.tag in ("article", "main") or (node.parent >= 0 and inside[node.parent])
        found = [t for i, t in runs if inside[i]] or [t for _, t in runs]
        if len(found) > 1:
            texts.append(found)
    if len(texts) < 2:  # nothing to fill layouts with: any words will do
        texts = [["A plain heading", *[f"Some plain words of paragraph {n}, which go on for a while, as words do." * (n % 3 + 1) for n in range(6)]]] * 2
    rng = random.Random(20240311)
    return [_Layout(rng, own, texts[(k + 1) % len(texts)]).page() for k, own in enumerate(texts) for _ in range(LAYOUTS_EACH)]


class _Layout:
    """One page made up at random: an article in some container, with blocks of other kinds before, in and after it. An
    attribute data-content labels an element and all in it."""

    def __init__(self, rng: random.Random, own: list[str], other: list[str]):
        self.rng, self.own, self.other = rng, own, other

    def some(self, *choices: str) -> str:
        return self.rng.choice(choices)

    def words(self, low: int, high: int) -> str:
        """Words of other text."""
        found: list[str] = []
        wanted = self.rng.randint(low, high)
        while len(found) < wanted:
            found += self.rng.choice(self.other).split()[: wanted - len(found)] or ["word"]
        return " ".join(found).replace("&", "&amp;").replace("<", "&lt;")

    def paragraph(self) -> str:
        """A paragraph of the article, or a short one made of it."""
        text = self.rng.choice(self.own)
        if self.rng.random() < 0.25:
            text = " ".join(text.split()[: self.rng.randint(3, 14)])
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.words(low, high)}</a>'

    def named(self, kind: str) -> str:
        """An element's start without its bracket: a tag, mostly with names of a kind."""
        name = self.rng.choice(NAMES[kind].split())
        whole = self.some(name, f"{name}-{self.some('box', 'area', 'wrap', 'list', 'content', 'inner', 'top', 'block')}", f"{self.some('site', 'page', 'my', 'user', 'post', 'wp')}-{name}")
        tags = {"menu": ("nav", "div", "ul", "menu"), "head": ("header", "div"), "foot": ("footer", "footer", "div"), "side": ("aside", "aside", "div"), "comment": ("section", "div"), "form": ("form", "form", "div"), "notice": ("div", "section", "dialog")}
        tag = self.some(*tags.get(kind, ("div", "section", "p")))
        if tag not in ("div", "section", "p", "ul") and self.rng.random() < 0.5 or self.rng.random() < 0.04:
            return tag
        return f'{tag} {self.some("class", "id")}="{whole}"'

    def block(self, kind: str) -> str:
        """A block of some kind, labelled 0. Now and then it has no name at all, and only its place and text tell."""
        start = self.named(kind)
        if kind in ("foot", "head", "menu") and self.rng.random() < 0.25:
            start = self.some("div", "section", "p" if kind == "foot" else "div")
        plain, item = self.words(3, 40), lambda x: f"<li>{x}</li>"
        links = [self.link() for _ in range(self.rng.randint(3, 8))]
        listed = f'<ul>{"".join(map(item, links))}</ul>'
        bodies = {
            "menu": (listed, " ".join(links), " | ".join(links)),
            "head": (f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 12)}</p>", f"<h1>{self.link()}</h1><nav>{listed}</nav>", f"<div>{self.words(1, 5)}</div>{listed}"),
            "foot": (f"&copy; {self.words(2, 12)}", f"<p>{self.words(3, 25)}</p>", f"<p>{self.words(2, 8)} {self.link()}</p>", f"{listed}<p>{self.words(3, 12)}</p>"),
            "side": (f"<h3>{self.words(1, 4)}</h3>{listed}", f"<p>{plain}</p>", f"<h3>{self.words(1, 5)}</h3><p>{plain}</p>{listed}"),
            "comment": ("".join(f'<div class="{self.some("comment", "c", "item", "reply")}"><b>{self.words(1, 2)}</b><p>{self.words(3, 50)}</p></div>' for _ in range(self.rng.randint(1, 5))), f"<h3>{self.words(1, 3)}</h3><ol>{item(f'<p>{self.words(4, 40)}</p>') * 2}</ol>", plain),
            "advert": (plain, f"<p>{plain}</p>", f"<p>{self.link(3, 12)}</p>", f"<h4>{self.words(1, 5)}</h4><p>{plain}</p>"),
            "notice": (f"<p>{plain}</p><button>{self.words(1, 2)}</button>", plain, f"<p>{plain} {self.link()}</p>"),
            "form": (f"<p>{self.words(3, 20)}</p><input><button>{self.words(1, 2)}</button>", f"<label>{self.words(1, 3)}</label><input>"),
            "more": (f"<h4>{self.words(1, 3)}</h4>{listed}", listed, " ".join(links), f"<p>{self.words(2, 10)}</p>{listed}"),
            "about": (self.words(2, 8), f"<p>{self.words(2, 8)}</p>"),
            "hidden": (plain, f"<p>{plain}</p>"),
        }
        texts = (plain, f"<p>{plain}</p>", f"<p>{plain}</p><p>{self.words(3, 30)}</p>", f"<h3>{self.words(1, 5)}</h3><ul>{item(plain)}{item(self.words(2, 20))}</ul>", f"<div><p>{plain}</p></div>")
        body = self.some(*(bodies[kind] if self.rng.random() < 0.6 else texts))  # any kind may hold what others hold
        return f'<{start} data-content="0">{body}</{start.split()[0]}>'

    def middle(self) -> str:
        """The inside of an article."""
        r = self.rng
        title = f"<{self.some('h1', 'h1', 'h2')}>{self.own[0] if r.random() < 0.7 else self.words(2, 9)}</h1>".replace("</h1>", "</h2>") if r.random() < 0.3 else f"<h1>{self.words(2, 9)}</h1>"
        out = [self.some(title, f"<header>{title}</header>", f"<header>{title}<p>{self.words(5, 20)}</p></header>", f'<div class="entry-header">{title}</div>', "")]
        for _ in range(r.randint(1, 7) if r.random() < 0.8 else r.randint(8, 16)):
            out += [f"<p>{self.paragraph()}</p>" for _ in range(self.rng.choice((0, 1, 1, 1, 2, 3)))]
            piece = r.random()
            item = lambda: f"<li>{self.words(2, 15) if r.random() < 0.7 else self.link(2, 8)}</li>"
            if piece < 0.08:
                out.append(f'<{self.some("ul", "ol")}>{"".join(item() for _ in range(r.randint(2, 5)))}</ul>'.replace("</ul>", "</ul></ol>"))
            elif piece < 0.14:
                out.append(f"<p>{self.link(2, 12)}</p>")
            elif piece < 0.2:
                out.append(f"<{self.some('h2', 'h3', 'h4')}>{self.words(1, 8)}</h2>".replace("</h2>", "</h2></h3></h4>"))
            elif piece < 0.24:
                out.append(f"<blockquote><p>{self.words(5, 40)}</p></blockquote>")
            elif piece < 0.27:
                out.append(f"<table><tr><th>{self.words(1, 3)}</th><th>{self.words(1, 3)}</th></tr><tr><td>{self.words(1, 6)}</td><td>{self.words(1, 6)}</td></tr></table>")
            elif piece < 0.3:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif piece < 0.33:
                out.append(f"<figure><img><figcaption>{self.words(2, 12)}</figcaption></figure>")
            elif piece < 0.36:
                out.append(f"<p>{self.words(1, 4)}</p>")
            elif piece < 0.39:
                out.append(f"<div>{self.words(6, 40)}</div>")
            elif piece < 0.42:
                out.append(f"<section><h2>{self.words(1, 5)}</h2><p>{self.words(8, 60)}</p></section>")
            elif piece < 0.6:
                out.append(self.block(self.rng.choice([k for k in NAMES if k != "content"])))
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.05:  # text without blocks
            text = " ".join(self.paragraph() for _ in range(r.randint(1, 4)))
            return self.some("<div>{}</div>", "<body>{}</body>", "{}", "{}<br>{}").format(text, text)
        name = r.choice(NAMES["content"].split())
        topics = " ".join(self.some("category-ad", "tag-menu", "tag-news", "post-12", "type-post", "hentry", "category-footer") for _ in range(r.randint(0, 3)))
        own = self.some("article", "article", "main", "div", "div", "section", "td", f'div class="{name} {topics}"', f'article class="{name} {topics}"', f'div id="{name}"', f'div class="{self.some("page", "site", "single")}-{name}"')
        article = f'<{own} data-content="1">{self.middle()}</{own.split()[0]}>'
        around = lambda *kinds: "".join(self.block(k) for k in kinds if r.random() < 0.45)
        if own == "td":
            links = self.some(" ", "<br>", " | ").join(self.link() for _ in range(r.randint(2, 6)))
            article = f'<table><tr><td data-content="0">{self.some(self.block("menu"), self.block("side"), links, self.words(2, 20))}</td>{article}</tr></table>'
        elif r.random() < 0.5:
            holder = self.some("div", 'div class="wrapper"', 'div id="page"', 'div class="container"', "main", 'div class="row"')
            article = f"<{holder}>{around('menu', 'advert', 'about')}{article}{around('side', 'more', 'comment', 'advert')}</{holder.split()[0]}>"
        before = around("notice", "head", "menu", "menu", "advert", "form", "hidden")
        after = around("side", "more", "comment", "comment", "form", "advert", "notice", "menu") + (self.block("foot") if r.random() < 0.7 else "")
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{before}{article}{after}</body></html>"


def fit(labelled: list[str], rounds: int = 15) -> Model:
    """Potentials from pages whose elements carry data-content labels: a logistic regression for the unary ones, and for
    pairs the logarithm of how much likelier labels of parent and child meet than if they were independent. An element
    without a label has its parent's; above all labels it is content if most of the text below is, and a page without
    labels is all content."""
    rows, target, pairs = [], [], np.ones((2, 2))
    for page in labelled:
        nodes, runs, labels = blocks(page)
        labels = labels if any(labels) else ["1"] * len(nodes)
        known: list[int | None] = [None] * len(nodes)
        for i, node in enumerate(nodes):
            known[i] = int(labels[i]) if labels[i] in ("0", "1") else known[node.parent] if i else None
        total, good = [n.chars for n in nodes], [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if known[i] is None:
                known[i] = int(2 * good[i] >= total[i] > 0)
            else:
                good[i] = total[i] * known[i]
            if i:
                total[nodes[i].parent] += total[i]
                good[nodes[i].parent] += good[i]
        for i, (found, node) in enumerate(zip(features(nodes, runs), nodes, strict=True)):
            rows.append(found)
            target.append(known[i])
            if i:
                pairs[known[node.parent], known[i]] += 1
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for i, found in enumerate(rows):
        x[i, found] = 1
    x[:, -1] = 1
    y, w, ridge = np.array(target, float), np.zeros(FEATURES + 1), np.append(np.full(FEATURES, 0.3), 1e-6)
    for _ in range(rounds):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    share = pairs / pairs.sum()
    pair = np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)))
    return Model(w[:-1].tolist(), float(w[-1]), pair.tolist())


def fit_on(pages: DataFrame, html: str = "html", order: str = "page_id", most: int = TRAINING_PAGES) -> Model:
    """A model trained on layouts that are filled from at most ``most`` pages, those whose ``order`` has the least hash."""
    named = pages.where(F.col(html).isNotNull() & F.col(order).isNotNull()).select(F.col(order).alias("page"), F.col(html).alias("html"))
    drawn = named.select("page").distinct().orderBy(F.xxhash64("page"), "page").limit(most)  # names alone are sorted
    found = named.join(F.broadcast(drawn), "page", "left_semi").groupBy("page").agg(F.min("html").alias("html"))
    return fit(training_pages([r["html"] for r in found.orderBy("page").collect()]))


def main_text(page: str | None, model: Model) -> str:
    """The kept blocks of a page, in page order, joined by newlines."""
    nodes, runs, _ = blocks(page)
    if not runs:
        return ""
    w, bias = model.weights, model.bias
    unary = [bias + sum([w[k] for k in found]) for found in features(nodes, runs)]
    odds = marginals([n.parent for n in nodes], unary, model.pair)
    return "\n".join([text for i, text in runs if odds[i] > 0])


def extracted(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` string (empty if there is none) and ``n_chars`` long, its code points.

    Cases: a null or empty page, or one without content, has the empty text; broken html is read as browsers do, more
    or less (open elements end with their parents, stray ends are ignored); references that don't exist stay as they
    are; repeated rows each get a row; an empty table gives none; columns named like outputs are replaced.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, model)).astype(object)

    name = fresh(pages, "main_text")
    out = bounded_batches(pages).withColumn(name, text(F.col(html)))
    return out.select(*without(pages, "text", "n_chars"), F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
