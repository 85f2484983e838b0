"""Main text of web pages by a graphical model over the tree of their elements.

Each element and each piece of text is a node that is content or not. A node has a potential from its own features (tag,
words of its class, id and role, text under it, share of links), and each node with its parent another, so that content
holds together and boilerplate within content stays boilerplate. Messages go up from the leaves and down from the root
(sum-product, exact on a tree) and give each node's marginal. Potentials are fitted by the likelihood of labelled pages.

Labelled pages are `MADE` ones put together from the parts below (menus, notices, comments, ways to wrap an article),
where `data-main="1"` or `"0"` speaks for all below it, filled with words of the table's pages, and up to `SAMPLE` pages of the table with one plain article element, once as they are and once with that
element renamed, so that the model doesn't lean on that tag alone. Labels are never seen as features.

Text is put out in blocks: maximal runs of text without a block element's start or end between. A block stays if the
mean marginal of its characters is over one half; it stays whole.

Defined results: null and empty pages have an empty text; a page of plain text is one block; broken markup is closed as
browsers do for paragraphs, list items and cells, and a stray end is passed over; equal rows get equal results; an empty
table gives an empty result. Other columns may be kept by name.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import append, fresh, settle

#: Pages of the table and pages made of parts that the model is fitted on, the characters of the longest of the former;
#: steps of the fit and its penalty.
SAMPLE, MADE, LONGEST, STEPS, PENALTY = 200, 400, 50_000, 120, 0.002

BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hgroup hr html head title legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
HIDDEN = frozenset("script style noscript template textarea iframe svg math object canvas noembed noframes xmp".split())
#: What a start tag closes: the open element it ends, and the element that the search for it stops at.
ENDS = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dd dt", {"dl"}), "dd": ("dd dt", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}), "body": ("head", {"html"}),
}
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}
_markup = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
_attribute = re.compile(r"""([a-zA-Z][^\s=/>]*)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""")
_words = re.compile("[a-z]+")


class Tree:
    """Elements and texts of a page in document order: parent, tag ("" for text), attributes, text, and the block of each text."""

    def __init__(self, page: str):
        self.parent, self.tag, self.attributes, self.text, self.block = [-1], ["#page"], [{}], [""], [0]
        self.open, self.count, self.blocks = [0], {}, 0
        at, end = 0, len(page)
        while at < end:
            m = _markup.search(page, at)
            self._say(page[at : m.start() if m else end])
            if not m:
                break
            at, name = m.end(), (m[2] or "").lower()
            if name and m[1]:
                self._close(name)
            elif name:
                self._start(name, m[3])
                if name in HIDDEN and not m[3].endswith("/>"):
                    stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
                    at = stop.end() if stop else end
                    self._close(name)

    def _add(self, tag: str, attributes: dict, text: str) -> int:
        for column, value in zip((self.parent, self.tag, self.attributes, self.text, self.block), (self.open[-1], tag, attributes, text, self.blocks), strict=True):
            column.append(value)
        return len(self.tag) - 1

    def _say(self, raw: str) -> None:
        if raw:
            self._add("", {}, html.unescape(raw))

    def _start(self, name: str, rest: str) -> None:
        if name in CLOSES_P:
            self._end("p", {"button", "table", "td", "th", "article", "section", "div"} if self.count.get("p") else None)
        if name in ENDS:
            for old in ENDS[name][0].split():
                self._end(old, ENDS[name][1])
        if name in ("br", "wbr"):
            if name == "br":
                self._add("", {}, " ")
            return
        self.blocks += name in BLOCKS
        k = self._add(name, {a.lower(): v.strip("\"'") for a, v in _attribute.findall(rest)}, "")
        if name not in VOID:
            self.open.append(k)
            self.count[name] = self.count.get(name, 0) + 1

    def _end(self, name: str, until: set | None) -> None:
        """Close the innermost element of that name unless one of `until` stands between."""
        if self.count.get(name):
            for k in reversed(self.open):
                if self.tag[k] == name:
                    return self._close(name)
                if until is None or self.tag[k] in until:
                    return None
        return None

    def _close(self, name: str) -> None:
        while self.count.get(name):
            tag = self.tag[self.open.pop()]
            self.count[tag] -= 1
            self.blocks += tag in BLOCKS
            if tag == name:
                break


def _sums(tree: Tree, own: np.ndarray) -> np.ndarray:
    """own added up over everything below each node."""
    out = own.copy()
    for k in range(len(out) - 1, 0, -1):
        out[tree.parent[k]] += out[k]
    return out


def _names(tree: Tree) -> list[list[str]]:
    """The features of each node, by name."""
    texts, linked = [x.strip() for x in tree.text], [False] * len(tree.tag)
    for k in range(1, len(linked)):
        linked[k] = linked[tree.parent[k]] or tree.tag[k] in ("a", "button", "option")
    letters = np.array([len(x) for x in texts], float)
    below, links = _sums(tree, letters), _sums(tree, letters * linked)
    stops = _sums(tree, np.array([x.count(". ") + x.endswith((".", "!", "?")) for x in texts], float))
    out = []
    for k, tag in enumerate(tree.tag):
        f = ["any", f"long {min(8, int(below[k]).bit_length() // 2)}", f"links {int(4 * links[k] / below[k]) if below[k] else 'none'}"]
        f.append(f"stops {min(4, int(stops[k]))}")
        if tag:
            f.append(f"tag {tag}")
            said = " ".join(v for a, v in tree.attributes[k].items() if a in ("class", "id", "role", "itemprop", "aria-label"))
            f += [f"said {w}" for w in set(_words.findall(said.lower()))]
        else:
            f += ["text", f"in {tree.tag[tree.parent[k]]}"]
            if texts[k].startswith(("©", "(c)")):
                f.append("rights")
        out.append(f)
    return out


class Forest:
    """Trees laid end to end, with the nodes of each depth together, so that messages go level by level."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.tag) for t in trees])
        self.start = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, self.start, strict=True)])
        depth = np.zeros(len(self.parent), np.int64)
        for k, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.kind = np.array([0 if tag else 1 for t in trees for tag in t.tag])

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Log-marginals of each node, of each node with its parent (parent's state first), and the log of the sum over all states.

        unary: log-potentials (node, state); edge: (kind of child, state of parent, state of child).
        """
        n = len(self.parent)
        up, sent = unary.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            sent[level] = np.logaddexp.reduce(edge[self.kind[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], sent[level])
        down, pairs = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            others = up[p] + down[p] - sent[level]
            both = edge[self.kind[level]] + others[:, :, None]
            down[level] = np.logaddexp.reduce(both, axis=1)
            pairs[level] = both + up[level][:, None, :]
        single = up + down
        total = np.logaddexp.reduce(single, axis=1, keepdims=True)
        return single - total, pairs - total[:, :, None], float(total[self.levels[0], 0].sum())


class Model:
    """Weights of features and the table of parent and child."""

    def __init__(self, weights: dict[str, float], edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def content(self, trees: list[Tree]) -> list[np.ndarray]:
        """The marginal of content of each node of each tree."""
        forest = Forest(trees)
        score = np.array([sum(self.weights.get(f, 0.0) for f in node) for t in trees for node in _names(t)])
        single, _, _ = forest.marginals(np.stack([np.zeros(len(score)), score], axis=1), self.edge)
        return np.split(np.exp(single[:, 1]), forest.start[1:])

    def main_text(self, pages: list[str]) -> list[str]:
        trees = [Tree(p) for p in pages]
        return [_blocks(t, p) for t, p in zip(trees, self.content(trees), strict=True)]


def _blocks(tree: Tree, content: np.ndarray) -> str:
    out, at = [], 0
    places = [k for k, tag in enumerate(tree.tag) if not tag]
    while at < len(places):
        end = at
        while end < len(places) and tree.block[places[end]] == tree.block[places[at]]:
            end += 1
        run = places[at:end]
        if text := " ".join("".join(tree.text[k] for k in run).split()):
            weight = np.array([len(tree.text[k].strip()) for k in run], float)
            if (content[run] * weight).sum() > 0.5 * weight.sum():
                out.append(text)
        at = end
    return "\n".join(out)


def truth(tree: Tree) -> np.ndarray:
    """The labelled state of each node: a text's by the nearest label around it, an element's by most of the text below."""
    said = [0] * len(tree.tag)
    for k in range(1, len(said)):
        said[k] = int(tree.attributes[k].get("data-main", said[tree.parent[k]]))
    letters = np.array([len(x.strip()) for x in tree.text], float)
    below, main = _sums(tree, letters), _sums(tree, letters * said)
    return np.where(below > 0, 2 * main > below, said).astype(np.int64)


def fit(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """The model of greatest likelihood of labelled pages, less a penalty on its weights, by gradient steps of adapted size."""
    trees = [Tree(p) for p in pages]
    forest, y = Forest(trees), np.concatenate([truth(t) for t in trees])
    named = [node for t in trees for node in _names(t)]
    known = {f: k for k, f in enumerate(sorted({f for node in named for f in node}))}
    row = np.repeat(np.arange(len(named)), [len(node) for node in named])
    column = np.array([known[f] for node in named for f in node])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    weights, edge = np.zeros(len(known)), np.zeros((2, 2, 2))
    moved = [np.full(weights.shape, 1e-3), np.full(edge.shape, 1e-3)]
    for _ in range(steps):
        score = np.bincount(row, weights[column], len(named))
        single, pairs, _ = forest.marginals(np.stack([np.zeros(len(score)), score], axis=1), edge)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.kind[child], np.exp(pairs[child]))
        slopes = [np.bincount(column, (y - np.exp(single[:, 1]))[row], len(known)) / len(pages) - penalty * weights, (seen - expected) / len(pages) - penalty * edge]
        for value, slope, m in zip((weights, edge), slopes, moved, strict=True):
            m += slope**2
            value += 0.5 * slope / np.sqrt(m)
    return Model({f: float(weights[k]) for f, k in known.items()}, edge)


#: Labelled pages are put together from these parts. {p} stands for a paragraph, {s} for a few words.
AROUND = """
<nav><ul><li><a>{s}</a></li><li><a>{s}</a></li><li><a>{s}</a></li></ul></nav>
<nav class="menu navigation"><a>{s}</a> <a>{s}</a></nav>
<div class="nav menu navbar"><ul><li><a>{s}</a></li><li><a>{s}</a></li></ul></div>
<ul id="menu" class="menu"><li><a>{s}</a><li><a>{s}</a><li><a>{s}</a></ul>
<header><p>{s}</p></header>
<header class="site-header masthead"><h2>{s}</h2><p>{p}</p></header>
<div id="header" class="header top banner"><h1>{s}</h1><p>{s}.</p></div>
<footer>&copy; {s}. {p}</footer>
<footer class="site-footer"><p>{p}</p><a>{s}</a></footer>
<div id="footer" class="footer bottom copyright">&copy; {s}</div>
<aside><p>{p}</p></aside>
<aside class="sidebar"><h3>{s}</h3><p>{p}</p><p>{p}</p></aside>
<div id="sidebar" class="sidebar side widget"><h3>{s}</h3><p>{p}</p><ul><li><a>{s}</a></li></ul></div>
<div class="notice cookie consent gdpr cookies"><p>{p}</p><button>{s}</button></div>
<div class="notice alert warning message" role="alert">{p}</div>
<section class="notice announcement disclaimer"><p>{p}</p><p>{p}</p></section>
<div class="ad">{p}</div>
<div class="ads advert advertisement"><p>{p}</p><p>{p}</p></div>
<div class="sponsored promo promotion banner"><h2>{s}</h2><p>{p}</p></div>
<form><p>{p}</p><label>{s}</label><input><button>{s}</button></form>
<form class="search newsletter subscribe signup login"><label>{s}</label><p>{p}</p></form>
<section class="comments" id="comments"><h2>{s}</h2><p>{p}</p><p>{p}</p></section>
<div class="comments comment-list discussion"><div class="comment"><b>{s}</b><p>{p}</p></div><div class="comment"><p>{p}</p></div></div>
<div id="comments" class="replies reader reviews responses respond"><article class="comment"><p>{p}</p></article><ul><li class="comment">{p}</li></ul></div>
<div class="related more recommended"><h3>{s}</h3><ul><li><a>{s}</a></li><li><a>{s}</a></li></ul></div>
<div class="share social follow"><a>{s}</a><a>{s}</a></div>
<div class="breadcrumb breadcrumbs pagination"><a>{s}</a></div>
""".strip().split("\n")
MAIN = """
<article>{main}</article>
<article class="post entry hentry">{main}</article>
<main>{main}</main>
<main><article>{main}</article></main>
<main id="main" role="main" class="main"><h1>{s}</h1><div class="text">{main}</div></main>
<div id="content" class="content post entry body">{main}</div>
<div class="page wrapper container"><div class="article story text">{main}</div></div>
<section class="article body">{main}</section>
<div>{main}</div>
""".strip().split("\n")
WITHIN = """
<p>{p}</p>
<p>{p} <a>{s}</a> {p}</p>
<p><b>{s}</b> {p} <i>{s}</i></p>
<p><b>{s}<br><p>{p}</p>
<p>{s}.</p>
<h2>{s}</h2><p>{p}</p>
<ul><li>{p}</li><li>{s}.</li></ul>
<ol><li><a>{s}</a> {p}</li><li>{p}</li></ol>
<blockquote><p>{p}</p></blockquote>
<table><tr><th>{s}</th><th>{s}</th></tr><tr><td>{s}</td><td>{p}</td></tr></table>
<pre>{p}</pre>
<figure><figcaption>{s}</figcaption></figure>
<div><p>{p}</p></div>
<section><h2>{s}</h2><p>{p}</p></section>
<dl><dt>{s}</dt><dd>{p}</dd></dl>
{p}
""".strip().split("\n")


def filled(paragraphs: list[str], pages: int = MADE, seed: int = 1) -> list[str]:
    """Labelled pages of parts chosen at random (by `seed`), with paragraphs and first words of paragraphs in their slots."""
    given = [x for x in paragraphs if x.strip()] or ["A plain paragraph of some words that says a thing, and another. It ends here."]
    draw, out = random.Random(seed), []

    def around(most: int) -> str:
        return "".join(f'<div data-main="0">{x}</div>' if draw.random() < 0.1 else re.sub("<([a-z]+)", r'<\1 data-main="0"', x, count=1) for x in draw.sample(AROUND, draw.randint(0, most)))

    def words(slot: re.Match) -> str:
        said = draw.choice(given).split()
        return html.escape(" ".join(said if slot[1] == "p" else said[: draw.randint(1, 7)]))

    for _ in range(pages):
        parts = ["<h1>{s}</h1>"] * (draw.random() < 0.8) + draw.choices(WITHIN[:4] * 3 + WITHIN, k=draw.randint(1, 8))
        if draw.random() < 0.5:
            parts.insert(draw.randint(0, len(parts)), around(2))
        main = re.sub("<([a-z]+)", r'<\1 data-main="1"', draw.choice(MAIN), count=1).replace("{main}", "".join(parts))
        page = f"<head><title>{{s}}</title></head><body>{around(4)}{main}{around(4)}</body>"
        out.append(re.sub(r"\{([ps])\}", words, page))
    return out


def relabelled(page: str) -> list[str]:
    """A page with one plain article element, labelled by it: as it is, and with that element renamed. Else none."""
    if len(re.findall("<article>", page)) != 1 or page.count("</article>") != 1 or "data-main" in page:
        return []
    before, _, rest = page.partition("<article>")
    inside, _, after = rest.partition("</article>")
    if re.search(r"(?i)<(nav|aside|footer|header|form|section|div)\b|\s(class|id|role)\s*=", inside):
        return []
    return [f'{before}<{tag} data-main="1">{inside}</{tag}>{after}' for tag in ("article", "div")]


def labelled(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One column, page: the labelled pages; those of the table are the `sample` ids of least hash."""
    short = pages.filter(F.length(html) <= LONGEST).select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    ids = settle(short.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample))
    return short.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.max("html").alias("page")).select("page")


def train(pages: DataFrame) -> Model:
    """The model of made pages and the labelled pages (column page). Their number is bounded, so one task fits it."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted(p for b in batches for p in b.column(0).to_pylist())
        paragraphs = [re.sub("<[^>]*>", " ", x) for p in own for x in re.findall(r"(?s)<p>(.*?)</p>", p)][:2000]
        model = fit(filled([html.unescape(x) for x in paragraphs]) + [made for p in own for made in relabelled(p)])
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([model.weights, model.edge.tolist()])])], names=["model"])

    said = pages.coalesce(1).mapInArrow(fn, "model string").first()
    weights, edge = json.loads(said[0]) if said else ({}, np.zeros((2, 2, 2)).tolist())
    return Model(weights, np.array(edge))


def extract(pages: DataFrame, model: Model, keep: list[str], html: str = "html") -> DataFrame:
    """The columns `keep`, text and n_chars, a row for each row."""
    weights, edge = model.weights, model.edge

    def fn(x: pa.Array) -> list:
        texts = Model(weights, edge).main_text([v or "" for v in x.to_pylist()])
        return [texts, [len(t) for t in texts]]

    text, n = fresh(pages, "text", "n_chars")
    return append(pages, [html], f"{text} string, {n} long", fn, keep).withColumnsRenamed({text: "text", n: "n_chars"})
