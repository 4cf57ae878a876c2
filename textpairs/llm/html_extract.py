"""Main-text extraction with a tree-structured graphical model (operator 9).

A page is a tree of block elements and runs of inline text (``dom``). Each node
has a hidden label, content or not. Unary potentials are weights of the node's
features (tag, words of its class, id and role, text length, link share,
punctuation); parent-child potentials connect the labels along the tree.
Sum-product message passing, one upward and one downward sweep, gives exact
content marginals; a run is kept when its marginal is at least one half. The
weights maximise the conditional likelihood of labelled pages: templates below
whose content is marked with ``data-y``, filled with words of varying number.
Training takes a second on the driver and does not depend on the input.

Whole batches of pages form one forest, swept level by level with numpy.

Defined results: null and empty html give an empty text; broken markup is
closed at its ancestors or at the end of the page; text outside any element is
a run of the page; pages are independent, so repeated rows give equal texts;
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm.dom import ATTRIBUTE, Forest, parse
from textpairs.llm.pieces import by_size

#: Words in class, id and role that hint at a part of the page.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager topbar",
    "head": "header masthead banner logo branding hero",
    "foot": "footer copyright colophon legal",
    "side": "sidebar aside rail widget related recommended trending popular secondary complementary",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense",
    "notice": "cookie consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall disclaimer",
    "form": "form login search searchbox register contact input",
    "comment": "comment comments disqus reply replies respond discussion reactions reviews",
    "share": "share social sharing follow tags meta byline author",
    "main": "article content main post entry story body text prose page-content articlebody",
}
_HINT_OF = {w: kind for kind, words in HINTS.items() for w in words.split()}
_WORD = re.compile(r"[a-z]+")
_TAGS = ["#page", "#run", *"""html body address article aside blockquote dd details div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre section table tbody td th tr ul button caption""".split()]
FEATURES = {name: i for i, name in enumerate(
    [f"tag={t}" for t in _TAGS] + ["tag=other"] + [f"hint={h}" for h in HINTS] + ["hidden"]
    + [f"chars={k}" for k in range(5)] + [f"links={k}" for k in range(4)] + ["sentence", "comma", "digits", "run-in=heading", "run-in=p",
                                                                             "run-in=li", "run-in=cell", "run-in=box", "bias"])}
_RUN_IN = {**{f"h{k}": "heading" for k in range(1, 7)}, "p": "p", "blockquote": "p", "pre": "p", "li": "li", "dd": "li", "dt": "li",
           "td": "cell", "th": "cell"}
_EDGE_KINDS = 2  # to an element, to a run


def _attribute_features(attributes: str) -> list[str]:
    out = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name in ("class", "id", "role", "itemprop"):
            words = [*_WORD.findall(value), *value.split()]
            out |= {"hint=" + _HINT_OF[w] for w in words if w in _HINT_OF}
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            out.add("hidden")
    return sorted(out)


def _node_features(forest: Forest, i: int, memo: dict[str, list[str]]) -> list[int]:
    tag = forest.tag[i]
    names = ["bias", f"tag={tag}" if f"tag={tag}" in FEATURES else "tag=other"]
    attributes = forest.attributes[i]
    if attributes:
        if attributes not in memo:
            if len(memo) > 50_000:
                memo.clear()
            memo[attributes] = _attribute_features(attributes)
        names += memo[attributes]
    if tag == "#run":
        text = forest.text[i]
        n = len(text)
        names.append(f"chars={(n >= 20) + (n >= 60) + (n >= 160) + (n >= 400)}")
        share = forest.link_chars[i] / n
        names.append(f"links={(share > 0) + (share > 0.4) + (share > 0.8)}")
        if text[-1] in ".!?…:;\"”":
            names.append("sentence")
        if "," in text:
            names.append("comma")
        if text[0].isdigit():
            names.append("digits")
        names.append("run-in=" + _RUN_IN.get(forest.tag[forest.parent[i]], "box"))
    return [FEATURES[f] for f in names]


@dataclass
class Tree:
    """Arrays of a forest: levels from the roots down, and flat node features."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    node: np.ndarray
    feature: np.ndarray


def arrays(forest: Forest) -> Tree:
    memo: dict[str, list[str]] = {}
    rows = [_node_features(forest, i, memo) for i in range(len(forest.parent))]
    depth = np.array(forest.depth, dtype=np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    return Tree(np.array(forest.parent, dtype=np.int64), levels, np.array([t == "#run" for t in forest.tag], dtype=np.int64),
                np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([f for r in rows for f in r], dtype=np.int64))


@dataclass
class TreeModel:
    unary: np.ndarray  # weight of each feature for the label "content"
    pair: np.ndarray  # log potentials [kind of child][label of parent][label of child]


def marginals(tree: Tree, model: TreeModel) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(content) of every node, pair marginals [node][parent][child], log partition): sum-product."""
    n = len(tree.parent)
    unary = np.zeros((n, 2))
    unary[:, 1] = np.bincount(tree.node, weights=model.unary[tree.feature], minlength=n)
    pair = model.pair[tree.kind]
    inside = unary.copy()  # own potential and all messages from children
    up = np.zeros((n, 2))  # message to the parent
    for level in reversed(tree.levels[1:]):
        up[level] = np.logaddexp.reduce(pair[level] + inside[level][:, None, :], axis=2)
        for label in (0, 1):
            inside[:, label] += np.bincount(tree.parent[level], weights=up[level, label], minlength=n)
    belief = inside.copy()
    pairs = np.zeros((n, 2, 2))
    for level in tree.levels[1:]:
        outside = belief[tree.parent[level]] - up[level]  # the parent without this child
        joint = outside[:, :, None] + pair[level] + inside[level][:, None, :]
        belief[level] = np.logaddexp.reduce(joint, axis=1)
        pairs[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
    total = np.logaddexp(belief[:, 0], belief[:, 1])
    roots = tree.levels[0] if tree.levels else np.zeros(0, dtype=np.int64)
    return np.exp(belief[:, 1] - total), pairs, float(np.logaddexp.reduce(inside[roots], axis=1).sum())


def train(tree: Tree, labels: np.ndarray, rounds: int = 400, l2: float = 0.0003) -> TreeModel:
    """Maximum conditional likelihood: observed minus expected features (Adam)."""
    model = TreeModel(np.zeros(len(FEATURES)), np.zeros((_EDGE_KINDS, 2, 2)))
    child = np.flatnonzero(tree.parent >= 0)
    seen_pair = np.zeros_like(model.pair)
    np.add.at(seen_pair, (tree.kind[child], labels[tree.parent[child]], labels[child]), 1.0)
    seen = np.bincount(tree.feature, weights=labels[tree.node].astype(float), minlength=len(FEATURES))
    size = len(tree.parent)
    m = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    v = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    for t in range(1, rounds + 1):
        p, pairs, _ = marginals(tree, model)
        expected_pair = np.zeros_like(model.pair)
        np.add.at(expected_pair, tree.kind[child], pairs[child])
        gradients = [(seen - np.bincount(tree.feature, weights=p[tree.node], minlength=len(FEATURES))) / size - l2 * model.unary,
                     (seen_pair - expected_pair) / size - l2 * model.pair]
        for k, (w, g) in enumerate(zip((model.unary, model.pair), gradients, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w += 0.1 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


#: Labelled pages: ``data-y`` marks content (1) and parts inside content that are not (0).
#: {s}: a few words, {m}: a sentence, {l}: a paragraph.
LABELLED_PAGES = [
    """<html><body><nav><ul><li><a>{s}</a></li><li><a>{s}</a></li><li><a>{s}</a></li></ul></nav><div class="ad">{m}</div>
    <article data-y="1"><h1>{s}</h1><p>{l}</p><p>{m}</p><p>{s}</p><p>{l}</p></article><footer>{m} {s}</footer></body></html>""",
    """<html><body><header><h1>{s}</h1><p>{m}</p></header><nav><a>{s}</a><a>{s}</a></nav><main data-y="1"><h2>{s}</h2><p>{m}</p>
    <ul><li>{m}</li><li>{s}</li><li>{m}</li></ul><p>{l}</p><blockquote><p>{m}</p></blockquote></main>
    <aside><h3>{s}</h3><ul><li><a>{s}</a></li><li><a>{m}</a></li></ul></aside><footer><p>{m}</p></footer></body></html>""",
    """<html><body><div id="header">{s}</div><div class="menu"><a>{s}</a> <a>{s}</a></div><div id="content" data-y="1"><h1>{m}</h1>
    {l}<p>{l}</p><div>{m}</div><p>{s}</p></div><div class="sidebar"><p>{m}</p><p>{l}</p></div>
    <div id="comments"><h3>{s}</h3><div class="comment"><p>{l}</p></div><div class="comment"><p>{m}</p></div></div>
    <div id="footer">{m}</div></body></html>""",
    """<html><body><div class="cookie-notice"><p>{m}</p><button>{s}</button></div><div class="navbar"><ul><li><a>{s}</a></li></ul></div>
    <section class="post" data-y="1"><h1>{s}</h1><p>{l}</p><table><tr><th>{s}</th><td>{s}</td></tr><tr><th>{s}</th><td>{m}</td></tr></table>
    <pre>{m}</pre><p>{l}</p><div class="share" data-y="0"><a>{s}</a><a>{s}</a></div></section>
    <form><label>{s}</label><p>{m}</p><button>{s}</button></form><section class="comments"><p>{l}</p><p>{m}</p></section></body></html>""",
    """<html><body><article data-y="1"><header><h1>{s}</h1></header><p>{m}</p><figure><figcaption>{s}</figcaption></figure><p>{l}</p>
    <aside class="related" data-y="0"><p>{m}</p><ul><li><a>{s}</a></li></ul></aside><p>{l}</p><p>{m}</p>
    <div class="advert" data-y="0">{m}</div><h2>{s}</h2><p>{l}</p></article><div class="newsletter"><p>{m}</p><form><p>{s}</p></form></div>
    <footer><ul><li><a>{s}</a></li><li>{s}</li></ul></footer></body></html>""",
    """<html><body><div role="banner"><p>{s}</p></div><div role="navigation"><p><a>{s}</a></p></div><div role="main" data-y="1"><p>{l}</p><p>{l}</p>
    <dl><dt>{s}</dt><dd>{m}</dd></dl><ol><li>{l}</li><li>{m}</li></ol></div><div role="complementary"><p>{l}</p></div>
    <div role="contentinfo" class="footer"><p>{m}</p></div></body></html>""",
    """<html><body><div class="alert">{m}</div><div><div class="entry" data-y="1"><h1>{s}</h1><div>{l}</div><div>{m}</div><div>{l}</div></div>
    <div class="widget"><div>{m}</div><div>{s}</div></div></div><div class="disqus"><div>{l}</div><div>{m}</div></div></body></html>""",
    """<html><body><nav><p>{m}</p></nav><article data-y="1"><p>{m}</p></article><article data-y="1"><h1>{s}</h1><p>{s}</p></article>
    <article data-y="1"><h1>{s}</h1><p><a>{s}</a></p><p>{l}<a>{s}</a></p></article><div class="ad"><p>{l}</p></div><aside><p>{l}</p></aside>
    <footer>{l}</footer></body></html>""",
    """<html><body><p data-y="1">{l}</p><p data-y="1">{l}</p><h2 data-y="1">{s}</h2><p data-y="1">{m}</p><div class="footer">{m}</div></body></html>""",
    """<html><body><header class="site-header">{s}<form><p>{s}</p></form></header><div class="banner">{l}</div>
    <article data-y="1"><h1>{l}</h1><p>{s}</p></article><div class="reply"><p>{l}</p></div><div id="respond"><form><p>{m}</p></form></div>
    <div class="subscribe">{m}</div><div hidden><p>{m}</p></div></body></html>""",
]
_FILL_WORDS = "river stone market early found their people quiet morning letter between number garden winter travel open paper light".split()


def _fill(template: str, rnd: random.Random) -> str:
    def words(low: int, high: int) -> str:
        return " ".join(rnd.choice(_FILL_WORDS) for _ in range(rnd.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        text = words(low, high).capitalize()
        return text + (", " + words(2, 6) if rnd.random() < 0.5 else "") + (rnd.choice(".!?") if rnd.random() < 0.8 else "")

    def part(m: re.Match) -> str:
        kind = m.group(1)
        if kind == "s":
            return sentence(1, 5) if rnd.random() < 0.4 else words(1, 4)
        return sentence(5, 20) if kind == "m" else " ".join(sentence(4, 25) for _ in range(rnd.randint(2, 8)))

    return re.sub(r"\{([sml])\}", part, template)


def labelled_forest(fills: int = 8, seed: int = 11) -> tuple[Forest, np.ndarray]:
    """The labelled pages, each filled ``fills`` times, and the label of every node."""
    forest, rnd = Forest(), random.Random(seed)
    for k, template in enumerate(LABELLED_PAGES * fills):
        parse(forest, k, _fill(template, rnd))
    labels = np.zeros(len(forest.parent), dtype=np.int64)
    for i, parent in enumerate(forest.parent):
        mark = re.search(r'data-y="([01])"', forest.attributes[i])
        labels[i] = int(mark.group(1)) if mark else labels[parent] if parent >= 0 else 0
    return forest, labels


_TRAINED: list[TreeModel] = []


def default_model() -> TreeModel:
    """The model of the labelled pages, trained once per driver process."""
    if not _TRAINED:
        forest, labels = labelled_forest()
        _TRAINED.append(train(arrays(forest), labels))
    return _TRAINED[0]


def extract_many(pages: list[str], model: TreeModel) -> list[str]:
    """Main text of each page: kept runs in page order, joined by two line ends."""
    forest = Forest()
    for k, page in enumerate(pages):
        parse(forest, k, page)
    kept: list[list[str]] = [[] for _ in pages]
    if forest.parent:
        content, _, _ = marginals(arrays(forest), model)
        for i in np.flatnonzero(content >= 0.5).tolist():
            if forest.tag[i] == "#run":
                kept[forest.page[i]].append(forest.text[i])
    return ["\n\n".join(k) for k in kept]


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", model: TreeModel | None = None) -> DataFrame:
    """``df`` with the main text of each page."""
    trained = model or default_model()

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t for group in by_size(batch.to_pylist(), 1 << 21) for t in extract_many(group, trained)], type=pa.string())

    return df.withColumn(text_col, main_text(F.coalesce(F.col(html_col), F.lit(""))))
