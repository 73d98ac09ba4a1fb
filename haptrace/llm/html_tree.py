"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements with the runs of text in them as leaves. Each node is
content or not: node potentials come from tag, class words, text length, links and punctuation,
parent-child potentials from the kinds of both. Sum-product messages go up the tree and down again,
for all pages of a batch level by level, and give each node's content marginal; leaves of 0.5 or more
are the text. An element counts as content if anything in it is, so content under a node that
isn't has next to no potential, and a whole menu or comment section falls at once.

The model is fitted by the gradient of the likelihood on labelled pages: pages composed of labelled
regions (``composed_pages``), and a bounded sample of the table's own pages, whose leaves are labelled by
their semantic elements (inside ``article`` or ``main`` but not in navigation, asides, forms and the like).

Defined results
* Null or empty html, and html without text, give the empty text. Markup may be broken: end tags
  without start are ignored, open elements end with the page, ``p``, ``li`` and the like end as HTML says.
* Scripts, styles, templates, head, comments and declarations are never text. Character references
  are decoded, white space (as Unicode has it) in a block becomes one space, blocks are joined by one.
* Rows are independent; repeated rows get equal texts; an empty table gives an empty result; result
  columns replace those of the same name, other columns stay. Null urls stay null.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SAMPLE_PAGES = 200
SAMPLE_CHARS = 60_000
COMPOSED_PAGES = 1000
EPOCHS = 100
BATCH_CHARS = 3_000_000

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page. Without an end tag the first ones take the rest of the page, the others only their tag.
TO_THE_END = frozenset(("script", "style", "textarea", "title", "template"))
RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select")}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
            "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("html body table td th ul ol dl article section div main aside nav form".split())
GROUPS = {"article": 0, "main": 0, "html": 1, "body": 1, "div": 2, "section": 2, "nav": 3, "aside": 3, "footer": 3, "form": 3, "ul": 4, "ol": 4, "dl": 4, "table": 4}
GROUP_COUNT = 6
CONTENT, OTHER = "\ue001", "\ue000"


class Tree:
    """Nodes in page order: parent, depth, tag, features, and for leaves the text."""

    __slots__ = ("depth", "features", "leaf_text", "link_chars", "parent", "tag", "text_chars")

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.features: list[list[str]] = []
        self.leaf_text: list[str | None] = []
        self.text_chars: list[int] = []
        self.link_chars: list[int] = []

    def add(self, parent: int, tag: str, features: list[str], text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.features.append(features)
        self.leaf_text.append(text)
        self.text_chars.append(0)
        self.link_chars.append(0)
        return len(self.parent) - 1


def class_words(attributes: str) -> list[str]:
    """Words of class, id, role and the like, in lower case, and marks for hidden elements."""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            found += [f"c:{w.lower()}" for w in TOKEN.findall(value)]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.append("c:(hidden)")
    return found


def parse(page: str | None) -> Tree:
    """The tree of a page; leaves hold decoded text with white space made single."""
    tree = Tree()
    node = tree.add(-1, "(page)", ["t:(page)"])
    open_tags: list[tuple[str, int]] = [("(page)", node)]  # with the block node that is current inside
    opened: Counter[str] = Counter()  # how often each tag stands in ``open_tags``
    endless: set[str] = set()  # raw elements that no later end tag closes
    words: list[str] = []
    linked = links = 0
    page = page or ""
    # No tag ends beyond the last ">"; what follows is text, or a comment that never ends.
    last = page.rfind(">") + 1
    open_comment = re.compile("<[!?]").search(page, last)
    page = page[:open_comment.start()] if open_comment else page

    def flush() -> None:
        nonlocal words, linked
        text = " ".join("".join(words).split())
        if text:
            block = open_tags[-1][1]
            leaf = tree.add(block, "(text)", [], text)
            tree.text_chars[leaf] = len(text)
            tree.link_chars[leaf] = min(linked, len(text))
        words, linked = [], 0

    def close(at: int) -> None:
        """Ends the elements from the place ``at`` of the stack on."""
        nonlocal links
        if any(t not in INLINE for t, _ in open_tags[at:]):
            flush()
        for t, _ in open_tags[at:]:
            links -= t == "a"
            opened[t] -= 1
        del open_tags[at:]

    def last_open(tags: tuple[str, ...], bounds: frozenset) -> int:
        if not any(opened[t] > 0 for t in tags):
            return 0
        for at in range(len(open_tags) - 1, 0, -1):
            if open_tags[at][0] in tags:
                return at
            if open_tags[at][0] in bounds:
                return 0
        return 0

    at = 0
    while True:
        mark = TAG.search(page, at, last)
        text = page[at: mark.start()] if mark else page[at:]
        if text:
            text = html_lib.unescape(text) if "&" in text else text
            words.append(text)
            if links:
                linked += len(text)
        if not mark:
            break
        at = mark.end()
        tag = mark[2]
        if tag is None:
            if mark[0].startswith("<!--") and not mark[0].endswith("-->"):
                break
            continue
        tag = tag.lower()
        if mark[1]:
            if tag == "p" and not last_open(("p",), frozenset(("table", "td", "th"))):
                flush()
                continue
            place = next((i for i in range(len(open_tags) - 1, 0, -1) if open_tags[i][0] == tag), 0) if opened[tag] > 0 else 0
            if place:
                close(place)
            continue
        if tag in RAW:
            if tag == "svg" and mark[3].endswith("/"):
                continue
            end = None if tag in endless else RAW[tag].search(page, at)
            if end is None:
                endless.add(tag)
                if tag not in TO_THE_END:
                    continue
            at = TAG.search(page, end.start()).end() if end and TAG.match(page, end.start()) else (end.end() if end else len(page))
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID:
                open_tags.append((tag, open_tags[-1][1]))
                opened[tag] += 1
                links += tag == "a"
            continue
        if tag == "head":
            end = re.compile(r"</head\b|<body\b", re.I).search(page, at)
            if end:
                at = end.start()
                continue
        if tag in CLOSES_P and (place := last_open(("p",), frozenset(("table", "td", "th", "button")))):
            close(place)
        if tag in SIBLINGS and (place := last_open(SIBLINGS[tag], SCOPE - set(SIBLINGS[tag]) if tag not in ("td", "th") else frozenset(("tr", "table")))):
            close(place)
        flush()
        if tag in VOID:
            continue
        words_of_class = class_words(mark[3]) if mark[3].strip(" /") else []
        block = tree.add(open_tags[-1][1], tag, [f"t:{tag}", *words_of_class])
        if not mark[3].endswith("/"):
            open_tags.append((tag, block))
            opened[tag] += 1
    flush()
    _finish(tree)
    return tree


def _bucket(n: int) -> int:
    return min(9, int(math.log2(n + 1)))


def _finish(tree: Tree) -> None:
    """Sums over subtrees, and the features that need them."""
    for n in range(len(tree.parent) - 1, 0, -1):
        tree.text_chars[tree.parent[n]] += tree.text_chars[n]
        tree.link_chars[tree.parent[n]] += tree.link_chars[n]
    for n, features in enumerate(tree.features):
        chars, parent = tree.text_chars[n], tree.parent[n]
        share = f"{min(3, int(4 * tree.link_chars[n] / chars))}" if chars else "-"
        text = tree.leaf_text[n]
        if text is None:
            features += [f"e:{_bucket(chars) // 2}", f"l:{share}", f"tl:{tree.tag[n]}{share}"]
        else:
            stops = text.count(".") + text.count(",") + text.count(";") + text.count("?") + text.count("!")
            features += [
                f"x:{_bucket(chars)}", f"y:{share}", f"in:{tree.tag[parent]}", f"s:{min(3, stops)}", f"z:{'stop' if text[-1] in '.!?:;\"”»' else 'none'}",
                *(["o:copyright"] if "©" in text else [])]


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray  # kind, parent's label, child's label


def pair_kinds(trees: list[Tree]) -> np.ndarray:
    """Kind of each node's tie to its parent: the parent's group, and whether the node is a leaf."""
    kinds = [[(GROUPS.get(t.tag[p], 5) * 2 + (text is not None)) if p >= 0 else 0 for p, text in zip(t.parent, t.leaf_text)] for t in trees]
    return np.array([k for ks in kinds for k in ks], dtype=np.int64)


class Forest:
    """Many trees in one set of arrays, by levels."""

    def __init__(self, trees: list[Tree], names: dict[str, int], grow: bool = False):
        sizes = np.array([len(t.parent) for t in trees], dtype=np.int64)
        shift = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.parent = np.array([p for t in trees for p in t.parent], dtype=np.int64) + shift
        depth = np.array([d for t in trees for d in t.depth], dtype=np.int64)
        self.kind = pair_kinds(trees)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.size = len(depth)
        nodes, features = [], []
        at = 0
        for t in trees:
            for found in t.features:
                for f in found:
                    k = names.setdefault(f, len(names)) if grow else names.get(f, -1)
                    if k >= 0:
                        nodes.append(at)
                        features.append(k)
                at += 1
        self.nodes, self.features = np.array(nodes, dtype=np.int64), np.array(features, dtype=np.int64)

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of content of each node, and of (parent's, own) labels, by sum-product up and down."""
        own = np.zeros((self.size, 2))
        own[:, 1] = np.clip(np.bincount(self.nodes, weights[self.features], minlength=self.size), -40, 40)
        tie = pairs[self.kind]
        below = own.copy()  # own potential and all messages from the children
        up = np.zeros((self.size, 2))
        for level in self.levels[:0:-1]:
            joint = tie[level] + below[level][:, None, :]
            message = _log_sum(joint, 2)
            up[level] = message - message.max(axis=1, keepdims=True)
            np.add.at(below, self.parent[level], up[level])
        belief = below.copy()
        both = np.zeros((self.size, 2, 2))
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - up[level]
            joint = tie[level] + rest[:, :, None]
            down = _log_sum(joint, 1)
            belief[level] = below[level] + down - down.max(axis=1, keepdims=True)
            joint = joint + below[level][:, None, :]
            both[level] = np.exp(joint - _log_sum(_log_sum(joint, 2), 1)[:, None, None])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), both


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def node_labels(tree: Tree, leaf_labels: dict[int, int]) -> list[int]:
    labels = [leaf_labels.get(n, 0) for n in range(len(tree.parent))]
    for n in range(len(labels) - 1, 0, -1):
        labels[tree.parent[n]] |= labels[n]
    return labels


def train(trees: list[Tree], labels: list[list[int]], epochs: int = EPOCHS) -> Model:
    names: dict[str, int] = {}
    forest = Forest(trees, names, grow=True)
    y = np.array([v for ls in labels for v in ls], dtype=np.int64)
    inner = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.zeros(0, dtype=np.int64)
    seen = np.zeros((GROUP_COUNT * 2, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    value = {"w": np.zeros(len(names)), "p": np.tile(np.array([[0.0, -3.0], [0.0, 0.0]]), (GROUP_COUNT * 2, 1, 1))}
    first, second = ({k: np.zeros_like(v) for k, v in value.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        chance, both = forest.marginals(value["w"], value["p"])
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[inner], both[inner])
        slope = {"w": np.bincount(forest.features, (y - chance)[forest.nodes], minlength=len(names)) - 0.05 * value["w"], "p": seen - expected - 0.05 * value["p"]}
        for k in value:
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.99 * second[k] + 0.01 * slope[k] ** 2
            value[k] = value[k] + 0.2 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Model(names, value["w"], value["p"])


def composed_pages(count: int = COMPOSED_PAGES, seed: int = 5) -> list[str]:
    """Pages put together from labelled regions; the first character of each text tells its label."""
    rng = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "que", "ch", "ist", "le", "mo", "ra", "sé", "für"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 5)))
    some = lambda low, high: " ".join(word() for _ in range(rng.randrange(low, high)))
    sentence = lambda: some(4, 18).capitalize() + rng.choice([".", ".", ".", "?", "!", ", " + some(2, 6) + "."])
    text = lambda: " ".join(sentence() for _ in range(rng.randrange(1, 7)))
    short = lambda: rng.choice([some(1, 5), some(1, 4).capitalize() + ".", sentence()])
    link = lambda: f'<a href="/{word()}">{OTHER}{some(1, 4)}</a>'
    items = lambda tag="ul": f"<{tag}>" + "".join(f"<li>{link()}" + rng.choice(["</li>", "</li>", ""]) for _ in range(rng.randrange(2, 9))) + f"</{tag}>"

    def named(tag: str, names: str, inside: str) -> str:
        name = rng.choice(names.split())
        kind = rng.choice(["class", "class", "id", "role"])
        extra = rng.choice(["", "", f" {word()}", f"-{word()}", f"_{rng.randrange(99)}"])
        return f'<{tag} {kind}="{name}{extra if kind == "class" else ""}">{inside}</{tag}>'

    def passage() -> str:
        body = CONTENT + rng.choice([text, text, sentence, short])()
        if rng.random() < 0.2:
            body += f' <a href="#">{some(1, 3)}</a> ' + some(1, 9) + "."
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{body}" + ("</p>" if rng.random() < 0.9 else "")
        if kind < 0.76:
            return f"<p><b>{body}<br>" + rng.choice(["</p>", "", "</b></p>"])
        if kind < 0.82:
            return f"<h{rng.randrange(2, 5)}>{CONTENT}{some(1, 9)}</h2>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{CONTENT}{rng.choice([sentence, short])()}</li>" for _ in range(rng.randrange(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.94:
            return f"<pre>{CONTENT}{some(3, 20)}</pre>"
        if kind < 0.96:
            return named("div", "text paragraph content block section body", rng.choice([body, f"<p>{body}</p>"])) if rng.random() < 0.5 else f"<div>{body}</div>"
        if kind < 0.98:
            return "<table>" + "".join(f"<tr><td>{CONTENT}{some(1, 4)}<td>{CONTENT}{some(1, 3)}</tr>" for _ in range(rng.randrange(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{CONTENT}{sentence()}</figcaption></figure>"

    def out(n: int = 1) -> str:
        """Regions that are no content."""
        say = lambda: OTHER + rng.choice([text, sentence, sentence, short])()
        box = lambda: rng.choice([say(), f"<p>{say()}</p>", f"<p>{say()}</p><p>{say()}</p>", f"<div>{say()}</div>", items(), f"<h3>{OTHER}{some(1, 4)}</h3>" + items(), f"<h4>{OTHER}{some(1, 3)}</h4><p>{say()}</p>"])
        made = [
            lambda: f"<nav>{items()}</nav>", lambda: named("div", "nav navbar menu navigation breadcrumbs breadcrumb topbar", items()),
            lambda: named("ul", "menu nav navigation breadcrumb pagination pager tags", "".join(f"<li>{link()}</li>" for _ in range(4))),
            lambda: f"<aside>{box()}</aside>", lambda: named(rng.choice(["div", "section", "aside"]), "sidebar widget related recommended trending more rail", box()),
            lambda: named(rng.choice(["div", "section", "aside", "p"]), "ad ads advert advertisement sponsored sponsor promo banner", say()),
            lambda: named("div", "ad ads advert advertisement sponsored promo banner adbox", box()),
            lambda: named(rng.choice(["div", "section", "p"]), "notice cookie cookies consent alert gdpr warning disclaimer message", say() + rng.choice(["", f"<button>{OTHER}{some(1, 2)}</button>"])),
            lambda: named("div", "notice cookie-notice consent banner alert paywall subscribe newsletter popup modal", box()),
            lambda: f"<form action='/x'>{rng.choice(['', '<p>'])}{say()}<input name=q><label>{OTHER}{some(1, 3)}</label><button>{OTHER}{some(1, 2)}</button></form>",
            lambda: named("div", "share social sharing follow tools toolbar author-box", items()),
            lambda: named(rng.choice(["div", "section", "ol", "aside"]), "comments comment comment-list discussion replies responses disqus", "".join(
                rng.choice([f"<p>{say()}</p>", f'<div class="comment"><b>{OTHER}{word()}</b><p>{say()}</p></div>', f"<li>{say()}</li>", f"<article class=comment><p>{say()}</p></article>"]) for _ in range(rng.randrange(1, 5)))),
        ]
        return "".join(rng.choice(made)() for _ in range(n))

    def page() -> str:
        top = rng.choice([
            lambda: f"<header><h2>{OTHER}{some(1, 4)}</h2>" + rng.choice(["", out(), f"<p>{OTHER}{sentence()}</p>"]) + "</header>",
            lambda: named("div", "header masthead site-header topbar", f"<h1>{OTHER}{some(1, 4)}</h1>" + rng.choice(["", items()])), lambda: f"<nav>{items()}</nav>", lambda: ""])()
        end = rng.choice([
            lambda: f"<footer>{OTHER}&copy; {word()}.example.com &middot; {sentence()}</footer>", lambda: f"<footer><p>{OTHER}{text()}</p>{items()}</footer>",
            lambda: named("div", "footer bottom colophon copyright legal site-footer", f"<p>{OTHER}{rng.choice(['&copy; ', ''])}{text()}</p>"), lambda: ""])()
        body = "".join(passage() + (out() if rng.random() < 0.07 else "") for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])))
        title = f"<h1>{CONTENT}{some(1, 12)}</h1>"
        if rng.random() < 0.15:
            title = f"<header>{title}</header>"
        if rng.random() < 0.1:
            body = f"<section>{body}</section>"
        body = rng.choice([title, title, title, ""]) + body + (out() if rng.random() < 0.25 else "")
        if rng.random() < 0.15:
            body += f"<footer>{OTHER}{sentence()}</footer>"
        frame = rng.random()
        if frame < 0.4:
            body = f"<article>{body}</article>"
        elif frame < 0.55:
            body = f"<main>{body}</main>"
        elif frame < 0.65:
            body = f"<main><article>{body}</article>{out() if rng.random() < 0.4 else ''}</main>"
        elif frame < 0.9:
            body = named("div", "content article post entry story main text body post-content entry-content article-body page-content", body)
        else:
            body = f"<div>{body}</div>"
        if rng.random() < 0.3:
            body = named("div", "container wrapper page row layout site col", body + (out() if rng.random() < 0.5 else ""))
        inside = f"{top}{out(rng.randrange(0, 3))}{body}{out(rng.randrange(0, 3))}{end}"
        if rng.random() < 0.15:
            return rng.choice([inside, f"<body>{inside}", named("div", "wrap wrapper page root app", inside)])
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{inside}" + rng.choice(["</body></html>", ""])

    return [page() for _ in range(count)]


def composed_examples(pages: list[str]) -> tuple[list[Tree], list[list[int]]]:
    trees, labels = [], []
    for page in pages:
        tree = parse(page)
        told = {n: int(CONTENT in t) for n, t in enumerate(tree.leaf_text) if t is not None}
        labels.append(node_labels(tree, told))
        # The marks were parsed as text; the features are those of the page without them.
        trees.append(parse(page.replace(CONTENT, "").replace(OTHER, "")))
        if len(trees[-1].parent) != len(labels[-1]):
            trees.pop()
            labels.pop()
    return trees, labels


NEVER = frozenset("nav aside footer form button fieldset dialog menu".split())
NEVER_WORDS = re.compile(r"^c:(ads?|advert\w*|sponsor\w*|promo\w*|banner|notice|cookies?|consent|alert|sidebar|comments?|share|social|related|newsletter|subscribe|menu|nav\w*|footer|popup|modal)$")


def semantic_labels(tree: Tree) -> list[int] | None:
    """Labels of a page by its semantic elements; none without ``article`` or ``main``."""
    inside, told = [0] * len(tree.parent), {}
    roots = [n for n, t in enumerate(tree.tag) if t in ("article", "main")]
    if not roots:
        return None
    for n, tag in enumerate(tree.tag):
        before = inside[tree.parent[n]] if n else 0
        out = tag in NEVER or any(NEVER_WORDS.match(f) for f in tree.features[n])
        inside[n] = -1 if before < 0 or out else int(before or tag in ("article", "main"))
        if tree.leaf_text[n] is not None:
            told[n] = int(inside[n] == 1)
    return node_labels(tree, told)


def fit(pages: list[str], epochs: int = EPOCHS, composed: int = COMPOSED_PAGES) -> Model:
    """On composed pages and on those of ``pages`` that label themselves."""
    trees, labels = composed_examples(composed_pages(composed))
    for page in pages:
        tree = parse(page)
        own = semantic_labels(tree)
        if own is not None:
            trees.append(tree)
            labels.append(own)
    return train(trees, labels, epochs)


def sample(pages: DataFrame, id_col: str, html_col: str, count: int = SAMPLE_PAGES) -> list[str]:
    """About ``count`` pages of at most ``SAMPLE_CHARS`` characters, in a fixed order."""
    total = pages.count()
    chance = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = pages.filter(chance < min(1.0, count / max(1, total))).filter(F.length(html_col) <= SAMPLE_CHARS).select(F.col(html_col).alias("html")).collect()
    return sorted(r["html"] for r in rows)


def contents(trees: list[Tree], model: Model) -> list[str]:
    """Joined text of the leaves that are content, per page."""
    if not trees:
        return []
    chance, _ = Forest(trees, model.names).marginals(model.weights, model.pairs)
    out, at = [], 0
    for tree in trees:
        size = len(tree.parent)
        kept = chance[at: at + size] >= 0.5
        out.append(" ".join(t for t, k in zip(tree.leaf_text, kept.tolist()) if k and t is not None))
        at += size
    return out


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""
    from haptrace.llm.bpe import bounded

    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in kept]).add("text", T.StringType()).add("n_chars", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch, len(kept), BATCH_CHARS):
                texts = contents([parse(p) for p in piece.column(len(kept)).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col)).mapInArrow(run, schema)
