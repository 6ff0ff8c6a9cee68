"""Main-text extraction with a tree-structured graphical model over the DOM.

A page becomes a tree of block elements.  Each node has a label, content or not;
its own features give a unary potential, every parent-child edge a pairwise one.
Sum-product messages go from the leaves to the root and back, and a node's text
is kept where its content marginal is at least one half.  Unary and edge
potentials are learned from labelled pages by maximum likelihood; ``labelled_pages`` makes a bounded set of them from page
layouts with marked content.

Broken markup is accepted, in linear time: missing end tags are implied, stray ones ignored and
unclosed pages closed; a tag ends at the first ``>`` outside of a quoted value (where a quote is never
closed, at the first one after it), or else with the page.  A null or empty page has an empty text.  Rows are
independent, so repeated rows and null ids or urls pass through.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, slices, strings, table, text_of

#: Layouts the model is trained on, a bounded set: with names on their elements, and without any.
TRAINING_PAGES, NAMELESS_PAGES = 700, 250

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped with all they hold: code, what isn't rendered, and form controls.  All else is left to the model.
RAW = frozenset("script style textarea title iframe template noembed noframes select".split())
#: Elements whose content is text without tags.
PLAIN = frozenset(["xmp"])
#: Elements of other vocabularies, inline with what they hold; for them and in them alone a closing slash ends an element at its own tag.
FOREIGN = frozenset(["svg", "math"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input ruby rt rp nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "names", "hidden", "label", "size", "linked", "runs", "below", "depth", "sentences", "up", "bare")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...], hidden: bool, label: int | None, depth: int):
        self.tag, self.parent, self.names, self.hidden, self.label, self.depth = tag, parent, names, hidden, label, depth
        self.up, self.bare = "", False
        self.size = self.linked = self.runs = self.below = self.sentences = 0


class Scanner:
    """Finds ends in one page; what it failed to find once, it doesn't look for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        """The next place of ``what``, or the page's length."""
        found = -1 if what in self.gone else self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found if found >= 0 else len(self.page)

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``."""
        while found := _TAG_STOP.search(self.page, at):
            if not found[1]:
                return found.start()
            close = self.find(found[1], found.end())
            if close == len(self.page):
                return self.find(">", found.end())
            at = close + 1
        return len(self.page)

    def close_of(self, tag: str, at: int) -> tuple[int, int] | None:
        """Begin and end of the next end tag of an element whose content isn't markup."""
        found = None if tag in self.gone else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(self.page, at)
        if not found:
            self.gone.add(tag)
            return None
        return found.start(), min(len(self.page), self.find(">", found.end()) + 1)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements of a page, parents first, and its texts (node, text) in page order."""
    nodes, blocks, buffer = [Node("#root", -1, (), False, None, 0)], [], []
    stack: list[tuple[str, int, int]] = [("#root", 0, 0)]  # open elements: inline ones carry their block's node; the last is the nearest entry that isn't inline
    places: dict[str, list[int]] = {}  # of the open elements of a tag
    scanner = Scanner(page)

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", htmllib.unescape("".join(buffer)) if any("&" in x for x in buffer) else "".join(buffer)).strip()
            buffer.clear()
            if text:
                at = stack[-1][1]
                node = nodes[at]
                node.size += len(text)
                node.runs += 1
                node.sentences += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
                blocks.append((at, text))

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, stack[-1][2] if tag in INLINE else len(stack)))

    def pop(to: int) -> None:
        if any(stack[k][1] != stack[k - 1][1] for k in range(to, len(stack))):
            flush()
        for t, _, _ in stack[to:]:
            places[t].pop()
        del stack[to:]

    def nearest(tags: frozenset[str] | set[str]) -> int:
        """The place of the innermost open element of these; 0 where there is none."""
        return max((own[-1] for t in tags if (own := places.get(t))), default=0)

    def add_text(text: str) -> None:
        if text:
            buffer.append(text)
            if places.get("a"):
                nodes[stack[-1][1]].linked += len(text)

    at, end = 0, len(page)
    while at < end:
        begin = scanner.find("<", at)
        add_text(page[at:begin])
        if begin == end:
            break
        found = _TAG.match(page, begin)
        if not found:
            if page.startswith("<!--", begin):
                at = scanner.find("-->", begin + 2) + 3
            elif page.startswith(("<!", "<?", "</"), begin):
                at = scanner.find(">", begin) + 1
            else:
                add_text("<")
                at = begin + 1
            continue
        at = scanner.tag_end(found.end()) + 1
        tag, rest = found[1].lower(), page[found.end() : at - 1]
        if page[begin + 1] == "/":
            own = places.get(tag)
            if own:
                pop(own[-1])
            elif tag == "p":
                flush()
            continue
        foreign = tag in FOREIGN or nearest(FOREIGN) > 0
        closed = rest.endswith("/") or rest.rstrip().endswith("/")
        if foreign and closed:
            add_text(" ")
            continue
        if tag in RAW:
            close = scanner.close_of(tag, at)
            if not closed or close:
                at = close[1] if close else end
            add_text(" ")
            continue
        if tag in CLOSES_P and stack[stack[-1][2]][0] == "p":
            pop(stack[-1][2])
        if tag in CLOSED_BY:
            barrier = nearest(BARRIER[tag])
            while (k := nearest(CLOSED_BY[tag])) > barrier:
                pop(k)
                if tag not in ("tr", "tbody"):
                    break
        if tag in FOREIGN:
            add_text(" ")
        if tag in INLINE or tag in VOID or (foreign and tag not in CLOSES_P):
            if tag == "hr":
                flush()
            elif tag in VOID:
                add_text(" ")
            else:
                push(tag, stack[-1][1])
            continue
        flush()
        attributes = {}
        if rest.strip():
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        names = tuple(dict.fromkeys(w.lower() for k in ("class", "id", "role", "itemprop", "aria-label") for w in _NAME.findall(attributes.get(k, ""))))
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        label = int(attributes["data-label"]) if "data-label" in attributes else None
        parent = stack[-1][1]
        nodes.append(Node(tag, parent, names, hidden, label, nodes[parent].depth + 1))
        nodes[-1].up = nodes[parent].tag
        push(tag, len(nodes) - 1)
        if tag in PLAIN:
            close = scanner.close_of(tag, at)
            text = page[at : close[0] if close else end]
            add_text(text.replace("&", "&amp;"))  # no references in it
            pop(len(stack) - 1)
            at = close[1] if close else end
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].below += nodes[i].below + nodes[i].size
    if not any(x.names and x.size + x.below for x in nodes if x.tag not in PAGE):
        for x in nodes:
            x.bare = True
    return nodes, blocks


#: Elements whose names tell of the page as a whole.
PAGE = frozenset("#root html body".split())
#: Kinds of edges, by the child's tag: running text follows its parent more closely than a section does.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tbody thead tr td th figure figcaption address".split())


def kind_of(node: Node) -> int:
    return int(node.tag in TEXTUAL) + 2 * node.bare


def bin_of(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def features(node: Node) -> list[str]:
    total = node.size + node.below
    out = ["1", f"tag={node.tag}", f"up={node.up}", f"size={bin_of(node.size, (1, 20, 60, 150, 400))}", f"below={bin_of(node.below, (1, 60, 300, 1000))}"]
    if node.size:
        out.append(f"links={bin_of(node.linked / node.size, (0.01, 0.3, 0.6, 0.9))}")
        out.append(f"sentences={bin_of(100 * node.sentences / node.size, (0.1, 0.7, 2))}")
    if node.hidden:
        out.append("hidden")
    out += [f"name={n}" for n in node.names]
    if not total:
        out.append("empty")
    return ["bare " + x for x in out] if node.bare else out  # potentials of their own: where nothing has a name, tags and text must do


@dataclass
class Model:
    """Unary weights by feature and edge potentials [kind][parent label][child label]."""

    weights: dict[str, float]
    edge: list[list[list[float]]]

    def unary(self, node: Node) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(node))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Content marginals of all nodes by one upward and one downward pass of sum-product messages, in logarithms."""
        n = len(nodes)
        own = [self.unary(x) for x in nodes]
        edges = [self.edge[kind_of(x)] for x in nodes]
        b0, b1 = [0.0] * n, own[:]
        u0, u1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            (e00, e01), (e10, e11) = edges[i]
            u0[i], u1[i] = _add(b0[i] + e00, b1[i] + e01), _add(b0[i] + e10, b1[i] + e11)
            p = nodes[i].parent
            b0[p] += u0[i]
            b1[p] += u1[i]
        for i in range(1, n):
            (e00, e01), (e10, e11) = edges[i]
            p = nodes[i].parent
            p0, p1 = b0[p] - u0[i], b1[p] - u1[i]
            # the child's belief: what it had, and what comes down
            b0[i] += _add(p0 + e00, p1 + e10)
            b1[i] += _add(p0 + e01, p1 + e11)
            low = max(b0[i], b1[i])
            b0[i] -= low
            b1[i] -= low
        return [1 / (1 + math.exp(max(-700.0, min(700.0, a - b)))) for a, b in zip(b0, b1)]


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def extract(page: str, model: Model) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    p = model.marginals(nodes)
    return "\n".join(t for i, t in blocks if p[i] >= 0.5)


# ---- learning ----


def settle_labels(nodes: list[Node]) -> list[int]:
    """Labels for all nodes: a mark holds for what lies below it; what has no mark is content where it holds any, but for the page itself."""
    label: list[int | None] = [None] * len(nodes)
    for i, x in enumerate(nodes):
        label[i] = x.label if x.label is not None else (label[x.parent] if i and label[x.parent] is not None else None)
    good = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        good[i] += nodes[i].size * (label[i] or 0)
        if i:
            good[nodes[i].parent] += good[i]
    return [lab if lab is not None else int(nodes[i].tag not in ("#root", "html", "body") and good[i] > 0) for i, lab in enumerate(label)]


def train(pages: list[str], rounds: int = 300, rate: float = 0.1, ridge: float = 0.3) -> Model:
    """Fit potentials by maximum likelihood to pages whose elements carry data-label="1" (content) or "0".

    The gradient is the observed less the expected features and label pairs, with
    expectations by the same sum-product passes, here over all pages a level at a time.
    """
    index: dict[str, int] = {}
    rows: list[list[int]] = []
    labels: list[int] = []
    parent: list[int] = []
    depth: list[int] = []
    kinds: list[int] = []
    for page in pages:
        nodes, _ = parse(page)
        base = len(rows)
        rows += [[index.setdefault(f, len(index)) for f in features(x)] for x in nodes]
        labels += settle_labels(nodes)
        parent += [base + max(0, x.parent) for x in nodes]
        depth += [x.depth for x in nodes]
        kinds += [kind_of(x) for x in nodes]
    x = np.zeros((len(rows), len(index)))
    for i, own_row in enumerate(rows):
        x[i, own_row] = 1
    y, up, level, kind = np.array(labels), np.array(parent), np.array(depth), np.array(kinds)
    levels = [np.flatnonzero(level == d) for d in range(1, int(level.max(initial=0)) + 1)]
    inner = np.flatnonzero(level > 0)
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (kind[inner], y[up[inner]], y[inner]), 1)
    w, e = np.zeros(len(index)), np.zeros((4, 2, 2))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, e)]
    for t in range(1, rounds + 1):
        b = np.stack([np.zeros(len(y)), x @ w], axis=1)
        u = np.zeros_like(b)
        for at in reversed(levels):
            u[at] = np.logaddexp(b[at, None, 0] + e[kind[at], :, 0], b[at, None, 1] + e[kind[at], :, 1])
            np.add.at(b, up[at], u[at])
        pair = np.zeros((4, 2, 2))
        for at in levels:
            above = b[up[at]] - u[at]
            joint = above[:, :, None] + e[kind[at]] + b[at, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            np.add.at(pair, kind[at], joint)
            b[at] = np.log(np.maximum(joint.sum(axis=1), 1e-300))
        p = 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -700, 700)))
        for value, slope, m in ((w, x.T @ (y - p) - ridge * w, moments[0]), (e, seen - pair - ridge * e, moments[1])):
            m[0][...] = 0.9 * m[0] + 0.1 * slope
            m[1][...] = 0.99 * m[1] + 0.01 * slope * slope
            value += rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8) * min(1.0, 3 * (1 - t / rounds) + 0.02)
    return Model({f: float(w[k]) for f, k in index.items()}, e.tolist())


def labelled_pages(n: int = TRAINING_PAGES, nameless_n: int = NAMELESS_PAGES, seed: int = 7) -> list[str]:
    """Pages of random layouts and words, content marked by data-label."""
    r = random.Random(seed)
    syllables = "an be co da el fo gi ha in jo ka le mi no or pa que ra se ti un va we ya zo ß é ö ción".split()

    def words(k: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]) for _ in range(k))

    def sentence(low: int, high: int) -> str:
        s = words(r.randint(low, high)).rstrip(",.")
        return s[:1].upper() + s[1:] + r.choice([".", ".", ".", "", "!"])

    def link() -> str:
        return f'<a href="/{r.randint(1, 999)}">{words(r.randint(1, 3))}</a>'

    bare = [False]  # whether the page is one without names

    def cls(*names: str) -> str:
        name = r.choice(names)
        if bare[0]:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{r.choice([name, name, name + "-" + r.choice(["box", "1", "inner", "wrap"]), r.choice(["page-", "site-"]) + name])}"'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
        return r.choice([f"<nav><ul>{items}</ul></nav>", f"<nav>{items.replace('li>', 'span>')}</nav>", f"<div{cls('menu', 'nav', 'navbar', 'breadcrumb', 'breadcrumbs', 'navigation', 'toc', 'pagination')}><ul>{items}</ul></div>", f"<ul{cls('menu', 'nav', 'tabs')}>{items}</ul>", f'<div role="navigation">{items.replace("li>", "p>")}</div>'])

    def text(k: int = 40) -> str:
        return r.choice([sentence(3, k), f"<p>{sentence(3, k)}</p>", f"<p>{sentence(3, k)}</p><p>{sentence(3, k)}</p>", f"{sentence(3, 12)} {link()}", f"<h3>{sentence(1, 4)}</h3><p>{sentence(3, k)}</p>", f"<b>{sentence(1, 4)}</b><br>{sentence(3, k)}", f"<ul><li>{link()}</li><li>{sentence(2, 9)}</li></ul>"])

    def junk() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return menu()
        if kind == 1:
            return r.choice([f"<aside>{text()}</aside>", f"<div{cls('sidebar', 'side', 'widget', 'related', 'recommended', 'popular', 'tags', 'archive')}>{text()}</div>", f"<section{cls('related', 'more', 'sidebar', 'trending')}>{text()}</section>"])
        if kind in (2, 3):
            tag = r.choice(["div", "div", "section", "aside", "p"])
            inner = sentence(3, 60) if tag == "p" else text(60)
            return f"<{tag}{cls('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsor', 'sponsored', 'promo', 'promoted', 'adsense')}>{inner}</{tag}>"
        if kind == 4:
            return f"<div{cls('notice', 'cookie', 'consent', 'cookies', 'gdpr', 'alert', 'popup', 'modal', 'banner', 'newsletter', 'subscribe', 'overlay', 'message', 'warning')}>{text()}<button>{words(1)}</button></div>"
        if kind == 5:
            return f"<form><label>{words(2)}</label><input><p>{sentence(2, 9)}</p><button>{words(1)}</button></form>"
        if kind == 6:
            own = "".join(f"<{x}{cls('comment', 'reply', 'response')}><p>{sentence(3, 60)}</p></{x}>" for x in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5) if r.random() < 0.95 else 80))
            return f"<{x}{cls('comments', 'discussion', 'replies', 'disqus', 'responses', 'comment')}><h3>{words(2)}</h3>{own}</{x}>" if (x := r.choice(["div", "section", "ol"])) else ""
        if kind == 7:
            return f"<div{cls('share', 'social', 'author', 'meta', 'byline', 'login', 'search', 'legal', 'copyright', 'disclaimer')}>{text(15)}</div>"
        return f"<div style=\"display:none\">{text()}</div>" if r.random() < 0.3 else f"<div{cls('header', 'topbar', 'masthead', 'footer', 'bottom', 'colophon')}>{text(20)}</div>"

    def paragraph(plain: bool) -> str:
        k = r.choice([3, 5, 6, 10, 11, 11, 11]) if plain else r.randrange(14)
        if k == 0:
            return f"<ul>{''.join(f'<li>{sentence(1, 20)}</li>' for _ in range(r.randint(2, 5)))}</ul>"
        if k == 1:
            return f"<blockquote>{r.choice(['', '<p>'])}{sentence(4, 40)}</blockquote>"
        if k == 2:
            return f"<h2>{sentence(1, 8)}</h2>"
        if k == 3:
            return f"<p><b>{sentence(5, 80)}<br>"
        if k == 4:
            return f"<table><tr><td>{sentence(1, 6)}</td><td>{sentence(1, 6)}</td></tr></table>"
        if k == 5:
            return f"<p>{sentence(2, 30)} {link()} {sentence(2, 30)}</p>"
        if k == 6:
            return f"<p>{words(1)}.</p>"
        if k == 7:
            return f"<pre>{words(12)}</pre>"
        if k == 8:
            return f"<div>{sentence(10, 80)}</div>"
        if k == 9:
            return f"<figure><img><figcaption>{sentence(3, 12)}</figcaption></figure>"
        if k == 10:
            return f"<p>{' | '.join(words(1) for _ in range(r.randint(3, 30)))}</p>"
        return f"<p>{sentence(2, 120)}</p>"

    def mark(markup: str, label: int) -> str:
        return re.sub(r"^<(\w+)", rf'<\1 data-label="{label}"', markup)

    def plain_menu() -> str:
        links = [link() for _ in range(r.randint(2, 9))]
        return r.choice([f"<div>{' '.join(links)}</div>", f"<div>{' | '.join(links)}</div>", f"<div><ul>{''.join(f'<li>{x}</li>' for x in links)}</ul></div>", f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>", f"<p>{' '.join(links)}</p>", f"<div>{''.join(f'<div>{x}</div>' for x in links)}</div>"])

    def nameless(inner: str, title: str) -> str:
        """A body of plain elements: menus of links before and after, a line of the publisher's at the end; text in paragraphs or straight in its element."""
        before, after = [mark(plain_menu(), 0) for _ in range(r.choice([0, 0, 1, 1, 2]))], [mark(plain_menu(), 0) for _ in range(r.choice([0, 0, 1]))]
        if r.random() < 0.5:
            after.append(mark(r.choice([f"<div>&copy; {words(3)}</div>", f"<p>&copy; {words(4)} {link()}</p>", f"<div>{link()} {link()}</div>"]), 0))
        straight = title + r.choice(["<br>", "<br><br>", " "]).join(sentence(3, 40) for _ in range(r.choice([1, 2, 5, 20])))
        kind = r.random()
        if kind < 0.2:
            return f'<body data-label="1">{"".join(before)}{straight}{"".join(after)}</body>'
        if kind < 0.36:
            main = r.choice([f'<div data-label="1">{straight}</div>', f'<div><div data-label="1">{straight}</div></div>', f'<section data-label="1">{straight}</section>'])
        else:
            main = r.choice([inner, inner, f"<div>{inner}</div>", f"<div>{inner}</div>", f"<div><div>{inner}</div></div>", f"<section>{inner}</section>", f"<center>{inner}</center>"])
        whole = "".join(before) + main + "".join(after)
        if r.random() < 0.15:
            whole = f"<table><tr><td>{''.join(before)}</td><td>{main}</td></tr></table>{''.join(after)}"
        return f"<body>{r.choice([whole, whole, f'<div>{whole}</div>'])}</body>"

    pages = []
    for k in range(n + nameless_n):
        bare[0] = k >= n
        title = r.choice([f"<h1>{sentence(2, 14)}</h1>", f"<h1>{sentence(2, 14)}</h1>", ""])
        plain = r.random() < 0.6
        if r.random() < 0.85:
            paragraphs = [paragraph(plain) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15, 30]))]
        else:  # long ones, and ones of like paragraphs
            low, high = r.choice([(1, 2), (1, 3), (2, 6), (4, 9), (8, 20), (20, 60)])
            paragraphs = [f"<p>{sentence(low, high)}</p>" for _ in range(r.choice([10, 30, 100, 300]))]
        body = [mark(x, 1) for x in ([title] if title else []) + paragraphs]
        for _ in range(0 if bare[0] else r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randint(0, len(body)), mark(junk(), 0))
        if bare[0]:
            if r.random() < 0.3:
                body = [mark(x, 1) for x in ([title] if title else []) + [f"<p>{sentence(2, 9)}</p>" for _ in range(r.choice([1, 2, 3]))]]
            pages.append(f"<html><head><title>{words(3)}</title></head>{nameless(''.join(body), title)}</html>")
            continue
        inner = "".join(body)
        main = r.choice([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{cls('content', 'article', 'post', 'entry', 'story', 'main', 'text', 'body')}>{inner}</div>", f"<div{cls('wrapper', 'container', 'page')}><div{cls('content', 'post', 'entry', 'article')}>{inner}</div></div>", f"<section{cls('content', 'article', 'post')}>{inner}</section>", f'<div itemprop="articleBody">{inner}</div>'])
        before = [mark(menu(), 0)] * (r.random() < 0.8) + [mark(junk(), 0) for _ in range(r.choice([0, 0, 1, 1, 2]))]
        if r.random() < 0.4:
            before.insert(0, f'<header data-label="0">{r.choice([sentence(1, 5), f"<h1>{sentence(1, 5)}</h1>", menu()])}</header>')
        after = [mark(junk(), 0) for _ in range(r.choice([0, 0, 1, 1, 2]))]
        if r.random() < 0.8:
            after.append(f'<footer data-label="0">{r.choice([sentence(1, 20), "&copy; " + sentence(1, 20), f"<p>{sentence(1, 20)}</p>", menu()])}</footer>')
        middle = "".join(before) + main + "".join(after)
        pages.append(f"<html><head><title>{words(3)}</title></head><body>{middle}</body></html>")
    return pages


TEXTS = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, the main text of html and its number of code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(TEXTS)
        for batch in slices(batches):
            texts = [extract(x, model) for x in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select("page_id", "url", text_of("html").alias("html")).mapInArrow(run, TEXTS)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"), train(labelled_pages()))
