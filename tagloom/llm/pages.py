"""HTML main-text extraction with a tree-structured graphical model.

A page is parsed into a tree of block elements and runs of text. Every node is content
or not: its own features give a potential, its tag and that of its parent a potential
for each pair of labels. Sum-product messages, upward and then downward, give exact
marginals; runs of text whose marginal is above one half are the article. The
potentials are fitted by likelihood on labelled pages, which a seeded generator makes,
as the tables have none.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import arrow_map, texts_of

#: Labelled pages of a fit, their seed, and rounds over them.
PAGES, SEED, ROUNDS = 240, 7, 6

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_PART = re.compile(r">|=\s*([\"'])")
_PLAIN_END = re.compile(r"[<>]")
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+")
_RAW = frozenset(("script", "style", "title", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "audio", "video"))
#: Without an end tag these reach to the end of the page; others of _RAW are then tags without content.
_TO_THE_END = frozenset(("script", "style"))
#: Elements that may hold themselves.
_NESTS = frozenset(("template", "svg", "object", "math", "canvas", "audio", "video"))
#: Open inline elements that are remembered; further ones change nothing but how much text counts as linked.
_MOST_INLINE = 256
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
_INLINE = frozenset(("a", "b", "i", "em", "strong", "span", "u", "s", "small", "big", "sub", "sup", "code", "kbd", "samp", "var", "cite", "q", "abbr", "dfn", "mark", "time", "font", "label", "tt", "del", "ins", "bdi", "bdo", "data", "ruby", "rt", "rp", "img", "wbr", "acronym", "strike"))
_CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"))
#: An element that opens ends an open one of these, up to the barrier.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_GROUPS = {}
for _k, _tags in enumerate(("#text", "html body", "article main", "nav menu", "header hgroup", "footer", "aside", "form button input select textarea fieldset option dialog", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "div section center details", "table tbody thead tr td th", "figure figcaption address")):
    for _t in _tags.split():
        _GROUPS[_t] = _k
_N_GROUPS = 16

_GOOD = frozenset("article content post entry main story body text page prose blog".split())
_BAD = {w: k for k, ws in enumerate(("nav menu navigation navbar breadcrumb breadcrumbs pagination pager tabs toc", "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored", "sidebar side rail widget widgets aside", "footer foot copyright legal bottom", "header masthead top logo topbar", "comment comments reply replies respond discussion disqus thread", "cookie cookies consent gdpr notice notification alert popup modal overlay disclaimer", "share sharing social follow twitter facebook tools toolbar actions", "related recommended recommendations popular trending more", "subscribe newsletter signup login register search form contact")) for w in ws.split()}
_N_BAD = 10


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "text", "linked", "gold", "feats", "deep")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.text, self.linked = "", 0
        self.gold = parent.gold if parent else 0
        self.deep = parent.deep + 1 if parent else 0


def tokens(source: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """Tags as (name, whether it ends an element, attributes, start, end) in order; comments have an empty name.

    Raw elements (scripts, styles and the like) are one token without a name, whatever
    they hold. Every character is looked at a bounded number of times: a tag whose quotes
    or bracket never close ends at the next bracket, as do all tags after it, and an end
    tag that was once not found is not looked for again.
    """
    at, size = 0, len(source)
    last_close, last = source.rfind(">"), {q: source.rfind(q) for q in "\"'"}
    plain, endless = False, set()
    while (start := source.find("<", at)) >= 0:
        after = source[start + 1 : start + 2]
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield "", False, "", start, at
            continue
        if after in ("!", "?") and after:
            end = source.find(">", start) if last_close > start else -1
            at = start + 2 if end < 0 else end + 1
            if end >= 0:
                yield "", False, "", start, at
            continue
        m = _NAME.match(source, start)
        if m is None:
            at = start + 1
            continue
        end, pos = -1, m.end()
        while not plain:
            part = _PART.search(source, pos) if last_close >= pos else None
            if part is None or part[1] and last[part[1]] < part.end():
                plain = True
            elif part[1]:
                pos = source.index(part[1], part.end()) + 1
            else:
                end = part.start()
                break
        if end < 0:
            part = _PLAIN_END.search(source, m.end())
            if part is None:  # a tag that the page's end cuts off
                yield "", False, "", start, size
                return
            end = part.start()
        at = end + (source[end] == ">")
        name, ends, attrs = m[1].lower(), source[start + 1] == "/", source[m.end() : end]
        if name in _RAW and not ends:
            close = -1
            if not attrs.endswith("/") and name not in endless:
                close = _raw_end(source, name, at)
                if close < 0:
                    endless.add(name)
            if name in endless and name in _TO_THE_END:
                close = size
            at = max(at, close)
            yield "", False, "", start, at
            continue
        yield name, ends, attrs, start, at


@lru_cache(maxsize=None)
def _tags_of(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>?" if name in _NESTS else rf"<(/){name}(?=[\s/>])[^>]*>?", re.I)


def _raw_end(source: str, name: str, at: int) -> int:
    """Where a raw element ends that opened before `at`; nested ones of its name end first, if all end; -1 if it doesn't end."""
    depth, first = 1, -1
    for m in _tags_of(name).finditer(source, at):
        if m[1]:
            depth -= 1
            first = m.end() if first < 0 else first
            if depth == 0:
                return m.end()
        elif not m[0].endswith("/>"):
            depth += 1
    return first


def parse(source: str) -> Node:
    """The tree of block elements; children in page order; runs of text are #text nodes."""
    root = Node("html", "", None)
    # open elements: [tag, node or None for inline ones]
    stack: list[tuple[str, Node]] = [("html", root)]
    run: list[str] = []
    opened: Counter[str] = Counter()
    linked, inline, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                leaf = Node("#text", "", stack[-1][1])
                leaf.text, leaf.linked = text, min(linked, len(text))
                stack[-1][1].children.append(leaf)
        linked = 0

    def close_to(k: int) -> None:
        nonlocal inline
        gone = [t for t, _ in stack[k:]]
        if any(t not in _INLINE for t in gone):
            flush()
        opened.subtract(gone)
        inline -= sum(t in _INLINE for t in gone)
        del stack[k:]

    def said(upto: int) -> None:
        nonlocal linked
        if upto > at:
            run.append(source[at:upto])
            if opened["a"] > 0:
                linked += upto - at

    for tag, ends, attrs, start, end in tokens(source):
        said(start)
        at = end
        if not tag:
            continue
        if ends:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k][0] == tag:
                    close_to(k)
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break  # a stray inline end doesn't close blocks
            continue
        if tag in ("html", "body", "head"):
            flush()
            if tag == "body" and attrs:
                root.attrs = attrs
            continue
        if tag in ("br", "hr"):
            flush()
        if tag in _VOID:
            continue
        if tag in _INLINE:
            if tag == "a" and opened["a"] > 0:  # links don't nest: the one before ends here
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "a")
                stack[k] = ("span", stack[k][1])
                opened.update(span=1, a=-1)
            if inline < _MOST_INLINE:
                stack.append((tag, stack[-1][1]))
                opened[tag] += 1
                inline += 1
            continue
        flush()
        if tag in _CLOSES_P and opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        if tag in _ENDS and any(opened[t] > 0 for t in _ENDS[tag][0]):
            own, barrier = _ENDS[tag]
            found = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in own:
                    found = k
                if stack[k][0] in barrier:
                    break
            if found:
                close_to(found)
        node = Node(tag, attrs, stack[-1][1])
        stack[-1][1].children.append(node)
        if not attrs.endswith("/"):
            stack.append((tag, node))
            opened[tag] += 1
    said(len(source))
    flush()
    return root


# feature numbers: bias 0, tag groups, parent's tag groups, lexicon, text length, link share, punctuation, place
_PARENT, _LEX, _LENGTH, _LINKS, _MARKS, _DEEP, _SIZE = 1 + _N_GROUPS, 1 + 2 * _N_GROUPS, 44 + _N_GROUPS, 52 + _N_GROUPS, 58 + _N_GROUPS, 62 + _N_GROUPS, 68 + _N_GROUPS


def _prepare(root: Node) -> list[Node]:
    """Nodes in page order (parents first) with their features."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(reversed(n.children))
    size: dict[int, list[int]] = {}
    for n in reversed(order):
        total, linked = len(n.text), n.linked
        for c in n.children:
            t, k = size[id(c)]
            total, linked = total + t, linked + k
        size[id(n)] = [total, linked]
    whole = max(1, size[id(root)][0])
    for n in order:
        total, linked = size[id(n)]
        f = [0, 1 + _GROUPS.get(n.tag, _N_GROUPS - 1)]
        if n.parent:
            f.append(_PARENT + _GROUPS.get(n.parent.tag, _N_GROUPS - 1))
        if n.attrs:
            values = []
            for m in _ATTR.finditer(n.attrs):
                name = m[1].lower()
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    values.append(m[2] or m[3] or m[4] or "")
                elif name == "hidden" or name == "style" and "none" in (m[2] or m[3] or m[4] or ""):
                    f.append(_LEX + _N_BAD + 1)
                elif name == "data-gold":
                    n.gold = int(m[2])
            words = set(_WORD.findall(" ".join(values).lower()))
            f += {_LEX + _BAD[w] for w in words if w in _BAD}
            if words & _GOOD:
                f.append(_LEX + _N_BAD)
        f.append(_LENGTH + (0 if not total else 1 if total < 15 else 2 if total < 40 else 3 if total < 100 else 4 if total < 400 else 5))
        f.append(_LENGTH + (6 if total > 0.5 * whole else 7))
        share = linked / max(1, total)
        f.append(_LINKS + (0 if share == 0 else 1 if share < 0.2 else 2 if share < 0.6 else 3))
        if n.tag == "#text":
            f.append(_MARKS + (0 if n.text[-1] in ".!?:;\"'”»…" else 1))
            f.append(_MARKS + (2 if "©" in n.text or "(c)" in n.text[:20].lower() else 3))
        f.append(_DEEP + min(n.deep, 5))
        n.feats = f
    return order


def _inherit(order: list[Node]) -> None:
    for n in order:
        if n.parent and "data-gold" not in n.attrs:
            n.gold = n.parent.gold


class Model:
    """Log-linear potentials: weights of content by feature, and pair weights [child's group][parent label][child label]."""

    def __init__(self):
        self.unary = [0.0] * _SIZE
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(_N_GROUPS)]

    def messages(self, order: list[Node]) -> tuple[list[float], list[tuple[float, float, float, float] | None]]:
        """Marginal of content of each node, and of each pair (parent, child) of labels: 00, 01, 10, 11."""
        at = {id(n): k for k, n in enumerate(order)}
        up0, up1 = [0.0] * len(order), [0.0] * len(order)
        own = [sum([self.unary[f] for f in n.feats]) for n in order]
        below0, below1 = [0.0] * len(order), own[:]
        tables = []
        for n in order:
            p = self.pair[_GROUPS.get(n.tag, _N_GROUPS - 1)]
            tables.append(p)
        parents = [at[id(n.parent)] if n.parent else -1 for n in order]
        for k in range(len(order) - 1, 0, -1):  # upward
            p = tables[k]
            a, b = below0[k], below1[k]
            m0, m1 = _lse(p[0][0] + a, p[0][1] + b), _lse(p[1][0] + a, p[1][1] + b)
            up0[k], up1[k] = m0, m1
            j = parents[k]
            below0[j] += m0
            below1[j] += m1
        down0, down1 = [0.0] * len(order), [0.0] * len(order)
        out: list[float] = []
        pairs: list[tuple[float, float, float, float] | None] = []
        for k in range(len(order)):  # downward
            j = parents[k]
            if j < 0:
                pairs.append(None)
            else:
                p = tables[k]
                a, b = down0[j] + below0[j] - up0[k], down1[j] + below1[j] - up1[k]
                e = (a + p[0][0], a + p[0][1], b + p[1][0], b + p[1][1])
                down0[k], down1[k] = _lse(e[0], e[2]), _lse(e[1], e[3])
                shift = min(down0[k], down1[k])
                joint = (e[0] + below0[k], e[1] + below1[k], e[2] + below0[k], e[3] + below1[k])
                top = max(joint)
                w = [math.exp(x - top) for x in joint]
                z = sum(w)
                pairs.append((w[0] / z, w[1] / z, w[2] / z, w[3] / z))
                down0[k] -= shift
                down1[k] -= shift
            d = down0[k] + below0[k] - down1[k] - below1[k]
            out.append(1 / (1 + math.exp(d)) if d < 500 else 0.0)
        return out, pairs

    def learn(self, order: list[Node], rate: float) -> None:
        """One likelihood step on a labelled tree."""
        marginal, pairs = self.messages(order)
        for n, p, joint in zip(order, marginal, pairs, strict=True):
            step = rate * (n.gold - p)
            if abs(step) > 1e-6:
                for f in n.feats:
                    self.unary[f] += step
            if joint is not None:
                table = self.pair[_GROUPS.get(n.tag, _N_GROUPS - 1)]
                seen = n.parent.gold * 2 + n.gold
                for s in range(4):
                    table[s >> 1][s & 1] += rate * ((s == seen) - joint[s])

    def text(self, source: str) -> str:
        """The main text of a page: content runs in page order, one a line."""
        order = _prepare(parse(source))
        if len(order) < 2:
            return ""
        marginal, _ = self.messages(order)
        return "\n".join([n.text for n, p in zip(order, marginal, strict=True) if p > 0.5 and n.tag == "#text"])


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


# --- labelled pages ---


def _sentence(r: random.Random, low: int, high: int, end: str = ".") -> str:
    words = ["".join(r.choice(("ta", "re", "mi", "on", "el", "su", "ka", "no", "th", "er", "in", "é", "ß")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + end


def labelled_page(r: random.Random) -> str:
    """A page whose blocks carry data-gold="1" (content) or "0"."""
    tag = lambda t, inside, gold=None, **a: f"<{t}{''.join(f' {k}="{v}"' for k, v in a.items())}{'' if gold is None else f' data-gold="{gold}"'}>{inside}</{t}>"
    link = lambda low=1, high=3: tag("a", _sentence(r, low, high, ""), href="#")
    items = lambda n: tag("ul", "".join(tag("li", link()) for _ in range(n)))
    named = lambda *names: {"class": r.choice(names)} if r.random() < 0.8 else {"id": r.choice(names)}

    def paragraph() -> str:
        kind = r.random()
        said = " ".join(_sentence(r, 3, 18, r.choice((".", ".", "?", "!"))) for _ in range(r.randint(1, 6)))
        if r.random() < 0.15:
            said = _sentence(r, 1, 3, r.choice((".", "")))
        if r.random() < 0.25:
            said = said.replace(" ", f" {link()} ", 1)
        if kind < 0.55:
            return tag("p", said)
        if kind < 0.7:
            return f"<p><b>{said}<br>"
        if kind < 0.76:
            return tag(r.choice(("h2", "h3", "h4")), _sentence(r, 1, 7, ""))
        if kind < 0.82:
            return tag(r.choice(("ul", "ol")), "".join(tag("li", _sentence(r, 2, 12, r.choice((".", "")))) for _ in range(r.randint(2, 6))))
        if kind < 0.87:
            return tag("blockquote", tag("p", said))
        if kind < 0.9:
            return tag("table", "".join(tag("tr", "".join(tag("td", _sentence(r, 1, 4, "")) for _ in range(3))) for _ in range(r.randint(2, 5))))
        if kind < 0.93:
            return tag("pre", said)
        if kind < 0.96:
            return tag("div", said)
        return tag("figure", "<img src='x.png'>" + tag("figcaption", said))

    def noise() -> str:
        kind = r.randint(0, 8)
        said = _sentence(r, 2, 14)
        if kind <= 1:
            return tag(r.choice(("div", "div", "aside", "section")), r.choice((said, tag("p", said), link(1, 6))), 0, **named("ad", "ads", "advert", "ad-box", "sponsored", "promo", "banner"))
        if kind == 2:
            return tag("div", "".join(tag("a", w, href="#") for w in ("Share", "Tweet", "Like")[: r.randint(1, 3)]), 0, **named("share", "social", "share-tools"))
        if kind == 3:
            return tag(r.choice(("div", "section", "aside")), tag("h3", _sentence(r, 1, 3, "")) + items(r.randint(2, 5)), 0, **named("related", "recommended", "popular", "more-stories"))
        if kind == 4:
            return tag("form", tag("p", said) + "<input type='text'>" + tag("button", "Send"), 0, **named("newsletter", "signup", "search", "login", "f"))
        if kind == 5:
            return tag("div", tag("p", said) + tag("button", "OK"), 0, **named("cookie", "notice", "consent-banner", "alert", "popup"))
        if kind == 6:
            return tag("aside", tag("h4", _sentence(r, 1, 3, "")) + tag("p", said), 0)
        if kind == 7:
            return tag("nav", " ".join(link() for _ in range(3)), 0, **named("breadcrumb", "pagination", "toc"))
        return tag("div", tag("p", said + " " + _sentence(r, 3, 10)), 0, **named("disclaimer", "notice", "notification"))

    def comments() -> str:
        one = lambda: tag(r.choice(("div", "li", "article")), tag("b", _sentence(r, 1, 2, "")) + tag("p", " ".join(_sentence(r, 3, 15) for _ in range(r.randint(1, 3)))), **named("comment", "comment-body", "reply"))
        return tag(r.choice(("div", "section", "ol")), r.choice(("", tag("h3", "Comments"))) + "".join(one() for _ in range(r.randint(1, 5))), 0, **named("comments", "comment-list", "discussion", "respond"))

    head = "<!DOCTYPE html><html><head><title>" + _sentence(r, 2, 8, "") + "</title><style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>"
    parts = []
    if r.random() < 0.5:
        parts.append(tag(r.choice(("header", "div")), tag(r.choice(("p", "h2", "div")), _sentence(r, 1, 4, "")) + r.choice(("", items(4))), 0, **named("header", "masthead", "top", "site-header")))
    if r.random() < 0.8:
        parts.append(tag("nav", items(r.randint(3, 8)), 0) if r.random() < 0.7 else tag("div", items(r.randint(3, 8)), 0, **named("menu", "nav", "navbar")))
    parts += ["<!-- ad -->" + noise() for _ in range(r.choice((0, 1, 1, 2)))]
    body = [tag(r.choice(("h1", "h1", "h2")), _sentence(r, 1, 10, r.choice(("", "."))))] if r.random() < 0.9 else []
    if body and r.random() < 0.15:
        body = [tag("header", body[0])]
    for _ in range(r.choice((1, 2, 4, 7, 12))):
        body.append(paragraph())
        if r.random() < 0.12:
            body.append(noise())
    kind = r.random()
    inside = "".join(body)
    if r.random() < 0.15:
        inside += comments()
    if kind < 0.6:
        main = tag("article", inside, 1)
    elif kind < 0.75:
        main = tag("main", inside, 1)
    else:
        main = tag("div", inside, 1, **named("content", "post", "entry-content", "article-body", "main", "story"))
    if r.random() < 0.3:
        main = tag("div", main, **named("page", "wrapper", "container"))
    parts.append(main)
    if r.random() < 0.3:
        parts.append(comments())
    if r.random() < 0.3:
        parts.append(tag(r.choice(("aside", "div")), "".join(tag("h3", _sentence(r, 1, 3, "")) + tag("p", _sentence(r, 3, 12)) + items(3) for _ in range(r.randint(1, 2))), 0, **named("sidebar", "side", "widget", "rail")))
    parts += [noise() for _ in range(r.choice((0, 0, 1)))]
    if r.random() < 0.85:
        said = r.choice(("&copy; ", "Copyright ", "")) + _sentence(r, 1, 4, "") + " &middot; " + _sentence(r, 2, 14)
        parts.append(tag("footer", r.choice((said, tag("p", said), said + items(3))), 0) if r.random() < 0.8 else tag("div", said, 0, **named("footer", "foot", "copyright")))
    return head + "".join(parts) + "</body></html>"


@lru_cache(maxsize=1)
def fitted(pages: int = PAGES, seed: int = SEED) -> Model:
    """The model fitted on generated labelled pages."""
    r, model, trees = random.Random(seed), Model(), []
    for _ in range(pages):
        order = _prepare(parse(labelled_page(r)))
        _inherit(order)
        # a container is content if any of its text is
        for n in reversed(order):
            if n.children:
                n.gold = max(c.gold for c in n.children)
        trees.append(order)
    for k in range(ROUNDS):
        r.shuffle(trees)
        for order in trees:
            model.learn(order, 0.25 / (1 + k))
    return model


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page, one output row per input row.

    Null html counts as empty and gives an empty text, as do pages without content. Html
    of any length and any faults is read in time linear in its length; what looks like a
    tag is one, as in browsers. A null id or url stays null; repeated rows are repeated;
    other columns are ignored.
    Result: page_id, url, text, n_chars.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.text(t) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(pages[id_col], pages[url_col], pages[html_col]), run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
