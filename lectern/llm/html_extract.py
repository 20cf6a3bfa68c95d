"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes.

Every element gets features of its subtree (text and link density, tags, attribute tokens), depth and siblings; boosted
regression trees, fitted here on generated pages whose main text is known, give it a log-odds of belonging to the main
text.  Decoding is hierarchical: over each tree the choice of kept and dropped subtrees with the largest total is taken,
in which nothing below a dropped element is kept.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ship

TRAINING_PAGES = 700
PART_CHARS = 2_000_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of a page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select textarea button datalist audio video map".split())
#: Elements that stand in a head; any other ends it.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that end a block of text.
BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend details summary dialog address center hgroup search menu br hr".split()
)
#: An opening tag on the left ends an open element on the right, unless one of BARRIER stands between.
CLOSES = {
    **{t: {"p"} for t in BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"thead", "tbody", "tr", "td", "th", "p"}, "tfoot": {"thead", "tbody", "tr", "td", "th", "p"}, "option": {"option"},
}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
_STOP = frozenset("article section main aside nav header footer div table td th body html form".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"[\"'>]")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ATTRIBUTE = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85\xa0  -     　]+")

#: Attribute tokens that tell of page furniture, and of main text.
BAD_TOKENS = frozenset(
    "ad ads advert advertisement adv banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot "
    "bottom sidebar aside rail widget related recommended more share sharing social follow comment comments disqus reply replies respond cookie cookies consent notice gdpr "
    "popup modal overlay newsletter subscribe signup login form search tags tag pagination pager copyright legal meta byline tools toolbar skip hidden outbrain taboola".split()
)
GOOD_TOKENS = frozenset("article content post entry story body main text page articlebody maincontent blog news prose".split())
TAGS = ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "a", "span", "b", "body", "html")
N_FEATURES = 22


class Node:
    __slots__ = ("tag", "parent", "depth", "bad", "good", "hidden", "items", "n", "linked", "tags", "paras", "stops", "index", "below")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.bad = self.good = self.hidden = False
        self.items: list = []  # text, or a child's number
        self.n = self.linked = self.tags = self.paras = self.stops = self.index = self.below = 0


class _Scanner:
    """Tags of a page, found by places that only move on: time grows with the page's length, whatever stands in it."""

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.absent: set[str] = set()  # what no longer occurs in the rest of the page
        self.quotes = True

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the > of a tag whose attributes begin at `at`; one inside a quoted value doesn't count."""
        here = at
        while self.quotes and (m := _TAG_STOP.search(self.page, here)):
            here = m.end()
            if m[0] == ">":
                return m.start()
            if self.page[max(at, m.start() - 40) : m.start()].rstrip()[-1:] == "=" and (shut := self.find(m[0], here)) >= 0:
                here = shut + 1
        self.quotes = False  # an open quote swallowed the rest: from here on quotes don't count
        return self.find(">", at)

    def raw_end(self, tag: str, at: int) -> tuple[int, int] | None:
        """Start and stop of the end tag of an element of raw text; None if there is none."""
        key = f"</{tag}"
        if key in self.absent:
            return None
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
        stop = self.find(">", m.end()) if m else -1
        if stop < 0:
            self.absent.add(key)
            return None
        return m.start(), stop + 1


def parse(page: str) -> list[Node]:
    """The elements of a page in order of their start; 0 is the root.

    Unclosed and unknown elements are lived with: a raw element (script, title, ...) without an end tag ends at the next
    tag, a comment without an end hides the rest, a tag without > is no text.
    """
    nodes = [Node("#root", -1, 0)]
    scan = _Scanner(page)
    at, here, silent = 0, 0, 0
    path: dict[str, list[int]] = {}  # open elements by tag, outermost first; their numbers grow inwards
    stops: list[int] = []

    def close(to: int) -> None:
        nonlocal here, silent
        while here != to:
            v = nodes[here]
            path[v.tag].pop()
            if v.tag in _STOP:
                stops.pop()
            if v.tag in SILENT or v.hidden:
                silent -= 1
            here = v.parent

    def innermost(tags) -> int:
        return max((path[t][-1] for t in tags if path.get(t)), default=0)

    def text(piece: str) -> None:
        if nodes[here].tag == "head" and piece.strip():
            close(nodes[here].parent)
        if piece and not silent:
            nodes[here].items.append(html.unescape(piece) if "&" in piece else piece)

    begin = 0  # of the text not yet told
    while (at := scan.find("<", at)) >= 0:
        start, after = at, page[at + 1 : at + 2]
        shut = after == "/"
        name = _NAME.match(page, at + 1 + shut)
        if page.startswith("<!--", at):
            stop = scan.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else scan.end
            text(page[begin:start])
            begin = at
            continue
        if not name and after not in ("!", "?", "/"):
            at += 1  # a lone < is text
            continue
        stop = scan.find(">", at) if not name else scan.tag_end(name.end())
        text(page[begin:start])
        if stop < 0:  # no tag ends any more: what follows a < is no text up to the next one
            rest = page[start:].split("<")
            begin = scan.end
            text("".join(x for x in rest[1:] if not re.match(r"[a-zA-Z/!?]", x)))
            break
        at = begin = stop + 1
        if not name:
            continue
        tag, inside = name[0].lower(), page[name.end() : stop]
        if shut:
            own = path.get(tag)
            if own and (tag in _STOP or not stops or stops[-1] < own[-1]):
                close(nodes[own[-1]].parent)
            continue
        if silent and tag not in HEAD and (k := innermost(("head", "template"))) and nodes[k].tag == "head":
            close(nodes[k].parent)
        if closes := CLOSES.get(tag):
            barrier = innermost(BARRIER[tag]) if tag in BARRIER else stops[-1] if stops else 0
            outer = [own[k] for t in closes if (own := path.get(t)) and (k := bisect_right(own, barrier)) < len(own)]
            if outer:
                close(nodes[min(outer)].parent)
        node = Node(tag, here, nodes[here].depth + 1)
        for a in _ATTRIBUTE.finditer(inside) if inside else ():
            attribute, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if attribute == "hidden" or attribute == "aria-hidden" and value == "true" or attribute == "style" and _HIDING.search(value):
                node.hidden = True
            elif attribute in ("class", "id", "role", "itemprop"):
                tokens = set(re.split(r"[^a-z0-9]+", value))
                node.bad |= not tokens.isdisjoint(BAD_TOKENS)
                node.good |= not tokens.isdisjoint(GOOD_TOKENS)
        nodes.append(node)
        nodes[here].items.append(len(nodes) - 1)
        if tag in VOID or inside.endswith("/") and tag in ("path", "circle", "rect"):
            continue
        if tag in RAW:
            found = scan.raw_end(tag, at)
            if found:
                at = found[1]
            else:
                following = scan.find("<", at)
                at = following if following >= 0 else scan.end
            begin = at
            continue
        here = len(nodes) - 1
        path.setdefault(tag, []).append(here)
        if tag in _STOP:
            stops.append(here)
        if tag in SILENT or node.hidden:
            silent += 1
    text(page[begin:])
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row of N_FEATURES for each element."""
    for i in range(len(nodes) - 1, -1, -1):
        v = nodes[i]
        for x in v.items:
            if isinstance(x, str):
                n = len(x.strip())
                v.n += n
                v.linked += n if v.tag == "a" else 0
                v.stops += x.count(". ") + x.count(", ") + (x.rstrip()[-1:] in (".", "!", "?"))
            else:
                c = nodes[x]
                v.n += c.n
                v.linked += c.n if v.tag == "a" else c.linked
                v.tags += c.tags + 1
                v.paras += c.paras + (c.tag == "p")
                v.stops += c.stops
    out = np.zeros((len(nodes), N_FEATURES), np.float32)
    total = max(1, nodes[0].n)
    seen = 0
    bad_above, good_above, furniture = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    places = np.zeros(len(nodes))
    for i, v in enumerate(nodes):
        p = v.parent
        if p >= 0:
            bad_above[i] = bad_above[p] + nodes[p].bad
            good_above[i] = good_above[p] + nodes[p].good
            furniture[i] = furniture[p] + (nodes[p].tag in ("nav", "header", "footer", "aside", "form"))
        places[i] = seen / total
        seen += sum(len(x.strip()) for x in v.items if isinstance(x, str))
    for i, v in enumerate(nodes):
        children = [x for x in v.items if not isinstance(x, str)]
        for k, x in enumerate(children):
            nodes[x].index = k
            nodes[x].below = len(children)
        p = nodes[v.parent] if v.parent >= 0 else v
        out[i] = (
            TAGS.index(v.tag) if v.tag in TAGS else len(TAGS), v.depth, np.log1p(v.n), v.linked / max(1, v.n), v.n / (v.tags + 1), v.tags, v.paras, v.stops / max(1, v.n) * 100,
            v.bad, v.good, bad_above[i], good_above[i], furniture[i], v.tag in ("nav", "footer", "aside", "form", "header"), v.tag in ("article", "main"), v.n / total, places[i],
            len(children), v.index, v.below, TAGS.index(p.tag) if p.tag in TAGS else len(TAGS), p.linked / max(1, p.n),
        )
    return out


# --- boosted trees ------------------------------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on features cut into BINS quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(2**depth, int), np.full(2**depth, BINS), np.zeros(2 ** (depth + 1))
            at = np.ones(len(y), int)
            for level in range(depth):
                for node in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 40:
                        continue
                    gt, ht = g[rows].sum(), h[rows].sum()
                    best = 1e-3
                    for j in range(x.shape[1]):
                        gs = np.cumsum(np.bincount(b[rows, j], g[rows], BINS))[:-1]
                        hs = np.cumsum(np.bincount(b[rows, j], h[rows], BINS))[:-1]
                        gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[node], cut[node] = gain[k], j, k
                at = 2 * at + (b[np.arange(len(b)), feature[at]] > cut[at])
            for node in range(2**depth, 2 ** (depth + 1)):
                rows = at == node
                leaf[node] = rate * g[rows].sum() / (h[rows].sum() + 1)
            self.trees.append((feature, cut, leaf))
            f += leaf[at]
        self.depth = depth

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def log_odds(self, x: np.ndarray, most: int = 50_000) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._log_odds(x[i : i + most]) for i in range(0, len(x), most))])

    def _log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            at = np.ones(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + (b[rows, feature[at]] > cut[at])
            out += leaf[at]
        return out


# --- generated training pages ---------------------------------------------------------------------------------------


def training_page(rng: random.Random) -> tuple[str, str]:
    """A page and, marked by \x01 in front of every text that is main text, which of its texts are."""
    syllables = "ka lo mi ter an ver sol den ri us pe tan qua bel or in sta ne".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def say(n: int, main: bool) -> str:
        words = [word() for _ in range(max(1, n))]
        for i in range(rng.randint(4, 12), len(words), rng.randint(6, 14)):
            words[i] += rng.choice((".", ".", ","))
        if rng.random() < 0.1:
            words = [w + rng.choice(("***", "###", "!!", "&amp;&amp;", "")) for w in words]
        return ("\x01" if main else "") + " ".join(words).capitalize() + ("." if main or rng.random() < 0.5 else "")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{say(rng.randint(1, 3), False)}</a></li>' for _ in range(n))

    def named(names: list[str]) -> str:
        kind = rng.random()
        return f' class="{rng.choice(names)}"' if kind < 0.55 else f' id="{rng.choice(names)}"' if kind < 0.8 else f' class="{word()} {rng.choice(names)}"'

    def furniture(kind: str) -> str:
        if kind == "nav":
            body = f"<ul>{links(rng.randint(3, 14))}</ul>"
            return f"<nav>{body}</nav>" if rng.random() < 0.6 else f"<div{named(['menu', 'navbar', 'navigation', 'breadcrumbs'])}>{body}</div>"
        if kind == "header":
            return f"<header{named(['masthead', 'site-header', 'top'])}><a href='/'>{say(2, False)}</a><p>{say(rng.randint(2, 8), False)}</p></header>"
        if kind == "footer":
            body = f"&copy; {rng.randint(1999, 2030)} {say(rng.randint(2, 20), False)}"
            shut = "</footer>" if rng.random() < 0.6 else ""
            return f"<footer>{body}{shut}" if rng.random() < 0.7 else f"<div{named(['footer', 'copyright', 'legal'])}>{body}</div>"
        if kind == "aside":
            body = rng.choice((f"<h3>{say(2, False)}</h3><ul>{links(5)}</ul>", f"<p>{say(rng.randint(5, 40), False)}</p>"))
            return f"<aside>{body}</aside>" if rng.random() < 0.6 else f"<div{named(['sidebar', 'widget', 'related', 'right-rail'])}>{body}</div>"
        if kind == "ad":
            return f"<div{named(['ad', 'ads', 'advert', 'banner', 'sponsored', 'promo'])}>{say(rng.randint(3, 30), False)}</div>"
        if kind == "notice":
            return f"<div{named(['cookie-notice', 'consent', 'notice', 'newsletter', 'popup'])}><p>{say(rng.randint(5, 30), False)}</p><a href='#'>{say(1, False)}</a></div>"
        if kind == "form":
            return f"<form action='/{word()}'><label>{say(2, False)}</label><input name='q'><p>{say(rng.randint(2, 12), False)}</p></form>"
        comments = "".join(f"<li{named(['comment', 'reply'])}><p>{say(rng.randint(3, 50), False)}</p></li>" for _ in range(rng.randint(1, 5)))
        return f"<section{named(['comments', 'comment-list', 'responses comments'])}><h3>{say(2, False)}</h3><ol>{comments}</ol></section>"

    def block() -> str:
        n, roll = rng.choice((1, 2, 5, 12, 30, 60, 120)), rng.random()
        if roll < 0.62:
            inner = say(n, True)
            if rng.random() < 0.2:
                inner = f"<b>{inner}" if rng.random() < 0.5 else f"<b>{inner}</b>"
            if rng.random() < 0.2:
                inner += f" <a href='/{word()}'>{say(2, True)}</a> {say(rng.randint(1, 9), True)}"
            if rng.random() < 0.15:
                inner += f"<br>{say(n // 2, True)}"
            return f"<p>{inner}" + ("</p>" if rng.random() < 0.8 else "")
        if roll < 0.72:
            return f"<h2>{say(4, True)}</h2>"
        if roll < 0.82:
            return "<ul>" + "".join(f"<li>{say(rng.randint(2, 20), True)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if roll < 0.88:
            return f"<blockquote><p>{say(n, True)}</p></blockquote>"
        if roll < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{say(2, True)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if roll < 0.97:
            return furniture(rng.choice(("ad", "aside", "notice")))
        return f"<div>{say(n, True)}</div>"

    title = say(rng.choice((1, 2, 6, 10)), True)
    main = (f"<h1>{title}</h1>" if rng.random() < 0.8 else "") + "".join(block() for _ in range(rng.choice((0, 1, 1, 2, 3, 6, 12))))
    if rng.random() < 0.15:
        main += furniture("comments")
    frame = rng.random()
    body = (
        f"<article>{main}</article>" if frame < 0.5 else f"<main>{main}</main>" if frame < 0.65 else f"<div{named(['content', 'post', 'entry-content', 'article-body', 'story', 'main-text'])}>{main}</div>" if frame < 0.9 else f"<div>{main}</div>"
    )
    before = [furniture(k) for k in ("header", "nav", "ad", "notice", "aside") if rng.random() < 0.5]
    after = [furniture(k) for k in ("aside", "ad", "comments", "form", "footer", "notice", "nav") if rng.random() < 0.45]
    rng.shuffle(before)
    page = "".join(before) + body + "".join(after)
    if rng.random() < 0.3:
        page = f"<div{named(['wrapper', 'page', 'container', 'site'])}>{page}</div>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title[1:]}</title><style>p{{}}</style></head><body>{page}</body></html>", title


def training_set(pages: int = TRAINING_PAGES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(training_page(rng)[0])
        main, other = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            for x in nodes[i].items:
                if isinstance(x, str):
                    main[i] += len(x) if "\x01" in x else 0
                    other[i] += len(x.strip()) if "\x01" not in x else 0
                else:
                    main[i] += main[x]
                    other[i] += other[x]
            nodes[i].items = [x.replace("\x01", "") if isinstance(x, str) else x for x in nodes[i].items]
        told = [i for i in range(1, len(nodes)) if main[i] + other[i] > 0]
        xs.append(features(nodes)[told])
        ys.append([main[i] > other[i] for i in told])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


def train() -> Boosted:
    return Boosted(*training_set())


# --- decoding and text --------------------------------------------------------------------------------------------


def choose(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which elements are kept: the best total of log-odds over kept elements with text, none below a dropped one."""
    own = [float(o) if v.n else 0.0 for v, o in zip(nodes, odds, strict=True)]
    gain = own[:]
    gain[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        weight = gain[i]
        if weight > 0:
            gain[nodes[i].parent] += weight
    kept = [False] * len(nodes)
    for i, v in enumerate(nodes):
        kept[i] = (v.parent < 0 or kept[v.parent]) and (v.parent < 0 or gain[i] > 0 or not v.n)
    return kept


def text_of(nodes: list[Node], kept: list[bool], odds: np.ndarray) -> str:
    """Blocks of kept elements in page order, one a line; text that stands in a container needs the container's own vote."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if block := _SPACE.sub(" ", "".join(line)).strip(" "):
                blocks.append(block)
            line.clear()

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        i, k = stack.pop()
        v = nodes[i]
        if k == 0 and v.tag in BLOCK:
            flush()
        while k < len(v.items):
            x = v.items[k]
            k += 1
            if isinstance(x, str):
                if odds[i] > 0:
                    line.append(x)
            elif kept[x]:
                stack += [(i, k), (x, 0)]
                break
            elif nodes[x].tag in BLOCK:
                flush()
        else:
            if v.tag in BLOCK:
                flush()
    flush()
    return "\n".join(blocks)


def main_text(page: str | None, model: Boosted) -> str:
    if not page:
        return ""
    nodes = parse(page)
    odds = model.log_odds(features(nodes))
    return text_of(nodes, choose(nodes, odds), odds)


def _cuts(sizes: list[int]) -> list[tuple[int, int]]:
    """(first page, pages) of stretches of about PART_CHARS characters, or of one page."""
    out, at, n = [], 0, 0
    for i, size in enumerate(sizes):
        if i > at and (n + size > PART_CHARS or i - at >= 200):
            out.append((at, i - at))
            at, n = i, 0
        n += size
    return [*out, (at, len(sizes) - at)] if sizes else []


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(page_id, url, text) of every row: the main text of its html, empty if it has none or is null.

    Rows stay rows, repeated ones and null ids too; an empty table gives none; columns beside page_id, url and html are
    ignored.  Time and memory grow with a page's length, however malformed it is; pages are read PART_CHARS at a time.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or train())
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            for at, size in _cuts([len(p or "") for p in batch.column("html").to_pylist()]):
                part = batch.slice(at, size)
                pages = [parse(p) if p else [] for p in part.column("html").to_pylist()]
                rows = [features(n) for n in pages if n]
                odds = np.split(shared.value.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
                each = iter(odds)
                texts = [text_of(n, choose(n, o), o) if n and (o := next(each)) is not None else "" for n in pages]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string")
