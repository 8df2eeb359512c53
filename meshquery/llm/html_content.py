"""Operator 9, main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden label, content or not. A node has features (tag, words of its class and id,
length, punctuation and share of links of its text) whose weighted sum is its potential; a parent and a child have a
potential that depends on both labels and on the kind of child. Sum-product messages go up the tree and down again and
give exact marginals; the text of nodes whose marginal is at least one half is the page's main text.

The weights maximise the conditional likelihood of labelled pages (AdaGrad; the gradient needs the same messages). The
labelled pages are made by ``labelled_pages``, a seeded generator of many page layouts with known labels, and by
``unnamed_pages``, the same layouts without the names and tags that tell an article; other labelled pages can be given to
``train``. On a page where nothing is named as content, features have weights of their own and tell more of a node's place:
before or after the first heading and how far up its container is, how many siblings are built alike, and which words a
short block begins with.

The parser is forgiving: unclosed tags, implied ends, stray quotes and cut-off pages are read like browsers read them.
Scripts, styles, templates, form controls, drawings, the head and hidden elements never are text; such an element ends with
its own end tag, an implied end or the end of an element around it. It takes time in proportion to the page's length,
however deep or broken the page is: open elements are found by tag, never by a walk over all of them.

Defined results: null html is empty; a page without content text gives the empty string and 0; null url or page_id and
repeated rows are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+'|["'])[^>"']*+)*+)(?:>|\Z)""", re.S)
MARK = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
UNSEEN = re.compile(r"hidden|display\s*:\s*none", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("noscript template svg annotation annotation-xml canvas object audio video select datalist button head".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these, if it is nearer than any of the stops.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
KINDS = {
    "ad": r"\bads?\b|advert|sponsor|promo|\bad[-_]|[-_]ad\b|banner",
    "menu": r"nav|menu|breadcrumb|pagin|pager",
    "top": r"header|masthead|topbar|logo|branding",
    "foot": r"foot|copyright|colophon|legal",
    "side": r"side|widget|related|recommend|rail|trending|popular",
    "comment": r"comment|disqus|repl(?:y|ies)|respond|discuss|feedback",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|subscri|newsletter|paywall",
    "share": r"share|social|follow",
    "form": r"form|search|login|signup",
    "content": r"content|article|post|entry|story|main|body|text|prose",
    "meta": r"byline|author|date|\bmeta|tags|caption|credit",
}
KIND = {k: re.compile(v, re.I) for k, v in KINDS.items()}
#: How short blocks begin that are no content.
CUES = {
    "comment": r"(?:\d+ )?(?:comment|repl(?:y|ies)|discussion|responses?\b)|leave a",
    "notice": r"(?:we|this (?:site|website)) uses? cookies|cookie|accept|subscribe|sign up|join our|newsletter",
    "ad": r"advert|sponsored|promot",
    "side": r"related|recommended|popular|trending|more (?:from|stories)|read (?:more|next)|you (?:may|might)",
    "share": r"share|follow|tweet",
    "foot": r"©|\(c\)|copyright|all rights",
}
CUE = re.compile(r"\s*(?:" + "|".join(f"(?P<{k}>{v})" for k, v in CUES.items()) + ")", re.I)
BOILER = frozenset("nav header footer aside form menu search dialog fieldset".split())
_marks: dict[str, tuple[str, ...]] = {}


def _kinds(attributes: str) -> tuple[str, ...]:
    got = _marks.get(attributes)
    if got is None:
        words = " ".join(a or b or c for _, a, b, c in MARK.findall(attributes))
        got = tuple(k for k, pattern in KIND.items() if pattern.search(words)) if words else ()
        if len(_marks) > 20_000:
            _marks.clear()
        _marks[attributes] = got
    return got


class Tree:
    """Block elements in page order (parents before children) and the text runs between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds, self.label = ["html"], [-1], [()], [None]
        self.runs: list[tuple[int, list[str]]] = []
        self.chars, self.linked = [0], [0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, link, open_run = 0, False, False
        nodes, names = [0], ["html"]  # open elements: their node (unseen ones have their parent's) and tag
        places: dict[str, list[int]] = {}  # where in these lists the elements of a tag are
        unseen = 0  # place of the outermost open element without text, if any
        find = TOKEN.search

        def push(node: int, tag: str) -> None:
            places.setdefault(tag, []).append(len(names))
            nodes.append(node)
            names.append(tag)

        def cut(place: int) -> None:
            """Ends the open elements from a place on."""
            nonlocal unseen
            for tag in names[place:]:
                places[tag].pop()
            del nodes[place:], names[place:]
            unseen = 0 if unseen >= place else unseen

        def nearest(tags) -> int:
            return max([x[-1] for t in tags if (x := places.get(t))], default=0)

        while True:
            m = find(source, at)
            end = m.start() if m else len(source)
            if end > at and not unseen:
                words = html.unescape(source[at:end]) if "&" in source[at:end] else source[at:end]
                node = nodes[-1]
                if open_run:
                    self.runs[-1][1].append(words)
                else:
                    self.runs.append((node, [words]))
                    open_run = True
                size = len(words) - words.count(" ") if not words.isspace() else 0
                self.chars[node] += size
                if link:
                    self.linked[node] += size
            if not m:
                return
            at = m.end()
            if m[2] is None:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW:
                if not closing:
                    at = self._raw_end(source, tag, at)
            elif closing:
                if tag in DROPPED or tag in BLOCK:
                    if place := nearest((tag,)):
                        cut(place)
                    if tag in BLOCK and not unseen:
                        open_run, link = False, link and not place
                elif tag == "a" and not unseen:
                    link = False
            elif tag in DROPPED:
                if not m[3].endswith("/"):
                    push(nodes[-1], tag)
                    unseen = unseen or len(names) - 1
            elif tag in BLOCK:
                if unseen and names[unseen] == "head":
                    cut(unseen)
                if names[-1] == "p" and tag not in ("html", "body"):
                    cut(len(names) - 1)
                if tag in ENDS:
                    ends, stops = ENDS[tag]
                    place = nearest(ends)
                    if place > nearest(stops):
                        cut(place)
                if not unseen:
                    open_run = link = False
                if tag == "html" or tag == "body" and names[1:2] == ["body"]:
                    continue
                if unseen or self._is_hidden(m[3]):
                    push(nodes[-1], tag)
                    unseen = unseen or len(names) - 1
                    continue
                self.tag.append(tag)
                self.parent.append(nodes[-1])
                self.kinds.append(_kinds(m[3]) if m[3] else ())
                self.label.append("data-label=\"1\"" in m[3] if "data-label" in m[3] else None)
                self.chars.append(0)
                self.linked.append(0)
                push(len(self.tag) - 1, tag)
            elif not unseen:
                if tag == "br" or tag == "hr":
                    open_run = False
                elif tag == "a":
                    link = True

    @staticmethod
    def _is_hidden(attributes: str) -> bool:
        """By the attributes hidden, aria-hidden and style; a class or a value that only contains the word doesn't count."""
        if not UNSEEN.search(attributes):
            return False
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value)):
                return True
        return False

    @staticmethod
    def _raw_end(source: str, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
        return m.end() if m else len(source)

    def features(self) -> tuple[list[list[str]], list[str]]:
        """Per node the names of its features, and the kind of its edge to its parent."""
        n = len(self.tag)
        below, links, marks = self.chars[:], self.linked[:], [0] * n
        for node, words in self.runs:
            for w in words:
                marks[node] += w.count(".") + w.count(",")
        for i in range(n - 1, 0, -1):
            below[self.parent[i]] += below[i]
            links[self.parent[i]] += links[i]
        rows, edges = [], []
        total = max(1, below[0])
        for i in range(n):
            tag, kinds = self.tag[i], self.kinds[i]
            own = self.chars[i]
            row = ["bias", f"tag {tag}"]
            row += [f"kind {k}" for k in kinds]
            row.append(f"own {min(6, int(math.log10(own + 1) * 2))}")
            row.append(f"links {min(3, int(4 * links[i] / below[i]))}" if below[i] else "empty")
            row.append(f"share {min(3, int(4 * below[i] / total))}")
            if own:
                row.append(f"marks {min(3, 60 * marks[i] // own)}")
            rows.append(row)
            boiler = tag in BOILER or any(k != "content" and k != "meta" for k in kinds)
            edges.append("boiler" if boiler else "content" if tag in ("article", "main") or "content" in kinds else "plain")
        if any(e == "content" for e in edges):
            return rows, edges
        return self._placed(rows, below), ["unnamed boiler" if e == "boiler" else "unnamed" for e in edges]

    def _placed(self, rows: list[list[str]], below: list[int]) -> list[list[str]]:
        """Features of a page where nothing is named as content: those given, and those of each node's place."""
        n = len(self.tag)
        head = next((self.tag.index(t) for t in ("h1", "h2", "h3") if t in self.tag), None)
        levels, node = {}, head  # nodes above the first heading: how far up
        while node is not None and node >= 0:
            levels[node] = len(levels)
            node = self.parent[node]
        inside: list[list[str]] = [[] for _ in range(n)]
        for i in range(1, n):
            if len(inside[self.parent[i]]) < 6:
                inside[self.parent[i]].append(self.tag[i])
        shape = [(self.parent[i], self.tag[i], *inside[i]) for i in range(n)]
        alike = Counter(shape)
        first = [""] * n
        for i, words in self.runs:
            if not first[i] and not (said := "".join(words)).isspace():
                first[i] = said[:40]
        for i in range(n - 1, 0, -1):  # a block begins with the words of its first child, if it has none before
            first[self.parent[i]] = first[i] or first[self.parent[i]]
        near = [0] * n
        for i in range(n):
            near[i] = levels[i] if i in levels else near[self.parent[i]] if i else 99
            if head is None:
                place = "none"
            elif i in levels:
                place = f"above {min(3, levels[i])}"
            else:
                place = f"{'before' if i < head else 'after'} {min(3, near[i])}"
            row = [f"place {place}", f"place {place} {self.tag[i]}", f"alike {min(4, alike[shape[i]])} {self.tag[i]}", f"below {min(6, int(math.log10(below[i] + 1) * 2))}"]
            if below[i] < 600 and (cue := CUE.match(first[i])):
                row.append(f"cue {cue.lastgroup}")
            rows[i] = [f"unnamed {f}" for f in rows[i] + row]
        return rows

    def text(self, keep) -> str:
        out = []
        for node, words in self.runs:
            if keep(node):
                out += "".join(words).split()
                # blocks and the words in them are joined alike, by one blank
        return " ".join(out)


EDGES = ("plain", "boiler", "content", "unnamed", "unnamed boiler")


def marginals(unary: list[float], parent: list[int], edges: list[str], pair: dict) -> tuple[list[float], list[list[list[float]]], float]:
    """Sum-product on a tree. unary: log-potential of label 1 (label 0 has 0); pair: by edge kind, 2 x 2 potentials by
    (parent's, child's) label. Returns P(label 1) of each node, P(parent's, child's labels) of each edge, and log Z."""
    n = len(unary)
    low = [max(-30.0, min(30.0, u)) for u in unary]
    one = [math.exp(u) for u in low]
    inside0, inside1 = [1.0] * n, one[:]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    scale = 0.0
    for i in range(n - 1, 0, -1):
        e = pair[edges[i]]
        a, b = inside0[i], inside1[i]
        m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
        s = m0 + m1
        scale += math.log(s)
        m0, m1 = m0 / s, m1 / s
        up[i] = (m0, m1)
        p = parent[i]
        inside0[p] *= m0
        inside1[p] *= m1
        if inside0[p] + inside1[p] < 1e-100:  # many children: keep the pair in range
            s = inside0[p] + inside1[p]
            inside0[p], inside1[p] = inside0[p] / s, inside1[p] / s
            scale += math.log(s)
    z = inside0[0] + inside1[0]
    belief0, belief1 = [0.0] * n, [0.0] * n
    belief0[0], belief1[0] = inside0[0] / z, inside1[0] / z
    joint: list[list[list[float]]] = [[[0.0, 0.0], [0.0, 0.0]]] * n
    for i in range(1, n):
        p, e = parent[i], pair[edges[i]]
        m0, m1 = up[i]
        out0, out1 = belief0[p] / max(m0, 1e-300), belief1[p] / max(m1, 1e-300)
        a, b = inside0[i], inside1[i]
        t = [[out0 * e[0][0] * a, out0 * e[0][1] * b], [out1 * e[1][0] * a, out1 * e[1][1] * b]]
        s = t[0][0] + t[0][1] + t[1][0] + t[1][1]
        t = [[x / s for x in row] for row in t]
        joint[i] = t
        belief0[i], belief1[i] = t[0][0] + t[1][0], t[0][1] + t[1][1]
    return belief1, joint, scale + math.log(z)


class Model:
    def __init__(self):
        self.weight: dict[str, float] = {}
        self.pair = {k: [[0.0, 0.0], [0.0, 0.0]] for k in EDGES}

    def potentials(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in row]) for row in rows]

    def tables(self) -> dict:
        return {k: [[math.exp(x) for x in row] for row in e] for k, e in self.pair.items()}

    def content(self, source: str, tables: dict | None = None) -> str:
        tree = Tree(source)
        rows, edges = tree.features()
        p = marginals(self.potentials(rows), tree.parent, edges, tables or self.tables())[0]
        return tree.text(lambda i: p[i] >= 0.5)


def train(pages: list[str], rounds: int = 6, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Fits the weights on pages whose block elements carry data-label="1" or "0" (unlabelled ones count as 0)."""
    model = Model()
    seen = [(tree, *tree.features()) for tree in map(Tree, pages)]
    grown: dict = {}

    def step(key, value: float, gradient: float) -> float:
        gradient -= ridge * value
        grown[key] = grown.get(key, 1e-3) + gradient * gradient
        return value + rate * gradient / math.sqrt(grown[key])

    order = random.Random(7)
    for _ in range(rounds):
        order.shuffle(seen)
        for tree, rows, edges in seen:
            p, joint, _ = marginals(model.potentials(rows), tree.parent, edges, model.tables())
            gap: dict[str, float] = {}
            for i, row in enumerate(rows):
                d = (1.0 if tree.label[i] else 0.0) - p[i]
                for f in row:
                    gap[f] = gap.get(f, 0.0) + d
            for f, d in gap.items():
                model.weight[f] = step(f, model.weight.get(f, 0.0), d)
            pairs = {k: [[0.0, 0.0], [0.0, 0.0]] for k in EDGES}
            for i in range(1, len(rows)):
                a, b = int(bool(tree.label[tree.parent[i]])), int(bool(tree.label[i]))
                e = pairs[edges[i]]
                e[a][b] += 1
                for x in (0, 1):
                    for y in (0, 1):
                        e[x][y] -= joint[i][x][y]
            for k, e in pairs.items():
                for x in (0, 1):
                    for y in (0, 1):
                        model.pair[k][x][y] = step((k, x, y), model.pair[k][x][y], e[x][y])
    return model


def labelled_pages(count: int = 400, seed: int = 20_240_605) -> list[str]:
    """Made-up pages of many layouts; content blocks carry data-label="1"."""
    r = random.Random(seed)
    letters = ["ta", "ri", "mo", "len", "su", "kad", "ve", "pon", "is", "ar", "ul", "é", "gra", "ny"]

    def words(n: int) -> str:
        out = []
        while len(out) < n:
            k = min(n - len(out), r.randint(1, 14))
            some = ["".join(r.choices(letters, k=r.randint(1, 4))) for _ in range(k)]
            some[0] = some[0].capitalize()
            some[-1] += r.choice(".,.;.")
            out += some
        return " ".join(out)

    def size(lo: int, hi: int) -> int:
        return int(math.exp(r.uniform(math.log(lo), math.log(hi))))

    def named(*names: str) -> str:
        if r.random() < 0.15:
            return ""
        name = r.choice(names)
        return f' {r.choice(("class", "class", "id"))}="{r.choice(("", "", "site-", "page-", "x "))}{name}{r.choice(("", "", "-1", " wide"))}"'

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{words(r.randint(1, 3))}</a></{tag}>' for i in range(n))

    def nav() -> str:
        return r.choice((f"<nav{named('menu', 'nav', 'main-nav') if r.random() < 0.5 else ''}><ul>{links(r.randint(3, 8))}</ul></nav>", f"<div class=\"{r.choice(('menu', 'navbar', 'breadcrumbs', 'top-nav'))}\">{links(r.randint(3, 8), 'span')}</div>", f"<ul class=\"{r.choice(('menu', 'nav', 'pagination'))}\">{links(r.randint(3, 8))}</ul>"))

    def top() -> str:
        return r.choice((f"<header><div{named('logo', 'branding')}>{words(2)}</div><p>{words(size(2, 12))}</p></header>", f"<div class=\"{r.choice(('header', 'masthead', 'topbar'))}\"><h2>{words(2)}</h2>{words(size(2, 20))}</div>", f"<header>{words(4)}{nav()}</header>"))

    def side() -> str:
        inner = r.choice((f"<h3>{words(2)}</h3><ul>{links(r.randint(2, 6))}</ul>", f"<p>{words(size(5, 60))}</p>", f"<div><h4>{words(2)}</h4><p>{words(size(4, 40))}</p></div>"))
        return r.choice((f"<aside>{inner}</aside>", f"<aside{named('sidebar', 'related')}>{inner}</aside>", f"<div class=\"{r.choice(('sidebar', 'widget', 'related', 'right-rail', 'recommended'))}\">{inner}</div>"))

    def notice() -> str:
        tag = r.choice(("div", "div", "section", "p"))
        return f"<{tag} class=\"{r.choice(('cookie-notice', 'consent', 'notice', 'alert', 'popup', 'newsletter', 'gdpr-banner', 'subscribe'))}\">{words(size(4, 50))}</{tag}>"

    def advert() -> str:
        tag = r.choice(("div", "div", "aside", "section", "p"))
        return f"<{tag} class=\"{r.choice(('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'banner-ad'))}\">{words(size(2, 50))}</{tag}>"

    def form() -> str:
        return f"<form{named('search', 'login', 'signup') if r.random() < 0.5 else ''}><label>{words(2)}</label><input name=q><p>{words(size(2, 20))}</p></form>"

    def share() -> str:
        return f"<div class=\"{r.choice(('share', 'social', 'follow-us', 'share-buttons'))}\">{links(r.randint(2, 4), 'span')}</div>"

    def comments() -> str:
        one = "".join(r.choice((f"<li><p>{words(size(4, 80))}</p></li>", f"<div class=comment><b>{words(1)}</b><p>{words(size(4, 80))}</p></div>", f"<article class=\"comment\"><p>{words(size(4, 60))}</p></article>", f"<p>{words(size(4, 80))}</p>")) for _ in range(r.randint(1, 5)))
        head = f"<h3>{words(2)}</h3>" if r.random() < 0.6 else ""
        return r.choice((f"<section class=\"{r.choice(('comments', 'comment-list', 'discussion', 'replies'))}\">{head}{one}</section>", f'<div id="{r.choice(("comments", "respond", "disqus_thread"))}">{head}{one}</div>', f'<ol class="commentlist">{one}</ol>'))

    def foot() -> str:
        inner = r.choice((f"&copy; {words(2)}", f"<p>&copy; {words(size(3, 40))}</p>", f"<ul>{links(4)}</ul><p>{words(6)}</p>", f"{words(1)} &middot; {words(size(3, 30))}"))
        return r.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div class=\"{r.choice(('footer', 'site-footer', 'copyright', 'legal'))}\">{inner}</div>"))

    def piece(short: bool = False) -> str:
        y = ' data-label="1"'
        para = words(size(1, 8) if short else size(3, 150))
        if r.random() < 0.3:
            para = f'{para} <a href="/x">{words(2)}</a> <b>{words(2)}</b> {words(5)}'
        return r.choice((f"<p{y}>{para}</p>",) * 8 + (f"<h2{y}>{words(r.randint(2, 7))}</h2>", f"<h3{y}>{words(r.randint(2, 5))}</h3>", f"<h4{y}>{words(r.randint(2, 5))}</h4><p{y}>{para}</p>", f"<section{y}><h2{y}>{words(3)}</h2><p{y}>{para}</p></section>", f"<figure{y}><img src=x><figcaption{y}>{words(size(3, 20))}</figcaption></figure>", f"<dl{y}><dt{y}>{words(2)}<dd{y}>{para}</dl>", f"<p{y}><b>{para}<br>", f"<ul{y}>" + "".join(f"<li{y}>{words(size(2, 30))}</li>" for _ in range(r.randint(2, 5))) + "</ul>", f"<blockquote{y}><p{y}>{words(size(5, 60))}</p></blockquote>", f"<pre{y}>{words(size(4, 40))}</pre>", f"<table{y}><tr{y}><td{y}>{words(2)}</td><td{y}>{words(3)}</td></tr></table>", f"<div{y}>{para}</div>"))

    def article() -> str:
        y = ' data-label="1"'
        head = f"<h1{y}>{words(r.randint(2, 12))}</h1>" if r.random() < 0.85 else ""
        body = []
        short = r.random() < 0.25
        for _ in range(size(1, 12) if r.random() < 0.75 else size(10, 120)):
            body.append(piece(short))
            if r.random() < 0.1:
                body.append(r.choice((advert, share, side, notice, form))())
        inner = head + "".join(body)
        if r.random() < 0.15:
            inner += comments()
        kind = r.random()
        if kind < 0.5:
            return f"<article{y}{named('post', 'entry', 'story') if r.random() < 0.3 else ''}>{inner}</article>"
        if kind < 0.65:
            return f"<main{y}>{inner}</main>"
        if kind < 0.75:
            return f"<main><article{y}>{inner}</article></main>"
        name = r.choice(("content", "post-body", "entry-content", "article", "story", "main-content", "article-text"))
        return f'<div{y} {r.choice(("class", "id"))}="{name}">{inner}</div>' if kind < 0.95 else f"<div{y}>{inner}</div>"

    pages = []
    for _ in range(count):
        before = [f() for f in (top, nav, notice, advert, form) if r.random() < 0.45]
        after = [f() for f in (side, share, comments, advert, form, notice) if r.random() < 0.4]
        if r.random() < 0.9:
            after.append(foot())
        r.shuffle(before)
        middle = article()
        if r.random() < 0.3:
            middle = f"<div{named('wrapper', 'container', 'row')}>{middle}{side() if r.random() < 0.5 else ''}</div>"
        pages.append(f"<html><head><title>{words(4)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>")
    return pages


#: What a block of each kind may begin with on pages without names.
LEADS = {
    "comment": ("Comments", "3 comments", "Replies", "Discussion"), "notice": ("We use cookies.", "Subscribe", "Sign up", "Newsletter"), "ad": ("Advertisement", "Sponsored"),
    "side": ("Related", "Popular", "Read next", "You may also like"), "share": ("Share", "Follow us"), "foot": ("Copyright", "&copy;"),
}
START = re.compile(r"<(/?)(nav|header|footer|aside|article|main|section|div|ul|ol|li|p)\b([^>]*)>")


def unnamed_pages(count: int = 250, seed: int = 31_415) -> list[str]:
    """Pages of the same layouts in which nothing is named as content: article and main are div, names are gone or hashed.
    On most pages that holds for menus, headers, comments and so on too; their blocks may begin with telling words."""
    r = random.Random(seed)
    out = []
    for page in labelled_pages(count, seed):
        bare_tags, bare_names, hashed, leads = r.random() < 0.7, r.random() < 0.7, r.random() < 0.5, r.random() * 1.2
        if r.random() < 0.3:
            page = page.replace("<h1", "<h2").replace("</h1", "</h2")
        if r.random() < 0.3:
            page = re.sub(r"<(/?)p\b", r"<\1div", page)

        def renamed(m: re.Match) -> str:
            tag, kinds = m[2], _kinds(m[3]) if m[3] else ()  # noqa: B023
            name = m[3].replace(' data-label="1"', "")
            label = ' data-label="1"' if name != m[3] else ""
            if tag in ("article", "main") or bare_tags and tag in ("nav", "header", "footer", "aside", "section"):  # noqa: B023
                tag = "div"
            if m[1]:
                return f"</{tag}>"
            if bare_names or "content" in kinds:  # noqa: B023
                name = f' class="{r.choice("cxq")}{r.randrange(16**5):05x}"' if hashed and name else ""  # noqa: B023
            kinds = (*kinds, *{"footer": ("foot",), "aside": ("side",)}.get(m[2], ()))
            lead = next((r.choice(LEADS[k]) for k in kinds if k in LEADS), "") if not label and r.random() < leads else ""  # noqa: B023
            return f"<{tag}{label}{name}>" + (f"<h3>{lead}</h3>" if lead and m[2] != "p" and r.random() < 0.6 else f"{lead} " if lead else "")

        out.append(START.sub(renamed, page))
    return out


_fitted: list[Model] = []


def fitted() -> Model:
    """The model trained on the generators' pages; once per process."""
    if not _fitted:
        _fitted.append(train(labelled_pages() + unnamed_pages()))
    return _fitted[0]


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    model = model or fitted()

    def run(batches):
        tables = model.tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model.content(source or "", tables) for source in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
