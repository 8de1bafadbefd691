"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements (and other elements with a class, id or
role). Each node gets features of its tag, attribute tokens, depth, siblings and
the density of text, links and elements in its subtree. Boosted trees give the
probability that a node leads to main text. Decoding is hierarchical: the best
consistent set of nodes is found from the leaves up, in which a node can only be
kept if all its ancestors are, so no descendant contradicts an ancestor.

The model is trained on pages that ``training_pages`` draws from a fixed number
of layouts with known parts; its size doesn't depend on the data.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices

# Quotes count only after an equals sign; the possessive loop never goes back, so a tag is read once.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Kinds of elements.
_BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
BLOCKS = frozenset(_BLOCKS.split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math select button object canvas audio video head".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_OPAQUE = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())  # their content is no markup
FORMS = frozenset("input select textarea button label option".split())
TAGS = ("article", "aside", "blockquote", "body", "div", "dl", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "header", "li", "main", "nav", "ol", "p", "pre", "section", "span", "table", "td", "tr", "ul", "")
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tbody": ("tbody thead tfoot tr td th", {"table"}), "option": ("option", {"select"})}
_SCOPE = frozenset("html table td th caption object template button".split())
KEEP = "data-keep"  # label of training pages; never a feature


class Page:
    """A tree of decision nodes and the text blocks that hang on them."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.tokens, self.label = [-1], ["body"], [[]], [None]
        self.chars, self.links, self.elements, self.forms = [0], [0], [0], [0]
        self.blocks: list[list[tuple[int, str]]] = [[]]
        self._parse(source)

    def _node(self, tag: str, attrs: str, parent: int) -> int:
        tokens, label = [], None
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                tokens += _WORD.findall(_CAMEL.sub(" ", value).lower())
            elif name == KEEP:
                label = value == "1"
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append([t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t for t in tokens])
        self.label.append(label)
        for x in (self.chars, self.links, self.elements, self.forms):
            x.append(0)
        return len(self.parent) - 1

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _text(self, raw: str, node: int, linked: int) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        self.blocks[-1].append((node, text))
        n = len(text) if not text.isspace() else 0
        self.chars[node] += n
        if linked:
            self.links[node] += n

    def _parse(self, s: str) -> None:
        """One pass. The counts of open elements tell whether an end or a paragraph
        has anything to close, so no element is looked at more than a few times."""
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements and their nodes
        opened: Counter[str] = Counter()  # open elements by tag
        paragraphs = [0]  # open paragraphs since each open element that ends their scope
        linked = skip = 0  # depth of links, and of elements whose text never counts

        def push(tag: str, node: int) -> None:
            nonlocal linked, skip
            stack.append((tag, node))
            opened[tag] += 1
            linked += tag == "a"
            skip += tag in RAW
            paragraphs[-1] += tag == "p"
            if tag in _SCOPE:
                paragraphs.append(0)

        def pop() -> str:
            nonlocal linked, skip
            tag, _ = stack.pop()
            opened[tag] -= 1
            linked -= tag == "a"
            skip -= tag in RAW
            if tag in _SCOPE:
                paragraphs.pop()
            paragraphs[-1] -= tag == "p"
            return tag

        def close(tag: str) -> None:
            while pop() != tag:
                pass

        at, n, find = 0, len(s), _TOKEN.search
        while at < n:
            m = find(s, at)
            end = m.start() if m else n
            if end > at:
                if opened["head"] and not s[at:end].isspace() and stack[-1][0] == "head":
                    close("head")  # text ends an open head
                if not skip:
                    self._text(s[at:end], stack[-1][1], linked)
            if m is None:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                if not skip and m.group().startswith("<![CDATA["):
                    self._text(m.group()[9:].removesuffix("]]>"), stack[-1][1], linked)
                continue
            if not m[4]:  # a tag that never ends
                break
            tag = tag.lower()
            if m[1]:
                if opened[tag]:
                    close(tag)
                    if tag in BLOCKS:
                        self._break()
                continue
            if opened["head"] and tag not in HEAD and stack[-1][0] == "head":
                close("head")
            node = stack[-1][1]
            if tag in FORMS:
                self.forms[node] += 1
            if tag in _OPAQUE:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, at)
                after = s.find(">", found.end()) if found else -1
                at = after + 1 if after >= 0 else n
                continue
            if tag == "body" or tag == "html":
                if tag == "body" and skip:  # the head was left open
                    while len(stack) > 1:
                        pop()
                continue
            if tag in BLOCKS:
                self._break()
                if paragraphs[-1]:  # an open paragraph ends here
                    close("p")
            if tag in _CLOSES:
                ends, within = _CLOSES[tag]
                if any(opened[x] for x in ends.split()):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in within:
                            break
                        if stack[i][0] in ends.split():
                            while len(stack) > i:
                                pop()
                            break
            node = stack[-1][1]
            self.elements[node] += 1
            if tag == "br":
                if not skip:
                    self._text("\n", node, linked)
                continue
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
                continue
            if not skip and (tag in BLOCKS or re.search(r"\b(class|id|role)\s*=", m[3], re.I)):
                node = self._node(tag, m[3], node)
            push(tag, node)

    def features(self, vocabulary: dict[str, int]) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        own = np.array([self.chars, self.links, self.elements, self.forms], float).T
        total = own.copy()
        total[:, 2] += 1
        blocks = np.zeros(n)
        marks = np.zeros(n)
        for b in self.blocks:
            if b:
                blocks[b[0][0]] += 1
                for node, text in b:
                    marks[node] += text.count(". ") + text.count(", ") + text.endswith(".")
        total = np.column_stack((total, blocks, marks, np.array([t == "p" for t in self.tag], float)))
        depth = np.zeros(n)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
        before = np.zeros(n)  # text ahead of a node's own
        seen = np.cumsum(own[:, 0])
        before[1:] = seen[:-1]
        kids, same, first = Counter(self.parent), Counter(zip(self.parent, self.tag, strict=True)), Counter()
        index = np.zeros(n)
        for i in range(n):
            index[i] = first[self.parent[i]]
            first[self.parent[i]] += 1
        siblings = np.array([kids[p] for p in self.parent], float)
        alike = np.array([same[p, t] for p, t in zip(self.parent, self.tag, strict=True)], float)
        chars = total[:, 0]
        up = np.maximum(parent, 0)
        x = np.zeros((n, NUMERIC + len(TAGS) + len(vocabulary) + 1), np.float32)
        x[:, :NUMERIC] = np.column_stack((
            depth, np.log1p(chars), total[:, 1] / (chars + 1), total[:, 2] / (chars / 100 + 1), np.log1p(total[:, 4]), chars / (total[:, 4] + 1), total[:, 5] / (chars / 100 + 1), np.log1p(total[:, 6]), total[:, 3],
            chars / (chars[0] + 1), before / (chars[0] + 1), index, index / siblings, siblings, alike / siblings, chars / (chars[up] + 1), total[up, 1] / (chars[up] + 1), np.log1p(own[:, 0]),
        ))
        place = {t: NUMERIC + i for i, t in enumerate(TAGS)}
        for i, (t, tokens) in enumerate(zip(self.tag, self.tokens, strict=True)):
            x[i, place.get(t, place[""])] = 1
            for w in tokens:
                x[i, NUMERIC + len(TAGS) + vocabulary.get(w, len(vocabulary))] = 1
        return x

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The likeliest set of kept nodes in which every kept node's ancestors are
        kept; ``p``: chance that a node is kept if its parent is."""
        p = np.clip(p, 1e-6, 1 - 1e-6)
        keep, drop = np.log(p), np.log(1 - p)
        for i in range(len(p) - 1, 0, -1):
            a = self.parent[i]
            keep[a] += max(keep[i], drop[i])
        kept = np.zeros(len(p), bool)
        kept[0] = True
        for i in range(1, len(p)):
            kept[i] = kept[self.parent[i]] and keep[i] >= drop[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        out = (" ".join("".join(t for node, t in b if kept[node]).split()) for b in self.blocks)
        return "\n\n".join(t for t in out if t)


NUMERIC = 18


class Trees:
    """Gradient-boosted regression trees on logistic loss, by histograms of binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, reg: float = 1.0) -> None:
        self.depth = depth
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        n, d = b.shape
        flat = b.astype(np.int64) + np.arange(d) * bins
        self.base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        f, self.trees = np.full(n, self.base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
            for level in range(depth):
                for q in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = leaf == q - (2**level - 1)
                    if rows.sum() < 4:
                        continue
                    at = flat[rows].ravel()
                    sg = np.bincount(at, np.repeat(g[rows], d), d * bins).reshape(d, bins).cumsum(1)
                    sh = np.bincount(at, np.repeat(h[rows], d), d * bins).reshape(d, bins).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + reg) + (tg - sg) ** 2 / (th - sh + reg) - tg**2 / (th + reg)
                    gain[(sh < 1e-3) | (th - sh < 1e-3)] = -1
                    k = int(gain.argmax())
                    if gain.flat[k] > 1e-6:
                        feature[q], cut[q] = k // bins, k % bins
                q = leaf + 2**level - 1
                leaf = leaf * 2 + (b[np.arange(n), feature[q]] > cut[q])
            sg, sh = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
            value = rate * sg / (sh + reg)
            f += value[leaf]
            self.trees.append((feature, cut, value))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)]).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                q = leaf + 2**level - 1
                leaf = leaf * 2 + (b[rows, feature[q]] > cut[q])
            f += value[leaf]
        return 1 / (1 + np.exp(-f))


#: Attribute names of page parts as layouts commonly give them.
MAIN_NAMES = "article content post entry story main article-body post-content entry-content main-content body-text page-content text story-body prose markdown-body single"
INNER_NAMES = "lead intro paragraph section body wp-block-text caption quote"
WRAP_NAMES = "wrapper container page site wrap layout row col inner outer grid app root"
JUNK_NAMES = (
    "ad ads advert advertisement ad-slot banner-ad sponsored sponsor promo promotion banner adsense dfp",
    "nav menu navbar navigation main-menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs",
    "header masthead site-header page-header top logo branding",
    "footer site-footer page-footer bottom copyright colophon legal",
    "sidebar aside side-column rail widget widget-area secondary right-column",
    "notice cookie cookie-notice cookie-banner consent gdpr alert popup modal overlay message",
    "comments comment comment-list disqus reader-comments replies responses discussion user-comments",
    "form newsletter subscribe signup login search search-form contact-form",
    "related recommended related-posts more-stories read-more also-like trending popular",
    "share social sharing social-links share-buttons follow tags meta byline-links author-box",
)


def training_pages(n: int = 1000, seed: int = 5) -> list[str]:
    """Pages of many layouts whose parts are labelled; always the same ones."""
    r = random.Random(seed)
    pick = lambda names: r.choice(names.split())

    def words(a: int, b: int) -> str:
        out = []
        for _ in range(r.randint(a, b)):
            w = "".join(r.choice(("an", "er", "th", "on", "re", "ti", "é", "ou", "la", "sch", "ó", "in")) for _ in range(r.randint(1, 5)))
            out.append(w + r.choice(("", "", "", "", "", "", ",", ".")))
        return " ".join(out).capitalize() + "."

    def named(tags: str, names: str, keep: str, inside: str, sure: bool = False) -> str:
        tag = pick(tags)
        semantic = tag in ("nav", "header", "footer", "aside", "form", "article", "main")
        attr = ""
        if sure or not semantic or r.random() < 0.5:
            attr = f' {r.choice(("class", "class", "id"))}="{pick(names)}{r.choice(("", "", " " + pick(WRAP_NAMES), "-" + str(r.randint(1, 9))))}"'
        return f'<{tag}{attr} {KEEP}="{keep}">{inside}</{tag}>'

    def links(k: int) -> str:
        items = "".join(f'<li><a href="/x">{words(1, 3)[:-1]}</a></li>' for _ in range(k))
        return r.choice((f"<ul>{items}</ul>", " ".join(f'<a href="/y">{words(1, 3)}</a>' for _ in range(k))))

    def junk(kind: int) -> str:
        names = JUNK_NAMES[kind]
        if kind == 0:
            return named("div div aside section ins", names, "0", r.choice((words(3, 30), f"<p>{words(3, 20)}</p>", f'<a href="/z">{words(2, 8)}</a>')), True)
        if kind == 1:
            return named("nav nav div ul", names, "0", links(r.randint(3, 9)))
        if kind == 2:
            return named("header div", names, "0", f"<a href='/'>{words(1, 2)}</a>" + r.choice(("", f"<p>{words(3, 9)}</p>", links(4), f"<h1>{words(1, 4)}</h1>")))
        if kind == 3:
            return named("footer footer div", names, "0", r.choice((f"&copy; {words(2, 12)}", f"<p>&copy; 2020 {words(3, 14)}</p>{links(4)}", links(6))))
        if kind == 4:
            return named("aside aside div section", names, "0", f"<h3>{words(1, 3)}</h3>" + r.choice((links(5), f"<p>{words(5, 40)}</p>", f"<p>{words(5, 20)}</p>{links(3)}")))
        if kind == 5:
            return named("div div section p aside", names, "0", r.choice((words(4, 30), f"<p>{words(4, 30)}</p><button>OK</button>")), True)
        if kind == 6:
            one = lambda: f'<{(t := r.choice(("div", "li", "article", "p")))} class="{r.choice(("comment", "comment-body", "reply", "comment"))}" {KEEP}="0">{r.choice(("", f"<b>{words(1, 2)}</b>"))}{r.choice((words(4, 60), f"<p>{words(4, 60)}</p>"))}</{t}>'
            return named("section div div ol aside", names, "0", r.choice(("", f"<h3>{words(1, 2)}</h3>")) + "".join(one() for _ in range(r.randint(1, 8))), True)
        if kind == 7:
            return named("form form div section", names, "0", f"<label>{words(1, 3)}</label><input type='text'><p>{words(2, 12)}</p><button>Go</button>")
        if kind == 8:
            return named("div section aside ul", names, "0", f"<h3>{words(1, 4)}</h3>{links(r.randint(2, 6))}" + r.choice(("", f"<p>{words(3, 15)}</p>")), True)
        return named("div ul p section", names, "0", r.choice((links(4), words(1, 8))), True)

    def para() -> str:
        t, k = r.random(), f'{KEEP}="1"'
        text = words(1, r.choice((2, 8, 15, 60, 140)))
        if r.random() < 0.25:
            text += f' <a href="/in">{words(1, 4)}</a> {words(1, 10)}'
        if t < 0.68:
            return r.choice((f"<p {k}>{text}</p>", f"<p {k}>{text}</p>", f'<p class="{pick(INNER_NAMES)}" {k}>{text}</p>', f"<p {k}><b>{words(1, 12)}<br>"))
        if t < 0.78:
            return f"<{(h := r.choice(('h2', 'h3')))} {k}>{words(1, 8)}</{h}>"
        if t < 0.86:
            return f"<{(u := r.choice(('ul', 'ol')))} {k}>" + "".join(f"<li {k}>{words(2, 15)}</li>" for _ in range(r.randint(1, 6))) + f"</{u}>"
        if t < 0.91:
            return f"<blockquote {k}>{r.choice((text, f'<p {k}>{text}</p>'))}</blockquote>"
        if t < 0.95:
            return f"<table {k}>" + "".join(f"<tr {k}><td {k}>{words(1, 5)}</td><td {k}>{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if t < 0.97:
            return f"<pre {k}>{words(4, 20)}</pre>"
        if t < 0.985:
            return r.choice((f"<div {k}>{text}</div>", f'<div class="{pick(INNER_NAMES)}" {k}>{text}<br>{words(2, 20)}</div>', text))
        return f'<figure {k}><img src="a.png"><figcaption {k}>{words(2, 12)}</figcaption></figure>'

    pages = []
    for _ in range(n):
        title = f'<h1 {KEEP}="1">{words(1, 12)}</h1>'
        title = r.choice((title, title, title, f'<header {KEEP}="1">{title}</header>', ""))
        body = [para() for _ in range(r.choice((1, 1, 2, 4, 8, 14)))]
        for _ in range(r.choice((0, 0, 1, 2))):
            body.insert(r.randint(0, len(body)), junk(r.choice((0, 0, 5, 6, 7, 8, 9))))
        if r.random() < 0.3:
            body = [f'<{(d := r.choice(("div", "section")))}{r.choice(("", f""" class="{pick(INNER_NAMES + " " + MAIN_NAMES)}" """))} {KEEP}="1">' + "".join(body) + f"</{d}>"]
        if r.random() < 0.25:
            body.append(junk(6))
        main = named(r.choice(("article", "article", "main", "div", "div section")), MAIN_NAMES, "1", title + "".join(body))
        if r.random() < 0.3:
            main = f'<{(d := r.choice(("main", "div")))} {KEEP}="1">{main}</{d}>'
        top = [junk(k) for k in (2, 1, 5, 0) if r.random() < 0.55]
        end = [junk(k) for k in (8, 6, 7, 4, 5, 0, 9) if r.random() < 0.25] + ([junk(3)] if r.random() < 0.8 else [])
        if r.random() < 0.25:
            top.append(junk(4))
        r.shuffle(top)
        inside = "".join(top) + main + "".join(end)
        for _ in range(r.choice((0, 0, 1, 2))):
            inside = f'<div class="{pick(WRAP_NAMES)}" {KEEP}="1">{inside}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{inside}</body></html>")
    return pages


class Extractor:
    """A trained model; ``texts`` gives the main text of pages."""

    def __init__(self, pages: list[str] | None = None, least: int = 3) -> None:
        trained = [Page(s) for s in (training_pages() if pages is None else pages)]
        often = Counter(t for p in trained for tokens in p.tokens for t in set(tokens))
        self.vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in often.items() if n >= least))}
        x = np.vstack([p.features(self.vocabulary) for p in trained])
        y = np.concatenate([self._labels(p) for p in trained])
        # A node is decided given that its parent is kept, so only such nodes teach.
        under = np.concatenate([self._labels(p)[np.maximum(p.parent, 0)] for p in trained]) > 0
        x, y = x[under], y[under]
        self.trees = Trees(x, y)

    @staticmethod
    def _labels(p: Page) -> np.ndarray:
        y = [False if v is None else v for v in p.label]
        for i in range(1, len(y)):
            if p.label[i] is None:
                y[i] = y[p.parent[i]] if p.parent[i] else False
        y[0] = True
        return np.array(y, float)

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s) if s else None for s in sources]
        x = [p.features(self.vocabulary) for p in pages if p]
        if not x:
            return [""] * len(pages)
        p, out, at = self.trees.predict(np.vstack(x)), [], 0
        for page in pages:
            if page is None:
                out.append("")
                continue
            n = len(page.parent)
            out.append(page.text(page.decode(p[at : at + n])))
            at += n
        return out


@cache
def default_model() -> Extractor:
    """The model of the drawn pages; trained once in a process."""
    return Extractor()


def extract(spark: SparkSession, pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty html has an empty text. Rows that repeat a page_id or have
    none are extracted row by row. Further columns are ignored. An empty table
    gives no rows."""
    model = model or default_model()  # of a fixed size

    def make():
        def run(ids: list, urls: list, sources: list[str | None]) -> dict:
            texts = [t for k in range(0, len(sources), 32) for t in model.texts(sources[k : k + 32])]
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return map_slices(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), ["page_id", "url", "html"], make, kind, "page_id long, url string, text string, n_chars long")
