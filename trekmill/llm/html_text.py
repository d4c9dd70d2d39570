"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a variable with three states: content, boilerplate, or a
mixture of both (page bodies, layout wrappers). Its own evidence (tag, words of
class, id and role, text length, link density) gives node potentials; parent-child
potentials say how states pass down. Both are log frequencies from labelled pages.
Sum-product messages go up to the root and down again, and a text run is kept where
its element's marginal for content is the largest.

The labelled pages are made by training_pages(), a rule that lays out common page
furniture around articles; fit() takes any others.

Defined cases: null and empty pages give an empty text; markup that never closes,
stray end tags and cut-off character references are read as browsers do, and a control
or drawing that never closes ends with the block around it; very long pages are read
whole, one at a time; equal marginals count as content; pages
without any element are one text run of the root; repeated rows get equal texts;
input columns named like an output column are replaced.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import arrow_batches, lean

CONTENT, BOILER, MIXED = 0, 1, 2
#: Elements whose inside is no page text.
SILENT = frozenset("script style noscript template head title iframe svg math object audio video canvas".split())
RAW = frozenset("script style title textarea noscript iframe".split())
#: Elements that stay inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr link meta base param track area input button select option optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes by itself.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article section div main aside nav form body html".split())
CONTROLS = frozenset("button select textarea option input".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Page:
    """Block elements in opening order (parent, features) and the text runs in page order."""

    __slots__ = ("feature", "linked", "parent", "runs", "size", "tag")

    def __init__(self, source: str):
        self.parent, self.tag, self.feature, self.size, self.linked, self.runs = [-1], ["#root"], [("#root", "")], [0], [0], []
        stack, at, buffer, silent, links = [0], 0, [], [], 0
        n = len(source)

        def flush():
            nonlocal buffer
            if buffer:
                text = "".join(buffer)
                buffer = []
                text = " ".join((html.unescape(text) if "&" in text else text).split())
                if text:
                    self.runs.append((stack[-1], text))
                    self.size[stack[-1]] += len(text)

        def say(text: str):
            if silent or not text:
                return
            buffer.append(text)
            if links:
                self.linked[stack[-1]] += len(text)

        while at < n:
            found = _TAG.search(source, at)
            if found is None:
                say(source[at:])
                break
            say(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing, attrs = name.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
            if not closing and name in RAW:
                end = _RAW_END[name].search(source, at)
                at = end.end() if end else n
                continue
            if name in SILENT or name in CONTROLS and name not in VOID:
                names = [x for x, _ in silent]
                if not closing and not attrs.endswith("/"):
                    silent.append((name, len(stack)))
                elif closing and name in names:
                    del silent[len(names) - 1 - names[::-1].index(name) :]
                continue
            if name == "body" and any(x == "head" for x, _ in silent):
                silent.clear()
            if name in INLINE:
                if name == "a":
                    links = 0 if closing else 1
                elif name == "br":
                    say(" ")
                continue
            flush()
            links = 0
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == name:
                        del stack[i:]
                        break
                # What never closed ends with the block around it.
                while silent and silent[-1][1] > len(stack):
                    silent.pop()
                continue
            if self.tag[stack[-1]] == "p":
                stack.pop()
            while silent and (silent[-1][1] > len(stack) or silent[-1][0] in ("select", "option")):
                silent.pop()
            if name in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in CLOSES[name]:
                        del stack[i:]
                    elif self.tag[stack[i]] in SCOPES:
                        break
            words = " ".join(m[2].strip("\"'") for m in _ATTR.finditer(attrs)) if attrs else ""
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.feature.append((name, words))
            self.size.append(0)
            self.linked.append(0)
            if name not in VOID:
                stack.append(len(self.parent) - 1)
        flush()


def traits(name: str, words: str, size: int, linked: int) -> list[str]:
    """The evidence an element gives by itself."""
    share = linked / size if size else 0
    out = [f"tag {name}", f"size {0 if not size else 1 if size < 25 else 2 if size < 80 else 3 if size < 300 else 4}"]
    if size:
        out.append(f"links {0 if not linked else 1 if share < 0.4 else 2 if share < 0.8 else 3}")
    return out + [f"word {w.lower()}" for w in dict.fromkeys(_WORD.findall(words))]


class TreeModel:
    def __init__(self, node: dict[str, np.ndarray], edge: np.ndarray, root: np.ndarray):
        self.node, self.edge, self.root, self._seen = node, edge, root, {}

    def __getstate__(self):
        return {"node": self.node, "edge": self.edge, "root": self.root}

    def __setstate__(self, state):
        self.__init__(**state)

    def potential(self, name: str, words: str, size: int, linked: int) -> np.ndarray:
        key = (name, words, 0 if not size else 1 if size < 25 else 2 if size < 80 else 3 if size < 300 else 4, -1 if not size else 0 if not linked else 1 if linked < 0.4 * size else 2 if linked < 0.8 * size else 3)
        if (got := self._seen.get(key)) is None:
            got = sum((self.node.get(t, _FLAT) for t in traits(name, words, size, linked)), np.zeros(3))
            if len(self._seen) < 20_000:
                self._seen[key] = got
        return got

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """Log marginals (up to a constant a row) of all elements of the pages, one after the other."""
        n = np.array([len(p.parent) for p in pages])
        begin = np.cumsum(n) - n
        parent = np.concatenate([np.array(p.parent) for p in pages])
        parent = np.where(parent >= 0, parent + np.repeat(begin, n), -1)
        own = np.array([self.potential(*f, s, k) for p in pages for f, s, k in zip(p.feature, p.size, p.linked, strict=True)])
        own[begin] += self.root
        depth = np.zeros(len(parent), np.int64)
        for i, up in enumerate(parent):  # parents come first
            if up >= 0:
                depth[i] = depth[up] + 1
        by_depth = np.argsort(depth, kind="stable")
        levels = np.split(by_depth, np.searchsorted(depth[by_depth], np.arange(1, depth.max() + 1)))
        belief, up_message = own.copy(), np.zeros_like(own)
        for level in levels[:0:-1]:
            up_message[level] = _logsum(belief[level][:, None, :] + self.edge[None], 2)
            np.add.at(belief, parent[level], up_message[level])
        for level in levels[1:]:
            above = belief[parent[level]] - up_message[level]
            belief[level] += _logsum(above[:, :, None] + self.edge[None], 1)
            belief[level] -= belief[level].max(1, keepdims=True)
        return belief

    def extract(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        if not pages:
            return []
        best = self.marginals(pages).argmax(1)
        out, at = [], 0
        for p in pages:
            out.append("\n".join(t for node, t in p.runs if best[at + node] == CONTENT))
            at += len(p.parent)
        return out


_FLAT = np.zeros(3)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit(pages: list[tuple[str, list[int]]], smooth: float = 0.5) -> TreeModel:
    """pages: source and the state of each element in opening order, the root first."""
    seen: dict[str, np.ndarray] = {}
    edge, root, states = np.full((3, 3), smooth), np.full(3, smooth), np.zeros(3)
    for source, labels in pages:
        page = Page(source)
        assert len(page.parent) == len(labels), (source, page.tag, labels)
        for i, state in enumerate(labels):
            states[state] += 1
            for t in traits(*page.feature[i], page.size[i], page.linked[i]):
                seen.setdefault(t, np.zeros(3))[state] += 1
            if i:
                edge[labels[page.parent[i]], state] += 1
            else:
                root[state] += 1
    node = {t: np.log(c + smooth) - np.log(states + 2 * smooth) for t, c in seen.items()}
    return TreeModel(node, np.log(edge / edge.sum(1, keepdims=True)), np.log(root / root.sum()))


#: Names that page authors give to furniture and to articles.
FURNITURE = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav toc pagination pager tabs skip",
    "header": "header masthead banner logo topbar site-header branding",
    "footer": "footer site-footer copyright bottom legal colophon",
    "aside": "sidebar aside widget related recommended popular trending rail newsletter promo tags",
    "ad": "ad ads advert advertisement adsense sponsor sponsored banner-ad promoted",
    "notice": "cookie cookies consent gdpr notice alert banner modal popup overlay paywall subscribe privacy disclaimer",
    "form": "form search login signup subscribe newsletter contact feedback",
    "comments": "comments comment reply replies discussion disqus respond responses commentlist",
    "share": "share social sharing follow buttons toolbar author-bio byline meta",
}
ARTICLE = "article content main post entry story body text post-content entry-content article-body story-body main-content page-content"


def training_pages(n: int = 500, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Labelled pages: an article inside layout wrappers, amid furniture with its usual names."""
    rnd = random.Random(seed)
    pages = []

    def words(a: int, b: int) -> str:
        return " ".join("word" * rnd.randint(1, 2) for _ in range(rnd.randint(a, b)))

    def furniture(labels: list[int], names: list[str]) -> str:
        kind = rnd.choice(names)
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and rnd.random() < 0.6 else rnd.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        name = rnd.choice(FURNITURE[kind].split())
        attr = "" if tag in FURNITURE and rnd.random() < 0.5 else f' {rnd.choice(["class", "id", "class"])}="{name}"'
        labels.append(BOILER)
        inside = []
        style = rnd.choice(["links", "text", "both"]) if kind in ("nav", "aside", "share", "footer", "header") else "text"
        if tag == "ul" or style != "text":
            if tag != "ul":
                labels.append(BOILER)
            items = rnd.randint(2, 6)
            labels += [BOILER] * items
            row = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(items))
            inside.append(row if tag == "ul" else f"<ul>{row}</ul>")
        if tag != "ul" and style != "links":
            for _ in range(rnd.randint(1, 4 if kind == "comments" else 2)):
                if rnd.random() < 0.5:
                    inside.append(words(2, 15))
                else:
                    t = rnd.choice(["p", "p", "div", "h3"])
                    labels.append(BOILER)
                    inside.append(f"<{t}>{words(2, 40 if kind == 'comments' else 15)}</{t}>")
        if kind == "form":
            inside.append('<input type="text">')
        return f"<{tag}{attr}>{''.join(inside)}</{tag}>"

    def article(labels: list[int]) -> str:
        tag = rnd.choice(["article", "article", "article", "main", "div", "section"])
        attr = f' class="{rnd.choice(ARTICLE.split())}"' if tag in ("div", "section") or rnd.random() < 0.3 else ""
        labels.append(CONTENT)
        inside = []
        if rnd.random() < 0.8:
            labels.append(CONTENT)
            inside.append(f"<h1>{words(2, 12)}</h1>")
        for _ in range(rnd.randint(1, 9)):
            roll = rnd.random()
            if roll < 0.66:
                labels.append(CONTENT)
                inside.append(f"<p>{words(1, 8) if rnd.random() < 0.15 else words(8, 90)}" + (f' <a href="/y">{words(1, 4)}</a>' if rnd.random() < 0.15 else "") + ("</p>" if rnd.random() < 0.85 else ""))
            elif roll < 0.76:
                labels.append(CONTENT)
                inside.append(f"<h2>{words(2, 8)}</h2>")
            elif roll < 0.83:
                t, items = rnd.choice(["ul", "ol"]), rnd.randint(2, 5)
                labels += [CONTENT] * (items + 1)
                inside.append(f"<{t}>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(items)) + f"</{t}>")
            elif roll < 0.88:
                t = rnd.choice(["blockquote", "pre", "figcaption", "figure"])
                labels.append(CONTENT)
                inside.append(f"<{t}>{words(4, 40)}</{t}>")
            elif roll < 0.91:
                labels += [CONTENT] * 4
                inside.append(f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>")
            elif roll < 0.94:
                labels += [CONTENT, CONTENT]
                inside.append(f"<section><p>{words(5, 60)}</p></section>")
            else:
                inside.append(furniture(labels, ["ad", "aside", "share", "notice", "comments"]))
        return f"<{tag}{attr}>{''.join(inside)}</{tag}>"

    for _ in range(n):
        labels, out = [MIXED, MIXED, MIXED], []
        wrap = rnd.random() < 0.4
        if wrap:
            labels.append(MIXED)
            out.append(f'<div class="{rnd.choice(["wrapper", "container", "page", "layout", "row", "site"])}">')
        for _ in range(rnd.randint(0, 4)):
            out.append(furniture(labels, ["nav", "header", "ad", "notice", "form", "aside"]))
        inner = rnd.random() < 0.3
        if inner:
            labels.append(MIXED)
            out.append(f"<{rnd.choice(['main', 'div', 'section'])}>")
        out.append(article(labels))
        for _ in range(rnd.randint(0, 2) if inner else 0):
            out.append(furniture(labels, ["aside", "comments", "share", "ad"]))
        if inner:
            out.append("</main></div></section>" if wrap is False else "</main>" if "<main>" in out else "</div>" if "<div>" in out else "</section>")
        for _ in range(rnd.randint(0, 4)):
            out.append(furniture(labels, ["footer", "comments", "aside", "ad", "form", "notice"]))
        pages.append((f"<html><body>{''.join(out)}" + ("</body></html>" if rnd.random() < 0.8 else ""), labels))
    return pages


def extract(pages: DataFrame, source: str = "html", model: TreeModel | None = None) -> DataFrame:
    """pages with text (main text, blocks joined by a line feed) and n_chars (its code points)."""
    spark = pages.sparkSession
    arrow_batches(spark)
    model = model or fit(training_pages())
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in K.blocks(whole, "__source", 2 << 20):
                texts = shared.value.extract(batch.column(batch.schema.get_field_index("__source")).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.coalesce(F.col(source), F.lit("")).alias("__source")).mapInArrow(lean(run), schema)
