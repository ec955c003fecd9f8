"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^<>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD = frozenset("head title meta link base".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre nav header footer aside form figure figcaption address details summary fieldset hr".split())
#: An open element that a new one ends: the new element's tag to the tags it ends and those that shield them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_SHIELD = frozenset("html body td th table".split())
#: Words in class, id and role that speak for and against main text.
GOOD = ("article", "content", "main", "post", "entry", "body", "story", "text")
BAD = ("ad", "ads", "advert", "banner", "sponsor", "promo", "nav", "menu", "sidebar", "side", "footer", "header", "comment", "comments", "reply", "cookie", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "social", "related", "widget", "breadcrumb", "search", "login", "form", "rail")
_WORD = re.compile(r"[a-z]+")
TAGS = ("article", "main", "section", "div", "p", "h", "li", "ul", "table", "nav", "header", "footer", "aside", "form", "blockquote", "body")
_TAG = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": TAGS.index("h") for i in range(1, 7)} | {"ol": TAGS.index("ul"), "dl": TAGS.index("ul"), "html": TAGS.index("body")}
N_FEATURES = 22 + len(TAGS)


class Page:
    """The block elements of a page, in order, and the text that belongs to each.

    ``flow`` lists (node, text) in page order; None as text marks the edge of a block.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.good, self.bad = ["body"], [-1], [0], [0], [0]
        self.flow: list[tuple[int, str | None]] = []
        self.chars, self.linked, self.tags, self.stops, self.kids = [0], [0], [0], [0], [0]
        stack: list[tuple[str, int]] = [("", 0)]  # tag, nearest block
        self.open_tags: Counter[str] = Counter()  # what isn't open need not be looked for in the stack
        link = hidden = 0
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at and not hidden:
                self.say(stack[-1][1], source[at : m.start()], link)
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if m[2]:
                for i in range(len(stack) - 1, 0, -1) if self.open_tags[tag] else ():
                    if stack[i][0] == tag:
                        link, hidden = self.close(stack, i, link, hidden)
                        break
                continue
            if tag in BLOCK and tag not in ("html", "body") and self.open_tags["p"]:
                p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in _SHIELD), 0)
                if p and stack[p][0] == "p":
                    link, hidden = self.close(stack, p, link, hidden)
            if tag in _ENDS:
                ends, shield = _ENDS[tag]
                for i in range(len(stack) - 1, 0, -1) if any(self.open_tags[x] for x in ends) else ():
                    if stack[i][0] in shield:
                        break
                    if stack[i][0] in ends:
                        link, hidden = self.close(stack, i, link, hidden)
                        break
            if tag == "br":
                self.flow.append((stack[-1][1], " "))
            if tag in VOID:
                if tag == "hr":
                    self.flow.append((stack[-1][1], None))
                continue
            node = stack[-1][1]
            self.tags[node] += 1
            if tag in HEAD:
                hidden += 1
            elif tag == "body":
                hidden = 0  # a head left open ends here
            elif tag in BLOCK and tag != "html" and not hidden:
                node = self.open(tag, node, m[4])
            link += tag == "a"
            if not m[4].rstrip().endswith("/") or tag in BLOCK:
                stack.append((tag, node))
                self.open_tags[tag] += 1
        if at < len(source) and not hidden:
            self.say(stack[-1][1], source[at:], link)

    def open(self, tag: str, parent: int, attributes: str) -> int:
        names = set()
        if attributes:
            for k, v in ATTRIBUTE.findall(attributes):
                if k.lower() in ("class", "id", "role"):
                    names.update(_WORD.findall(v.lower()))
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.good.append(sum(w in names for w in GOOD))
        self.bad.append(sum(w in names for w in BAD))
        for x in (self.chars, self.linked, self.tags, self.stops, self.kids):
            x.append(0)
        self.kids[parent] += 1
        node = len(self.tag) - 1
        self.flow.append((node, None))
        return node

    def close(self, stack, i, link, hidden):
        for tag, node in stack[i:]:
            self.open_tags[tag] -= 1
            link -= tag == "a"
            hidden -= tag in HEAD
            if tag in BLOCK:
                self.flow.append((node, None))
        del stack[i:]
        return max(0, link), max(0, hidden)

    def say(self, node: int, text: str, link: int) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.flow.append((node, text))
        size = len(text.strip())
        self.chars[node] += size
        self.linked[node] += size * bool(link)
        self.stops[node] += text.count(".") + text.count(",")

    def features(self) -> np.ndarray:
        """One row a node: its own and its subtree's text and density, attributes, depth, siblings, parent."""
        n = len(self.tag)
        parent, depth = np.array(self.parent), np.array(self.depth, float)
        own = np.array([self.chars, self.linked, self.tags, self.stops, [1] * n], float)
        total = own.copy()
        for i in range(n - 1, 0, -1):
            total[:, parent[i]] += total[:, i]
        chars, linked, tags, stops, nodes = total
        good, bad, kids = (np.array(x, float) for x in (self.good, self.bad, self.kids))
        above_good, above_bad = good.copy(), bad.copy()
        tag = np.array([_TAG.get(t, -1) for t in self.tag])
        poor = np.isin(tag, [TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form")]).astype(float)
        rich = np.isin(tag, [TAGS.index(t) for t in ("article", "main")]).astype(float)
        above_poor, above_rich = poor.copy(), rich.copy()
        place = np.zeros(n)
        seen = np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            for x in (above_good, above_bad, above_poor, above_rich):
                x[i] += x[p]
            place[i] = seen[p]
            seen[p] += 1
        brothers = kids[parent] * (parent >= 0)
        up = np.maximum(parent, 0)
        inner_poor, inner_rich = poor.copy(), rich.copy()
        for i in range(n - 1, 0, -1):
            inner_poor[parent[i]] += inner_poor[i]
            inner_rich[parent[i]] += inner_rich[i]
        columns = [
            np.log1p(chars), np.log1p(own[0]), chars / (tags + nodes), linked / np.maximum(chars, 1), stops / np.maximum(chars, 1) * 100, np.log1p(nodes),
            depth, kids, good, bad, above_good - good, above_bad - bad, place, place / np.maximum(brothers, 1), brothers, chars / np.maximum(chars[up], 1),
            np.log1p(chars[up] - chars), linked[up] / np.maximum(chars[up], 1), above_poor - poor, above_rich - rich, inner_poor - poor, inner_rich - rich,
        ]
        return np.column_stack([*columns, *(tag == k for k in range(len(TAGS)))])

    def decode(self, keep: np.ndarray) -> np.ndarray:
        """The most probable choice of nodes in which what is kept has kept ancestors only."""
        p = np.clip(keep, 1e-6, 1 - 1e-6)
        yes, no = np.log(p), np.log(1 - p)
        parent = self.parent
        for i in range(len(p) - 1, 0, -1):
            yes[parent[i]] += max(yes[i], no[i])
            no[parent[i]] += no[i]
        out = yes > no
        for i in range(1, len(p)):
            out[i] &= out[parent[i]]
        return out

    def text(self, kept: np.ndarray) -> str:
        """Kept text: a line for each block, white space collapsed."""
        lines, now = [], []
        for node, piece in self.flow:
            if piece is None:
                lines.append(now)
                now = []
            elif kept[node]:
                now.append(piece)
        lines.append(now)
        whole = (" ".join("".join(x).split()) for x in lines if x)
        return "\n".join(x for x in whole if x)


class Trees:
    """A boosted ensemble as arrays: feature, threshold, children, value of each node."""

    def __init__(self, described: list[str], weights: list[float]):
        self.trees = [(self.read(d), w) for d, w in zip(described, weights, strict=True)]

    @staticmethod
    def read(described: str):
        """From the indented text that a tree model gives of itself."""
        lines = [x for x in described.splitlines()[1:] if x.strip()]
        feature, threshold, right, value = [], [], [], []

        def node(i: int) -> int:
            me = len(feature)
            for x in (feature, threshold, right, value):
                x.append(0)
            if m := re.match(r"\s*If \(feature (\d+) <= ([-0-9.Ee]+)\)", lines[i]):
                feature[me], threshold[me] = int(m[1]), float(m[2])
                i = node(i + 1)
                right[me] = len(feature)
                return node(i + 1)
            feature[me], value[me] = -1, float(lines[i].split("Predict:")[1])
            return i + 1

        node(0)
        return np.array(feature), np.array(threshold, float), np.array(right), np.array(value, float)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, right, value), weight in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                left = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(left, at + 1, right[at]), at)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def example(seed: int) -> tuple[str, list[str]]:
    """A made-up page and the lines of its main text; layouts, names and lengths vary with the seed."""
    r = random.Random(seed)
    stem = ["la", "mer", "ton", "vi", "so", "ka", "ren", "du", "il", "es", "po", "gra", "nu", "ti", "che"]

    def word():
        return "".join(r.choice(stem) for _ in range(r.randint(1, 4)))

    def say(a, b):
        return " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(a, b))).capitalize() + "."

    def links(n):
        return [f'<a href="/{word()}">{say(1, 2)}</a>' for _ in range(n)]

    def boxed(tags, names, inside):
        name = r.choice(names)
        tag = r.choice(tags)
        return f'<{tag}{r.choice([f" class={chr(34)}{name}{chr(34)}", f" id={chr(34)}{name}{chr(34)}", ""]) if tag not in ("div", "section") else f" class={chr(34)}{name}{chr(34)}"}>{inside}</{tag}>'

    lines: list[str] = []

    def block(tag):
        text = say(2, 8) if tag[0] == "h" else say(3, 25) if r.random() < 0.4 else say(20, 120)
        lines.append(text)
        middle = text.find(" ", len(text) // 2)
        if middle > 0 and r.random() < 0.3:
            inner = r.choice(["b", "em", "a", "span"])
            text = f"{text[:middle]} <{inner}{' href=/x' if inner == 'a' else ''}>{text[middle + 1 :]}" + ("<br>" if r.random() < 0.3 and inner == "b" else f"</{inner}>")
        return f"<{tag}>{text}" + ("" if r.random() < 0.1 and tag == "p" else f"</{tag}>")

    def inner():
        out = []
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.12:
                out.append(block(r.choice(["h2", "h3"])))
            elif k < 0.2:
                out.append("<ul>" + "".join(block("li") for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.26:
                out.append("<blockquote>" + block("p") + "</blockquote>")
            else:
                out.append(block("p"))
            if r.random() < 0.06:
                out.append(boxed(["div", "aside"], ["ad", "advert", "promo", "newsletter", "related share"], say(4, 20)))
        return "".join(out)

    nav = boxed(["nav", "nav", "div", "ul"], ["nav", "menu", "site-menu", "breadcrumb"], "<ul>" + "".join(f"<li>{x}</li>" for x in links(r.randint(3, 10))) + "</ul>")
    head = boxed(["header", "div"], ["header", "site-header", "banner"], say(1, 6) + (nav if r.random() < 0.4 else ""))
    side = boxed(["aside", "div"], ["sidebar", "side-rail", "widget", "related"], f"<h3>{say(1, 3)}</h3>" + "".join(f"<p>{x}</p>" for x in links(r.randint(2, 6))) + f"<p>{say(5, 30)}</p>")
    ad = boxed(["div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsor", "promo"], say(4, 30))
    note = boxed(["div", "section"], ["cookie", "consent", "notice", "popup"], f"<p>{say(8, 40)}</p><button>{say(1, 2)}</button>")
    form = f"<form class='{word()}'><label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button></form>"
    said = boxed(["div", "section"], ["comments", "comment-list", "replies comment"], "".join(f'<div class="comment"><p>{say(8, 60)}</p></div>' for _ in range(r.randint(1, 5))))
    foot = boxed(["footer", "footer", "div"], ["footer", "site-footer"], f"&copy; {word()} &middot; {say(3, 30)}" + "".join(links(r.randint(0, 4))))
    title = block("h1") if r.random() < 0.85 else ""
    body = title + inner()
    shell = r.random()
    main = f"<article>{body}</article>" if shell < 0.5 else f"<main>{body}</main>" if shell < 0.65 else f'<div class="{r.choice(["content", "post-body", "entry content", "article-text"])}">{body}</div>' if shell < 0.9 else f"<div>{body}</div>"
    pick = lambda x, p: x if r.random() < p else ""
    page = f"<html><head><title>{say(2, 6)}</title><script>var a = '<p>x</p>';</script></head><body>" + pick(head, 0.5) + pick(nav, 0.8) + pick(ad, 0.5) + pick(note, 0.3) + pick(form, 0.2)
    page += (f'<div class="{r.choice(["wrap", "page", "row"])}">' + main + pick(side, 0.6) + "</div>" if r.random() < 0.4 else main + pick(side, 0.4))
    return page + pick(said, 0.3) + pick(ad, 0.3) + pick(form, 0.1) + pick(foot, 0.9) + "</body></html>", lines


def labelled(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of an example's nodes, and which hold main text or lead to it."""
    source, lines = example(seed)
    page = Page(source)
    wanted = {" ".join(x.split()) for x in lines}
    keep = np.zeros(len(page.tag), bool)
    now: dict[int, list[str]] = {}

    def end():
        whole = " ".join("".join(t for x in now.values() for t in x).split())
        if whole in wanted:
            for i in now:
                keep[i] = True
        now.clear()

    for node, piece in page.flow:
        if piece is None:
            end()
        elif piece.strip():
            now.setdefault(node, []).append(piece)
    end()
    for i in range(len(keep) - 1, 0, -1):
        keep[page.parent[i]] |= keep[i]
    return page.features(), keep


#: Pages made up for training, and the ensemble's size.
EXAMPLES, ROUNDS, DEPTH = 500, 14, 5


def train(spark: SparkSession, examples: int = EXAMPLES) -> Trees:
    """Gradient-boosted trees, fitted by Spark on the nodes of made-up pages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                x, keep = labelled(seed)
                yield pa.RecordBatch.from_arrays([pa.array(keep.astype(float)), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    rows = spark.range(0, examples, 1, 6).mapInArrow(task, "label double, x array<double>").select("label", array_to_vector("x").alias("features")).persist()
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=7, maxMemoryInMB=64).fit(rows)
    rows.unpersist()
    return Trees([t.toDebugString for t in model.trees], list(model.treeWeights))


def main_text(source: str | None, trees: Trees) -> str:
    return texts([source], trees)[0]


def texts(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the trees see the nodes of all pages at once."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    keep = trees.probability(np.concatenate([p.features() for p in pages]))
    edges = np.cumsum([0, *(len(p.tag) for p in pages)])
    return [p.text(p.decode(keep[a:b])) for p, a, b in zip(pages, edges[:-1], edges[1:], strict=True)]


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): the main text and its code points.

    Null, empty and tagless html: text outside any element counts as the body's, and is kept
    if the trees keep the body.  Unclosed elements end where HTML lets the next begin;
    an unclosed comment or script hides the rest.  Empty text where nothing is kept.  No
    shuffle; repeated rows each get a row.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = texts(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(task, SCHEMA)
