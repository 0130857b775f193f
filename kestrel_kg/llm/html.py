"""Main text of web pages by a tree-structured graphical model.

The page's elements and its text blocks are the nodes of the DOM tree, each content or not. Every node has a log-linear potential of
its own (element name, class, id and role words, length, share of links, punctuation) and every parent-child edge a table of
potentials by the child's sort. Sum-product messages go up from the leaves and down from the root once; they give each block's exact
marginal, and blocks of at least 1/2 are the text. The potentials are trained on labelled pages (``html_pages``, or given ones) by
gradient steps on the exact likelihood, whose expectations come from the same messages.

Text rules: scripts, styles, comments, templates and the head are no text; what noscript and xmp hold is. A tag without its end is
none, and neither is what follows it. Character references are decoded. A block ends where a
block element begins or ends; a line break is white space. White space inside a block becomes one space, and the blocks are joined in
page order by one space.

Cases: null and empty html give empty text. Unclosed, unopened and crossed tags are repaired as they come. Pages are handled one at a
time, and the passes over a tree are loops, so deep and long pages need only memory in proportion. Repeated rows give repeated
results, an empty table none; extra columns aren't read. Rows aren't shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_columns
from .html_pages import labelled_pages

TOKEN = re.compile(
    r"(<!--.*?(?:-->|(?P<open>\Z)))"
    r"|<(script|style|title|textarea|template|iframe|noembed|noframes|svg|xmp)(?=[\s/>])[^>]*+>(.*?)(?:</\3\s*>|(?P<cut>\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
#: The same without quoted values: once a quotation mark stays open, it would be looked for from every later tag to the end.
PLAIN = re.compile(TOKEN.pattern.replace(r"""((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>""", "([^>]*+)>", 1), re.S | re.I)
UNCLOSED = re.compile(r"<[a-zA-Z!?/]")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html ins "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag ends, if they are open inside the nearest of the scope elements.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "button", "ins"}


class Page:
    """Nodes in document order: parent, name, name words, text (blocks only), linked characters."""

    def __init__(self, html: str) -> None:
        self.parent: list[int] = [-1]
        self.name: list[str] = ["#root"]
        self.words: list[tuple[str, ...]] = [()]
        self.text: list[str | None] = [None]
        self.linked: list[int] = [0]
        self.open = [0]
        #: Places in ``open`` of each name's elements, so that no tag walks through the stack.
        self.places: dict[str, list[int]] = {}
        self.run: list[str] = []
        self.links = self.link_chars = 0
        # nothing after the last ">" can be a tag; a tag left open there goes to the end
        at, last, token = 0, html.rfind(">") + 1, TOKEN
        while at < last and (m := token.search(html, at, last)):
            if m.start() > at:
                self._say(html[at : m.start()])
            at = m.end()
            name = m.group(7) or m.group(10)
            if name:
                self._tag(name.lower(), bool(m.group(6) or m.group(9)), m.group(8) or m.group(11) or "")
                token = PLAIN if m.group(10) else token
            elif m.group("open") is not None or m.group("cut") is not None:
                at = len(html)
            if (m.group(3) or "").lower() == "xmp":  # text as it stands
                self._tag("pre", False, "")
                self._say(html[m.start(4) : m.end(4) if m.group("cut") is None else len(html)].replace("&", "&amp;"))
                self._tag("pre", True, "")
        m = UNCLOSED.search(html, max(at, last))
        end = m.start() if m else len(html)
        if at < end:
            self._say(html[at:end])
        self._flush()

    def _say(self, text: str) -> None:
        self.run.append(text)
        if self.links:
            self.link_chars += len(text)

    def _flush(self) -> None:
        if self.run:
            text = " ".join(unescape("".join(self.run)).split())
            if text:
                self._add("#text", (), text, self.link_chars)
            self.run, self.link_chars = [], 0

    def _add(self, name: str, words: tuple[str, ...], text: str | None, linked: int) -> int:
        self.parent.append(self.open[-1])
        self.name.append(name)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.name) - 1

    def _tag(self, name: str, closing: bool, attributes: str) -> None:
        if name == "a":
            # a link lasts over blocks inside it, and no longer than the block that it begins in
            self.links = 0 if closing else len(self.open)
        elif name == "br":
            self.run.append(" ")
        if name not in BLOCKS:
            return
        self._flush()
        if closing:
            if name not in ("html", "body") and self.places.get(name):
                self._cut(self.places[name][-1])
            self.links = self.links if len(self.open) >= self.links else 0
            return
        if name in CLOSES_P:
            self._end({"p"}, {"td", "th", "button", "table", "li", "div", "article", "section"})
        if name in ENDS:
            self._end(*ENDS[name])
        self.links = self.links if len(self.open) >= self.links else 0
        if name in ("html", "body", "head") and self.places.get(name):
            return
        if name == "body":
            self._end({"head"}, set())
        node = self._add(name, name_words(attributes), None, 0)
        if name not in EMPTY and not attributes.endswith("/"):
            self.places.setdefault(name, []).append(len(self.open))
            self.open.append(node)

    def _end(self, names: set[str], scope: set[str]) -> None:
        """End the innermost open element of one of the names, unless one of the scope elements is open inside it."""
        last = lambda some: max((self.places[n][-1] for n in some if self.places.get(n)), default=0)
        if (k := last(names)) > last(scope):
            self._cut(k)

    def _cut(self, k: int) -> None:
        """End the elements from place k on."""
        for node in self.open[k:]:
            self.places[self.name[node]].pop()
        del self.open[k:]


def name_words(attributes: str) -> tuple[str, ...]:
    if not attributes or attributes == "/":
        return ()
    out: list[str] = []
    for key, value in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("hidden", "aria-hidden", "style"):
            if key == "hidden" or "true" in value or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("~hidden")
        else:
            out += [w.lower() for w in NAME_WORD.findall(value)]
    return tuple(out)


def features(page: Page) -> list[list[str]]:
    """The names of each node's features."""
    out = []
    for i, text in enumerate(page.text):
        if text is None:
            out.append(["e", f"<{page.name[i]}", *(f".{w}" for w in page.words[i]), *(f".{w[:4]}*" for w in page.words[i] if len(w) > 3)])
            continue
        n = len(text)
        share = page.linked[i] / n
        parent = page.name[page.parent[i]]
        stops = sum(map(text.count, ".!?"))
        out.append(
            ["t", f"n{min(n.bit_length(), 10)}", f"l{0 if share < 0.2 else 1 if share < 0.8 else 2}", f"in{parent}", "stop" if text[-1] in ".!?:\"'" else "nostop", f"s{min(stops, 3)}", *(["copy"] if "©" in text or "copyright" in text.lower() else [])]
        )
    return out


class TreeModel:
    """Weights of the node features and potentials[sort of child][state of parent][state of child]."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.edges = [[[0.5, -0.5], [-0.5, 0.5]], [[0.5, -0.5], [-0.5, 0.5]]]

    def messages(self, page: Page, own: list[float]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of each node: those of its subtree, those that reach it from above, and the sum."""
        n = len(own)
        up, sent = list(own), [0.0] * n
        parent, sort = page.parent, [0 if t is None else 1 for t in page.text]
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = self.edges[sort[i]]
            sent[i] = log_add(c, d + up[i]) - log_add(a, b + up[i])
            up[parent[i]] += sent[i]
        down = [0.0] * n
        for i in range(1, n):
            (a, b), (c, d) = self.edges[sort[i]]
            cavity = up[parent[i]] + down[parent[i]] - sent[i]
            down[i] = log_add(b, d + cavity) - log_add(a, c + cavity)
        return up, down, sent

    def own(self, named: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in names]) for names in named]

    def content(self, html: str) -> str:
        page = Page(html)
        up, down, _ = self.messages(page, self.own(features(page)))
        return " ".join(t for i, t in enumerate(page.text) if t is not None and up[i] + down[i] >= 0)

    def step(self, page: Page, labels: list[bool], named: list[list[str]], rate: float, slack: float) -> None:
        """One gradient step on the page's log-likelihood."""
        up, down, sent = self.messages(page, self.own(named))
        for i, names in enumerate(named):
            miss = rate * (labels[i] - sigmoid(up[i] + down[i]))
            for f in names:
                w = self.weights.get(f, 0.0)
                self.weights[f] = w + miss - rate * slack * w
        change = [[[0.0, 0.0], [0.0, 0.0]] for _ in self.edges]
        for i in range(1, len(named)):
            sort = 0 if page.text[i] is None else 1
            above = up[page.parent[i]] + down[page.parent[i]] - sent[i]
            logs = [[self.edges[sort][s][t] + s * above + t * up[i] for t in (0, 1)] for s in (0, 1)]
            most = max(map(max, logs))
            total = sum(math.exp(x - most) for row in logs for x in row)
            for s in (0, 1):
                for t in (0, 1):
                    change[sort][s][t] -= math.exp(logs[s][t] - most) / total
            change[sort][labels[page.parent[i]]][labels[i]] += 1
        for sort, table in enumerate(change):
            for s in (0, 1):
                for t in (0, 1):
                    self.edges[sort][s][t] += 0.2 * rate * table[s][t]


def log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def labels_of(page: Page, content: set[str]) -> list[bool]:
    """Blocks are content if their text is or begins with one (line breaks don't end blocks); elements if most of their text is."""
    good, total = [0] * len(page.text), [0] * len(page.text)
    for i, t in enumerate(page.text):
        if t is not None:
            good[i], total[i] = len(t) * (t in content or any(len(c) > 25 and t.startswith(c) for c in content)), len(t)
    for i in range(len(page.text) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        total[page.parent[i]] += total[i]
    return [2 * g > t for g, t in zip(good, total, strict=True)]


def train(pages: list[list[tuple[str, str, bool]]], *, rounds: int = 8, rate: float = 0.15, slack: float = 0.002) -> TreeModel:
    model = TreeModel()
    rows = []
    for parts in pages:
        page = Page("".join(before + text for before, text, _ in parts))
        rows.append((page, labels_of(page, {" ".join(t.split()) for _, t, good in parts if good and t}), features(page)))
    for k in range(rounds):
        for page, labels, named in rows:
            model.step(page, labels, named, rate / (1 + k), slack)
    return model


@lru_cache(maxsize=2)
def default_model(pages: int = 800) -> TreeModel:
    """Trained on ``pages`` made pages; the same each time."""
    return train(labelled_pages(pages))


def extract(pages: DataFrame, *, model: TreeModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all: None) of each page with ``text`` and ``n_chars``."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            found = [model.content(x) if x else "" for x in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            yield {"text": pa.array(found, pa.string()), "n_chars": pa.array(list(map(len, found)), pa.int64())}

    return with_columns(pages, run, "text string, n_chars long", keep, ["html"])
