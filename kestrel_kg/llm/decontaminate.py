"""Benchmark decontamination with a generalised suffix automaton.

The normalised items (words of letters, digits and non-ASCII, A-Z in lower case) go into one automaton over word numbers. Documents
stream through it: the state and the longest matching length are followed word by word, and where the length reaches the window
the state's suffix-link ancestor names the items that hold those words. Stretches in which some adjacent pair of words lies in no
item cannot hold a window of two words or more, so the automaton is only stepped through the others; this changes no result.

A window is ``window`` consecutive words of an item; an item of fewer words is one window. Words inside any occurrence are hit. A
document is contaminated if ``n_hit > 0`` and ``coverage * n_hit >= n_words``.

Bounds: the automaton is broadcast, with at most ``shard_words`` item words in it (a longer item makes a shard of its own); more
items are scanned in further passes over a written table, and the results of all passes are united. Documents aren't shuffled.

Cases: null and empty texts have no words and aren't contaminated. Items of null id or without words are left out; repeated items
and rows count once as an item id, each as a row. Empty tables give no rows or no hits. Extra columns of documents pass through and
give way to results of the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, with_columns, written

WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
WORD = re.compile(rb"[^ ]+")
PAIR_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]) for item, text in items]
        rows = [(item, r) for item, r in rows if r]
        pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, row in rows:
            state = 0
            for symbol in row:
                state = self._extend(state, symbol)
            a = np.array(row, np.int64)
            pairs[pair_slots(a)] = True
        self.pairs = pairs
        self.least = min([window, *(len(r) for _, r in rows)])
        self._mark(rows)

    def _extend(self, last: int, symbol: int) -> int:
        following = self.next[last].get(symbol)
        if following is not None:
            return following if self.length[following] == self.length[last] + 1 else self._clone(last, following, symbol)
        new = self._state({}, self.length[last] + 1, 0)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._clone(state, target, symbol)
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, state: int, target: int, symbol: int) -> int:
        copy = self._state(dict(self.next[target]), self.length[state] + 1, self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _mark(self, rows: list[tuple[int, list[int]]]) -> None:
        """``at``: a state's ancestor that stands for the last ``window`` words; ``items``: those holding a state's words; ``short``: items of fewer words ending there."""
        own: dict[int, list[tuple[int, int]]] = {}
        held: list[set[int]] = [set() for _ in self.next]
        for item, row in rows:
            state = 0
            for symbol in row:
                state = self.next[state][symbol]
                up = state
                while up > 0 and self.length[up] >= self.window and item not in held[up]:
                    held[up].add(item)
                    up = self.link[up]
            if len(row) < self.window:
                own.setdefault(state, []).append((len(row), item))
        self.at, self.short = [-1] * len(self.next), [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= self.window:
                self.at[v] = v if self.length[up] < self.window else self.at[up]
            self.short[v] = (*own.get(v, ()), *self.short[up])
        self.items = [frozenset(x) if self.at[v] == v else frozenset() for v, x in enumerate(held)]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [first, end) word spans of the windows found, and the items they are of."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for first, end, found in self._windows(words):
            items |= found
            if spans and first <= spans[-1][1]:
                while spans and first <= spans[-1][0]:
                    end = max(end, spans.pop()[1])
                if spans and first <= spans[-1][1]:
                    first, end = spans[-1][0], max(end, spans.pop()[1])
            spans.append((first, end))
        return spans, items

    def _windows(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[int] | set[int]]]:
        n = len(words)
        if n < self.least or not self.vocabulary:
            return
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        for start, end in self._stretches(ids):
            state = length = 0
            for i, symbol in enumerate(ids[start:end].tolist(), start):
                while state and symbol not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                following = self.next[state].get(symbol)
                if following is not None:
                    state, length = following, length + 1
                if length >= self.window:
                    yield i + 1 - self.window, i + 1, self.items[self.at[state]]
                if self.short[state]:
                    for k, item in self.short[state]:
                        if k <= length:
                            yield i + 1 - k, i + 1, {item}

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the words that a window could lie in."""
        if self.least == 1:
            good, extra = ids >= 0, 0
        else:
            good, extra = (ids[:-1] >= 0) & (ids[1:] >= 0), 1
            good[good] = self.pairs[pair_slots(ids)[good]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + extra
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def pair_slots(ids: np.ndarray) -> np.ndarray:
    a = ids.astype(np.uint64)
    return ((a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in groups of at most ``shard_words`` words, read one partition at a time."""
    shard: list[tuple[int, bytes]] = []
    size = 0
    for item, text in benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary")).distinct().toLocalIterator():
        n = len(words_of(bytes(text)))
        if shard and size + n > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((item, bytes(text)))
        size += n
    if shard:
        yield shard


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, coverage: int = 20, shard_words: int = 200_000, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all: None) of each document with n_words, n_hit, item_ids, spans of hit words [first, end) and ``contaminated``."""
    columns = docs.columns if keep is None else keep
    columns = [c for c in columns if c.lower() not in {"n_words", "n_hit", "item_ids", "spans", "contaminated"}]
    added = "n_words long, n_hit long, item_ids array<long>, spans array<struct<first:long,end:long>>, contaminated boolean"
    need = ["text"]
    through = [*columns, *(["text"] if "text" not in columns else [])]
    out = None
    for shard in shards(benchmark, shard_words):
        if out is not None:
            out = written(out, "decontaminate")
        out = _pass(docs if out is None else out, shard, window, coverage, added, through, need, out is None)
        need = ["text", "item_ids", "spans"]
    out = _pass(docs, [], window, coverage, added, through, need, True) if out is None else out
    return out.select(*columns, "n_words", "n_hit", "item_ids", "spans", "contaminated")


def _pass(docs: DataFrame, shard: list[tuple[int, bytes]], window: int, coverage: int, added: str, columns: list[str], need: list[str], first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        automaton = Automaton(shared.value, window)
        for batch in batches:
            before = [([], [])] * batch.num_rows if first else list(zip(batch.column(batch.schema.get_field_index("spans")).to_pylist(), batch.column(batch.schema.get_field_index("item_ids")).to_pylist(), strict=True))
            rows = []
            for text, (old_spans, old_items) in zip(texts(batch), before, strict=True):
                words = words_of(text)
                spans, items = automaton.scan(words)
                if old_spans:
                    spans = union([(x["first"], x["end"]) for x in old_spans] + spans)
                hit = sum(b - a for a, b in spans)
                rows.append((len(words), hit, sorted(items.union(old_items)), [{"first": a, "end": b} for a, b in spans], hit > 0 and coverage * hit >= len(words)))
            n_words, n_hit, items, spans, bad = zip(*rows, strict=True) if rows else [[]] * 5
            yield {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "item_ids": pa.array(items, pa.list_(pa.int64())), "spans": pa.array(spans, kind), "contaminated": pa.array(bad, pa.bool_())}

    return with_columns(docs, run, added, columns, need)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(scanned: DataFrame, *, max_span: int = 13, coverage: int = 20, action: str = "spans") -> DataFrame:
    """Act on a ``scan`` that kept ``text``.

    ``action="spans"`` cuts hit spans of ``max_span`` words or more, and every hit span of a contaminated document, out of the
    text with the white space and marks between their words. ``action="documents"`` drops contaminated documents and leaves all
    others as they are.
    """
    if action == "documents":
        return scanned.where(~F.col("contaminated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            at = batch.schema.get_field_index
            original = batch.column(at("text"))
            out = []
            for i, (spans, bad) in enumerate(zip(batch.column(at("spans")).to_pylist(), batch.column(at("contaminated")).to_pylist(), strict=True)):
                cut = [(s["first"], s["end"]) for s in spans or [] if bad or s["end"] - s["first"] >= max_span]
                out.append(cut_words(original[i].as_py(), cut) if cut else original[i].as_py())
            yield {"text": pa.array(out, pa.string())}

    return with_columns(scanned, run, "text string", None, ["text", "spans", "contaminated"])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.translate(WORD_BYTES))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
