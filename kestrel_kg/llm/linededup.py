"""Repeated line runs by distributed prefix doubling over line ids.

Lines are split at ``\\n``; lines without a word take no part and stay. A run is a stretch of following lines of one document. The
documents stand in the order of their ids, and a run of ``min_words`` words or more that also begins at an earlier place is a later
copy: its lines are deleted, and each line goes that lies in some such run.

Suffixes are ranked by doubling. A line's rank is the place of its id (128 bits of hashes) among the sorted ids that occur twice or more;
at level k a suffix's rank is the place of the pair of its halves' ranks among the sorted pairs, so equal ranks mean equal first
``2 ** k`` lines, and the ranks' order is that of the suffix array to that depth. Ranks are counted, not hashed: no two runs share
one by accident. Suffixes whose rank is theirs alone have no common prefix of that length with any other and drop out.

Suffixes that share their first m lines are an interval of the suffix array in which the longest common prefixes are m or more. With
``2 ** k <= m < 2 ** (k + 1)`` it is the set of suffixes of one rank at level k whose rank ``m - 2 ** k`` lines further on is one
too, so the two overlapping ranks name the interval, and its first place is a minimum. Which lines go depends on no deeper order than
``min_words`` words: a maximal repeated run is the union of its shortest stretches of ``min_words`` words from each line on and up to
each line. So only these depths are looked at and ``log2(min_words)`` levels are enough, however long the copies are.

Nothing gathers an interval: first places are minima that Spark combines before its shuffles, and where they return to the suffixes those
of a frequent line or run are dealt to several tasks (``dealt_join``). A document's repeated lines form one row.

Cases: null texts stay null. Texts of which all lines go become empty (or the blank lines they have). Rows of null doc_id stand
first. Rows of equal id and text are one document, with the same result. An empty table gives no rows. Extra columns pass through and
give way to results of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model import ordered_index
from .common import dealt_join, lean, texts, written

PLACE = ("d", "h", "i")
WINDOWS = pa.list_(pa.int32())


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the order key d, h of each row."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "h": F.xxhash64(F.lit(1), "text")})


def stretches(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line, the lengths in lines of the shortest stretches of ``least`` words that start at it: that from it on, and those up to some line."""
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words)])
    out: list[set[int]] = [set() for _ in range(n)]
    ends = np.searchsorted(upto, upto[:-1] + least, "left")
    starts = np.searchsorted(upto, upto[1:] - least, "right") - 1
    for i in range(n):
        if ends[i] <= n:
            out[i].add(int(ends[i]) - i)
        if starts[i] >= 0:
            out[starts[i]].add(i + 1 - int(starts[i]))
    return [sorted(x) for x in out]


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """d, h, i (number among the lines with a word), lengths of the stretches from there, two hashes of the line."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for d, h, text in zip(ds, hs, texts(batch), strict=True):
                found = [x for x in text.split(b"\n") if x and not x.isspace()]
                if found:
                    lengths = stretches(np.array([len(x.split()) for x in found]), min_words)
                    for i, (line, length) in enumerate(zip(found, lengths, strict=True)):
                        rows.append((d, h, i, length, xxhash.xxh3_64_intdigest(line) - (1 << 63), xxhash.xxh64_intdigest(line) - (1 << 63)))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), WINDOWS, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["d", "h", "i", "lengths", "p", "q"])

    return keyed(docs).where("text is not null").select("d", "h", "text").mapInArrow(run, "d long, h long, i int, lengths array<int>, p long, q long")


def ranked(rows: DataFrame, keys: list[str], name: str, doubled: int | None = None) -> DataFrame:
    """``rows`` whose ``keys`` occur at two places or more, with their interval's ``first`` place and ``rank`` (of depth ``doubled``, if given)."""
    place = F.struct(*PLACE)
    groups = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").drop("last")
    groups = written(groups, f"groups-{name}")
    least = groups if doubled is None else groups.where(F.col("m") == doubled)
    order = written(ordered_index(least.select(*keys), "rank", *keys), f"ranks-{name}")
    told = groups.join(order, keys, "left")
    return dealt_join(rows, told.drop("n"), keys, groups.select(*keys, "n"))


def pairs(rows: DataFrame, level: int) -> DataFrame:
    """d, h, i, m, x, y: the ranks x, y of level ``level`` that make up m lines, of each document's stretches and of the next level."""
    half = 1 << level

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                d, h = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                places = batch.column(2)[r].as_py()
                name = {x["i"]: x["name"] for x in places}
                for x in places:
                    i = x["i"]
                    for m, lengths in [(m, None) for m in x["lengths"] if half <= m < 2 * half] + [(2 * half, x["lengths"])]:
                        y = name.get(i + m - half)
                        if y is not None:
                            out.append((d, h, i, m, x["name"], y, lengths))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), WINDOWS]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=["d", "h", "i", "m", "x", "y", "lengths"])

    whole = rows.groupBy("d", "h").agg(F.collect_list(F.struct("i", "name", "lengths")).alias("places"))
    return whole.mapInArrow(run, "d long, h long, i int, m int, x long, y long, lengths array<int>")


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """d, h, spans: the [i, i + m) stretches of each document that also begin at an earlier place."""
    rows = ranked(lines_of(docs, min_words), ["p", "q"], "lines")
    rows = written(rows.select(*PLACE, "lengths", F.col("rank").alias("name")), "names-0")
    found: DataFrame | None = None
    level = 0
    while True:
        both = written(ranked(pairs(rows, level), ["m", "x", "y"], f"pairs-{level}", 2 << level), f"pairs-{level}")
        later = both.where("lengths is null and first < struct(d, h, i)").select(*PLACE, "m")
        found = later if found is None else found.unionByName(later)
        level += 1
        if 1 << level > min_words:
            break
        rows = both.where("lengths is not null").select(*PLACE, "lengths", F.col("rank").alias("name"))
    return found.groupBy("d", "h").agg(F.collect_list(F.struct("i", "m")).alias("spans"))


def without(text: str, spans: list[dict]) -> tuple[str, int, int, int]:
    """The text without the lines in ``spans``; its lines with a word, those deleted and their words."""
    lines = text.split("\n")
    worded = [k for k, x in enumerate(lines) if x.encode().split()]
    gone = {worded[i] for s in spans for i in range(s["i"], s["i"] + s["m"])}
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(worded), len(gone), sum(len(lines[k].encode().split()) for k in gone)


def dedup_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of line runs deleted from ``text``, and n_lines, n_deleted_lines, n_deleted_words."""
    fresh = {"n_lines", "n_deleted_lines", "n_deleted_words", "d", "h", "spans"}
    kept = [c for c in docs.columns if c.lower() not in fresh]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    spans = later_copies(source, min_words)
    rows = keyed(source).join(spans, ["d", "h"], "left").select(*[F.col(f"`{c}`") for c in kept], "spans")
    schema = rows.drop("spans").schema.add("n_lines", "long").add("n_deleted_lines", "long").add("n_deleted_words", "long")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            out = []
            for text, s in zip(batch.column(at("text")).to_pylist(), batch.column(at("spans")).to_pylist(), strict=True):
                out.append((None, 0, 0, 0) if text is None else without(text, s or []))
            text, *counts = zip(*out, strict=True) if out else [[]] * 4
            columns = [pa.array(text, pa.string()) if c == "text" else batch.column(at(c)) for c in kept] + [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_lines", "n_deleted_lines", "n_deleted_words"])

    return rows.mapInArrow(run, schema)
