"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function maps a document's shingles (``words`` consecutive words, A-Z in lower case) to 64 bits; its sketch is the ``k``
least values. Documents of equal shingle sets are one class from the start. The classes' retained values form inverted lists, and
a pair that shares a list is a candidate. A pair with a sketch of the union of which fewer than ``estimate`` of the values lie in
both is let go; the others are confirmed on their full sets: ``100 * |A and B| >= percent * |A or B|``.

Lists. A pair that passes the estimate shares at least ``estimate * |sketch|`` values, so it also shares one of each side's
``|sketch| - ceil(estimate * |sketch|) + 1`` rarest values (prefix filter, by number of classes): only those are listed, which takes
passages that many documents share out of the lists without losing a pair. Sets so small that each similar set is its own sketch use
the similarity itself in place of the estimate. With ``k = 64`` and ``estimate = 0.5`` a pair of
similarity 0.75 is estimated too low with a probability of about 1e-5 (binomial tail); sketches of sets of at most ``k`` shingles
are the sets themselves and exact.

Large lists. Only components are wanted, so no list emits all its pairs. First every class is paired with the least class of each
of its lists; those links are confirmed and joined to components. What still lies in lists with several components is compared
across components only, and exactly: a list of up to ``block`` classes in one task, which emits a pair that passes the estimate only
from the first list that both share; larger lists are joined to clusters of classes, whose blocks of ``block`` classes meet pairwise:
sizes and sketches leave a few pairs, these are confirmed on their full sets, and no more links are emitted than it takes to join what
belongs together. The pairs of a class that many others meet are dealt to several tasks (``dealt_join``).

Cases: null and empty texts have no shingles, link with nothing and are kept. Texts of fewer words than a shingle have their whole
word sequence as one. Rows of equal doc_id are one document, linked with what any of its texts is linked with; rows of null doc_id
link with nothing. Empty tables give no rows. Extra columns aren't read by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, dealt_join, lean, texts, written
from .components import connected_components

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Spark's longs are signed; this keeps the order of the unsigned hashes.
SIGN = np.uint64(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: WordHash, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    found = hashes.array(text.lower().split())
    n = min(words, len(found))
    if not n:
        return found
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + found[i : len(found) - n + 1 + i]
    return np.unique(mixed(out))


def signatures(docs: DataFrame, words: int, k: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            n, key, sketch = [], [], []
            for text in texts(batch):
                found = shingles(text, hashes, words)
                n.append(len(found))
                key.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketch.append(found[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n", "key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key binary, sketch binary")


def prefixes(classes: DataFrame, k: int, estimate: float, percent: int) -> DataFrame:
    """rep, n, prefix: each class's rarest retained values, of those that other classes have too."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                values = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                times = [len(v) for v in values]
                rep, n = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
                flat = (np.concatenate(values) ^ SIGN).view(np.int64) if values else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(rep, pa.int64()), pa.array(n, pa.int64())], names=["value", "rep", "n"])

    values = classes.select("rep", "n", "sketch").mapInArrow(run, "value long, rep long, n long")
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    size = F.least(F.col("n"), F.lit(k))
    share = F.when(F.col("n") * 100 <= k * percent, F.ceil(size * percent / 100)).otherwise(F.ceil(size * F.lit(estimate)))
    shared = values.join(often, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    # values of one class alone are the rarest and fill the prefix first
    room = F.greatest(F.lit(0), size - share + 1 - (size - F.size("shared"))).cast("int")
    rows = shared.select("rep", "n", F.transform(F.slice("shared", F.lit(1), room), lambda x: x["value"]).alias("prefix"))
    return rows.where(F.size("prefix") > 0)


def similar_size(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def union_estimate(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Share of the union's ``k`` least values that lie in both sketches."""
    both = np.union1d(x, y)[:k]
    return len(np.intersect1d(np.intersect1d(x, y, True), both, True)) / len(both)


def estimated(pairs: DataFrame, sketches: DataFrame, k: int, estimate: float) -> DataFrame:
    """The pairs a, b that pass the estimate."""
    pairs = written(pairs, "pairs")
    rows = dealt_join(pairs, sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), ["a"]).join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            good = [union_estimate(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), k) >= estimate for p, q in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, whole: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar."""
    pairs = written(pairs, "pairs")
    rows = dealt_join(pairs, whole.select(F.col("rep").alias("a"), F.col("text").alias("x")), ["a"]).join(whole.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            good, last, held = [], None, None
            for p, q in zip(texts(batch, "x"), texts(batch, "y"), strict=True):
                if p is not last and p != last:
                    last, held = p, shingles(p, hashes, words)
                other = shingles(q, hashes, words)
                same = len(np.intersect1d(held, other, True))
                good.append(100 * same >= percent * (len(held) + len(other) - same))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def mixed_lists(lists: DataFrame, members: DataFrame) -> DataFrame:
    """value, rep, component, size of the lists of three classes or more that hold several components."""
    at = lists.join(members.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", F.coalesce("component", "rep").alias("component"))
    several = at.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("p"), F.max("component").alias("q")).where("size > 2 and p <> q")
    return at.join(several.select("value", "size"), "value")


def in_small_lists(mixed: DataFrame, details: DataFrame, k: int, estimate: float, percent: int, block: int) -> DataFrame:
    """Pairs a, b of different components that pass the estimate, each from the least of the lists that both are in."""
    rows = mixed.where(F.col("size") <= block).select("value", "rep", "component").join(details, "rep")
    groups = rows.groupBy("value").agg(F.collect_list(F.struct("rep", "n", "component", "sketch", "prefix")).alias("x"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for value, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, component = np.array([r["n"] for r in x]), np.array([r["component"] for r in x])
                most = np.maximum.outer(n, n)
                good = (component[:, None] != component[None, :]) & (100 * np.minimum.outer(n, n) >= percent * most)
                if not np.triu(good, 1).any():
                    continue
                sketch = incidence([np.frombuffer(r["sketch"], np.uint64).tolist() for r in x])
                good &= sketch @ sketch.T >= estimate * np.minimum(most, k)
                before = incidence([[v for v in r["prefix"] if v < value] for r in x])
                good &= before @ before.T == 0
                p, q = np.nonzero(np.triu(good, 1))
                out += [(min(x[i]["rep"], x[j]["rep"]), max(x[i]["rep"], x[j]["rep"])) for i, j in zip(p, q, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def incidence(rows: list[list[int]]) -> np.ndarray:
    """A matrix of rows by values, of ones where a row has a value."""
    place = {v: c for c, v in enumerate({v for row in rows for v in row})}
    out = np.zeros((len(rows), max(len(place), 1)), np.float32)
    for r, row in enumerate(rows):
        out[r, [place[v] for v in row]] = 1
    return out


def in_large_lists(mixed: DataFrame, whole: DataFrame, words: int, k: int, estimate: float, percent: int, block: int) -> DataFrame:
    """Links a, b, confirmed on full sets, that join the components of each cluster of large lists as far as its pairs do.

    Parcels of ``PARCEL`` times ``block`` classes meet each other; in a task their classes are compared by blocks. A text is sent once for
    each parcel that its own meets.
    """
    rows = mixed.where(F.col("size") > block)
    hubs = rows.groupBy("value").agg(F.min("rep").alias("hub"))
    clusters = connected_components(rows.join(hubs, "value").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    at = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(rows.select("rep", "component").distinct(), "rep")
    # the largest component's classes needn't meet each other
    counts = at.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("m"))
    counts = counts.select("cluster", F.col("m.component").alias("main"), F.ceil(F.col("size") / (PARCEL * block)).cast("int").alias("blocks"))
    at = at.join(counts, "cluster").select("cluster", "rep", "component", (F.col("component") == F.col("main")).alias("in_main"), F.pmod(F.hash("rep"), "blocks").alias("i"))
    held = at.join(whole, "rep").groupBy("cluster", "in_main", "i").agg(F.collect_list(F.struct("rep", "component", "text")).alias("x"))
    held = written(held.withColumn("at", 2 * F.col("i") + F.col("in_main").cast("int")), "blocks")
    keys = held.select("cluster", "at", "in_main")
    others = held.select("cluster", F.col("at").alias("other"), F.col("in_main").alias("other_main"))
    meet = keys.join(others, "cluster").where("other >= at and not (in_main and other_main)").select("cluster", "at", "other")
    joined = meet.join(held.select("cluster", "at", "x"), ["cluster", "at"]).join(held.select("cluster", F.col("at").alias("other"), F.col("x").alias("y")), ["cluster", "other"])
    joined = joined.select((F.col("at") == F.col("other")).alias("same"), "x", "y")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for r in range(batch.num_rows):
                same, x, y = (batch.column(c)[r].as_py() for c in range(3))
                y = [] if same else y
                rows = x + y
                sets, component = [shingles((row["text"] or "").encode(), hashes, words) for row in rows], [row["component"] for row in rows]
                top = {c: c for c in component}
                links = []
                for p, q in meetings(len(x), len(rows), block):
                    at = [*range(*p), *(range(*q) if q else ())]
                    found = joining_links([sets[i] for i in at], [component[i] for i in at], p[1] - p[0] if q else None, percent, k, estimate, top)
                    links += [(at[i], at[j]) for i, j in found]
                a, b = np.array([[rows[i]["rep"] for i in pair] for pair in links], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


#: Blocks of a parcel.
PARCEL = 8


def meetings(first: int, n: int, block: int) -> Iterator[tuple[tuple[int, int], tuple[int, int] | None]]:
    """Stretches of at most ``block`` rows that are compared: all of ``n`` with each other (None: with themselves) if they are ``first``
    rows alone, else the first ones with the others."""
    cut = lambda a, b: [(i, min(i + block, b)) for i in range(a, b, block)]
    left = cut(0, first)
    if first == n:
        for i, p in enumerate(left):
            yield p, None
            yield from ((p, q) for q in left[i + 1 :])
    else:
        yield from ((p, q) for p in left for q in cut(first, n))


def joining_links(sets: list[np.ndarray], component: list[int], cut: int | None, percent: int, k: int = 64, estimate: float = 0.5, top: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """A forest of links between similar sets of different components; with ``cut``, of the rows before it with those from it on.
    ``top``: components that links found before have joined.

    Sizes and the estimate from the sketches leave few pairs; their full sets are merged one by one, so memory is that of the sets."""
    sizes, of = np.array([len(s) for s in sets]), np.array(component)
    left, right = (slice(None), slice(None)) if cut is None else (slice(0, cut), slice(cut, None))
    least, most = np.minimum.outer(sizes[left], sizes[right]), np.maximum.outer(sizes[left], sizes[right])
    sketch = incidence([s[:k].tolist() for s in sets])
    likely = (of[left][:, None] != of[right][None, :]) & (100 * least >= percent * most) & (sketch[left] @ sketch[right].T >= estimate * np.minimum(most, k))
    if cut is None:
        likely = np.triu(likely, 1)
    top = {c: c for c in component} if top is None else top

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(likely), strict=True):
        i, j = int(i), int(j) + (cut or 0)
        p, q = find(component[i]), find(component[j])
        if p != q:
            same = len(np.intersect1d(sets[i], sets[j], True))
            if 100 * same < percent * (len(sets[i]) + len(sets[j]) - same):
                continue
            top[p] = q
            out.append((i, j))
    return out


def apart(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component."""
    of = lambda end: members.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 75, k: int = 64, estimate: float = 0.5, block: int = 200) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    marks = written(signatures(docs, words, k), "signatures")
    classes = marks.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    rarest = written(prefixes(classes, k, estimate, percent), "prefixes")
    lists = rarest.select("rep", "n", F.explode("prefix").alias("value"))
    involved = rarest.select("rep")
    sketches = classes.join(involved, "rep", "left_semi").select("rep", "sketch")
    whole = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(involved, "rep", "left_semi")
    whole = written(whole, "candidate-texts")

    hubs = lists.groupBy("value").agg(F.min(F.struct("rep", "n")).alias("hub")).select("value", F.col("hub.rep").alias("a"), F.col("hub.n").alias("na"))
    stars = lists.select("value", F.col("rep").alias("b"), F.col("n").alias("nb")).join(hubs, "value").where("a < b").where(similar_size(percent)).select("a", "b").distinct()
    stars = written(estimated(stars, sketches, k, estimate), "star-pairs")
    # one pair for each class first, then those of the others that still lie apart
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = written(confirmed(first, whole, words, percent), "links")
    members = connected_components(links)
    rest = apart(stars.join(first, ["a", "b"], "left_anti"), members)
    links = written(links.unionByName(confirmed(rest, whole, words, percent)), "links")
    members = connected_components(links)
    mixed = written(mixed_lists(lists, members), "mixed-lists")
    rest = in_small_lists(mixed, sketches.join(rarest, "rep"), k, estimate, percent, block)
    links = links.unionByName(confirmed(rest.join(stars, ["a", "b"], "left_anti"), whole, words, percent))
    if mixed.where(F.col("size") > block).limit(1).count():
        links = links.unionByName(in_large_lists(mixed, whole, words, k, estimate, percent, block))
    members = connected_components(written(links, "links"))

    found = classes.select("key", "rep").join(members.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    # classes of one document need no look-up; the others' documents meet them by the set's hash
    out = marks.select("doc_id", "n", "key").join(found, "key", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
