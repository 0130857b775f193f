"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A vector x becomes x' = (x, sqrt(M^2 - |x|^2)), M the largest norm of all, and an anchor q becomes q' = (q, 0). Then |q' - x'|^2 =
|q|^2 + M^2 - 2 q.x: the higher the inner product, the nearer, and a window of scores is an annulus of distances around the anchor.

Vectors are multiplied by ``scale`` and floored, so scores are exact integers; distances only decide what may be skipped, with a margin.

* The rows are dealt to blocks by a vantage-point tree with at most ``LEAVES`` leaves, fitted on at most ``SAMPLE`` rows (those of least
  hash) and sent to all tasks. Every row goes to the leaf that its distances name, and a leaf of more rows than a block should have,
  such as one of equal vectors, is dealt to several blocks.
* In a task a block's rows come first and get a tree of their own; the queries sent to that block then stream past it. A query's leaves
  are visited nearest first, as long as one can hold a row that is nearer than the k-th found so far and lies inside the annulus.
* Positives: an anchor first asks one block of its own leaf, which gives a radius; then all blocks whose leaf meets that radius.
  Negatives: a window asks the blocks whose leaf meets its annulus. Each block gives at most k rows a query, which are merged.

The result is exact, whatever the tree. Memory: a task holds one block, at most twice ``MOST`` rows, and one Arrow batch of queries. Rows a
block grow with the table between ``LEAST`` and ``MOST``, so that a query meets at most ``BLOCKS`` blocks before these limits bind.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Repeated rows (id, label and
vector) count once; of rows with one id that differ each takes part as a row of its own, none is a partner of its own id, and positives of
one anchor that share id and score are one. A vector that is shorter than
others is filled up with noughts. An empty table gives an empty result. Scores that don't fit into a long raise an error, as do components
that don't. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SAMPLE, LEAVES = 20_000, 4096
#: Rows a block, at the least and at the most, and the number of blocks aimed at in between.
LEAST, MOST, BLOCKS = 1024, 65_536, 256
#: Rows of the leaves of a block's own tree.
LEAF = 128
#: Queries compared with a block at once.
BATCH = 512
#: Distances differ from the true ones by less than this share of the largest norm.
MARGIN = 1e-6


@dataclass
class Tree:
    """A vantage-point tree over augmented vectors: node i has the children 2i+1 (within its radius) and 2i+2."""

    vantage: np.ndarray
    radius: np.ndarray  # nan: the node is a leaf or doesn't exist
    most: float  # the largest norm squared

    @staticmethod
    def fit(vectors: np.ndarray, most: float, leaf: int, leaves: int) -> Tree:
        """Split by the median distance to the row farthest from the node's first one, until a node has at most ``leaf`` rows."""
        depth = 0
        while depth < 24 and 2 ** (depth + 1) <= leaves and len(vectors) > leaf * 2**depth:
            depth += 1
        tree = Tree(np.zeros((2**depth - 1, vectors.shape[1])), np.full(2**depth - 1, np.nan), most)
        last, parts = extra(vectors, most), [np.arange(len(vectors))]
        for node in range(2**depth - 1):
            rows = parts[node]
            inner = outer = rows[:0]
            if len(rows) > leaf:
                far = rows[np.argmax(apart(vectors[rows], last[rows], vectors[rows[0]], last[rows[0]], most))]
                away = apart(vectors[rows], last[rows], vectors[far], last[far], most)
                cut = float(np.median(away))
                if (away > cut).any():
                    tree.vantage[node], tree.radius[node] = vectors[far], cut
                    inner, outer = rows[away <= cut], rows[away > cut]
            parts += [inner, outer]
        return tree

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf (a node's number) of each row."""
        at = np.zeros(len(vectors), np.int64)
        last = extra(vectors, self.most)
        for node in range(len(self.radius)):
            if not np.isnan(self.radius[node]) and len(rows := np.flatnonzero(at == node)):
                v = self.vantage[node]
                away = apart(vectors[rows], last[rows], v, extra(v[None], self.most)[0], self.most)
                at[rows] = 2 * node + 1 + (away > self.radius[node])
        return at

    def bounds(self, queries: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that a row of a leaf can have from each query."""
        away = np.sqrt(np.maximum((queries * queries).sum(axis=1) + self.most - 2 * self.vantage @ queries.T, 0))
        near, far = np.zeros((2 * len(self.radius) + 1, len(queries))), np.full((2 * len(self.radius) + 1, len(queries)), np.inf)
        for node, radius in enumerate(self.radius):
            if not np.isnan(radius):
                inner, outer = 2 * node + 1, 2 * node + 2
                near[inner], near[outer] = np.maximum(near[node], away[node] - radius), np.maximum(near[node], radius - away[node])
                far[inner], far[outer] = np.minimum(far[node], away[node] + radius), far[node]
        return near[leaves].T, far[leaves].T


def extra(vectors: np.ndarray, most: float) -> np.ndarray:
    """The added component of each row."""
    return np.sqrt(np.maximum(most - (vectors * vectors).sum(axis=1), 0))


def apart(vectors: np.ndarray, last: np.ndarray, one: np.ndarray, one_last: float, most: float) -> np.ndarray:
    """Distances of augmented rows from one of them."""
    return np.sqrt(np.maximum(2 * (most - vectors @ one - last * one_last), 0))


class Block:
    """Rows of one block under a tree of their own."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: int) -> None:
        self.tree = Tree.fit(vectors.astype(float), float(most), LEAF, 1 << 20)
        at = self.tree.assign(vectors.astype(float))
        order = np.lexsort((ids, at))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.leaves, starts = np.unique(at[order], return_index=True)
        self.edges = [*starts, len(order)]
        self.most = most

    def search(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, high: np.ndarray, low: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, [query, k], of the first k rows of the same label (or of others) with ``low`` <= score <= ``high``; id -1
        in the place of a missing one has the least score."""
        floats, slack = vectors.astype(float), MARGIN * (float(self.most) ** 0.5 + 1)
        squares = (floats * floats).sum(axis=1)
        away = lambda score: np.sqrt(np.maximum(squares + float(self.most) - 2.0 * score, 0))
        near, far = self.tree.bounds(floats, self.leaves)
        inner, reach = away(high) - slack, away(low) + slack
        order = np.argsort(near, axis=1, kind="stable")
        none = np.iinfo(np.int64).min
        best, found = np.full((len(ids), k), none), np.full((len(ids), k), -1)
        active = np.arange(len(ids))
        for wave in range(order.shape[1]):
            leaf = order[active, wave]
            worst = best[active, -1]
            limit = np.where(worst > none, np.minimum(reach[active], np.sqrt(np.maximum(squares[active] + float(self.most) - 2.0 * worst, 0)) + slack), reach[active])
            going = near[active, leaf] <= limit
            active, leaf = active[going], leaf[going]
            if not len(active):
                break
            for one in np.unique(leaf):
                q = active[leaf == one]
                q = q[far[q, one] >= inner[q]]
                if not len(q):
                    continue
                part = slice(self.edges[one], self.edges[one + 1])
                scores = product(vectors[q], self.vectors[part], self.most)
                fits = ((self.labels[part] == labels[q][:, None]) == same) & (self.ids[part] != ids[q][:, None]) & (scores <= high[q][:, None]) & (scores >= low[q][:, None])
                scores = np.where(fits, scores, none)
                all_s = np.concatenate([best[q], scores], axis=1)
                all_i = np.concatenate([found[q], np.where(fits, self.ids[part], -1)], axis=1)
                first = np.lexsort((all_i, -np.maximum(all_s, none + 1)), axis=1)[:, :k]
                best[q], found[q] = np.take_along_axis(all_s, first, 1), np.take_along_axis(all_i, first, 1)
        return best, found


def product(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products: no partial sum is over ``most``, the largest norm squared, so doubles are exact below 2^53."""
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with noughts to ``width``."""
    out = np.zeros((len(column), width), np.int64)
    if len(column):
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        values = column.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(column)), sizes)
        out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def prepared(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, vector of the rows that take part; components as floored longs."""
    x = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # casting to long saturates, so what doesn't fit is told apart before
    whole = F.transform("vector", lambda v: F.when(F.abs(F.floor(v * float(scale)).cast("double")) < 2.0**62, F.floor(v * float(scale))).otherwise(F.raise_error(F.lit("a component doesn't fit into a long")).cast("long")))
    return x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(fine).select("id", "label", whole.alias("vector")).distinct()


#: Scores from low to high; name, key and mark come back with what is found.
WINDOW = "struct<name:long,key:long,mark:long,low:long,high:long>"


@dataclass(frozen=True)
class Index:
    """The rows dealt to blocks (block, leaf, id, label, vector), the blocks of each leaf, and what tasks need to know."""

    rows: DataFrame
    parts: dict[int, int]
    tree: Tree
    width: int
    most: int


def build(rows: DataFrame, *, scale: int = 256, sample: int = SAMPLE, least: int = LEAST) -> Index | None:
    """The index over rows (id, label, vector); None if no row takes part."""
    kept = written(prepared(rows, scale), "vectors")
    norm = F.aggregate("vector", F.lit(0).cast("decimal(38,0)"), lambda s, v: (s + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))
    count, most, width = kept.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vector"))).first()
    if not count:
        return None
    most = int(most)
    if most >= 1 << 63:
        raise ValueError("scores don't fit into a long")
    size = min(max(count // BLOCKS, least), MOST)
    name = F.xxhash64("id", "label", "vector")
    few = kept.where(F.pmod(name, F.lit(1_000_000)) * count <= 2_000_000 * sample)  # spares the sort most rows
    chosen = few.orderBy(name).limit(sample).select("vector").toArrow().column(0)
    leaf = max(1, size * min(count, sample) // count)
    tree = Tree.fit(matrix(chosen.combine_chunks(), width).astype(float), float(most), leaf, LEAVES)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = tree.assign(matrix(b.column(2), width).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], names=["leaf", *b.schema.names])

    dealt = written(kept.mapInArrow(assign, "leaf long, id long, label long, vector array<long>"), "leaves")
    counts = {r["leaf"]: -(-r["count"] // size) for r in dealt.groupBy("leaf").count().collect()}  # at most LEAVES rows
    sizes = F.broadcast(rows.sparkSession.createDataFrame(list(counts.items()), "leaf long, parts long"))
    return Index(dealt.join(sizes, "leaf").withColumn("block", F.col("leaf") * (1 << 32) + F.pmod(name, F.col("parts"))).drop("parts"), counts, tree, width, most)


def route(index: Index, queries: DataFrame, home: bool = False) -> DataFrame:
    """The queries (id, label, vector, windows: array of ``WINDOW``), each for every block that one of its windows may meet;
    ``home``: only for one block of the leaf to which the anchor itself belongs."""
    tree, parts, width, most = index.tree, index.parts, index.width, index.most
    leaves = np.array(sorted(parts), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                piece = b.slice(at, BATCH)
                vectors = matrix(piece.column(2), width).astype(float)
                if home:
                    own = tree.assign(vectors)
                    take, to = np.arange(len(own)), own * (1 << 32) + piece.column(0).to_numpy() % np.array([parts[x] for x in own.tolist()], np.int64)
                else:
                    near, far = tree.bounds(vectors, leaves)
                    meets = np.zeros(near.shape, bool)
                    squares, slack = (vectors * vectors).sum(axis=1), MARGIN * (float(most) ** 0.5 + 1)
                    w = piece.column(3)
                    row = np.repeat(np.arange(len(w)), w.value_lengths().to_numpy(zero_copy_only=False))
                    low, high = (w.flatten().field(n).to_numpy() for n in ("low", "high"))
                    away = lambda score: np.sqrt(np.maximum(squares[row] + float(most) - 2.0 * score, 0))
                    np.logical_or.at(meets, row, (near[row] <= (away(low) + slack)[:, None]) & (far[row] >= (away(high) - slack)[:, None]))
                    take, which = np.nonzero(meets)
                    n = np.array([parts[x] for x in leaves.tolist()], np.int64)[which]
                    first = np.repeat(np.cumsum(n) - n, n)
                    take, to = np.repeat(take, n), np.repeat(leaves[which], n) * (1 << 32) + np.arange(n.sum()) - first
                for s in range(0, len(take), 4096):
                    rows = piece.take(pa.array(take[s : s + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[s : s + 4096]), *rows.columns], names=["block", *rows.schema.names])

    return queries.select("id", "label", "vector", "windows").mapInArrow(run, f"block long, id long, label long, vector array<long>, windows array<{WINDOW}>")


def search(index: Index, routed: DataFrame, *, same: bool, k: int) -> DataFrame:
    """anchor, name, key, mark, score, id: at most k rows of each block for every window. A block's rows come before its queries in a task."""
    width, most = index.width, index.most
    both = index.rows.select("block", F.lit(0).alias("kind"), "id", "label", "vector", F.lit(None).cast(f"array<{WINDOW}>").alias("windows")).unionByName(routed.withColumn("kind", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, data = None, [], None
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1), b.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if blocks[start] != block:
                    block, held, data = blocks[start], [], None
                if kinds[start] == 0:
                    held.append(pa.RecordBatch.from_arrays(b.slice(start, end - start).columns[2:5], names=["id", "label", "vector"]))
                    continue
                if not held and data is None:
                    continue  # a block that hashing left without rows
                if data is None:
                    ids, labels, vectors = (np.concatenate([f(x) for x in held]) for f in (lambda x: x.column(0).to_numpy(), lambda x: x.column(1).to_numpy(), lambda x: matrix(x.column(2), width)))
                    data, held = Block(ids, labels, vectors, most), []
                for at in range(start, end, BATCH):
                    piece = b.slice(at, min(BATCH, end - at))
                    w = piece.column(5)
                    row = np.repeat(np.arange(len(w)), w.value_lengths().to_numpy(zero_copy_only=False))
                    name, key, mark, low, high = (w.flatten().field(n).to_numpy() for n in ("name", "key", "mark", "low", "high"))
                    ids = piece.column(2).to_numpy()[row]
                    scores, found = data.search(ids, piece.column(3).to_numpy()[row], matrix(piece.column(4), width)[row], high, low, same, k)
                    at_q, at_k = np.nonzero(scores > np.iinfo(np.int64).min)
                    if len(at_q):
                        yield pa.RecordBatch.from_arrays([*(pa.array(x[at_q]) for x in (ids, name, key, mark)), pa.array(scores[at_q, at_k]), pa.array(found[at_q, at_k])], names=["anchor", "name", "key", "mark", "score", "id"])

    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "anchor long, name long, key long, mark long, score long, id long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, with their rank."""
    order = Window.partitionBy("anchor", "name", "key", "mark").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1


def mine(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id, label, vector. ``anchors``: which rows are anchors. An anchor's positives are its first rows of the same label; a
    positive's negatives are the first rows of other labels whose score lies within ``window`` hundredths of the positive's.
    """
    index = build(rows, scale=scale, sample=sample, least=least)
    if index is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # rows of one anchor id that differ are anchors of their own: the name tells them apart
    asked = index.rows.where(anchors).select("id", "label", "vector", F.xxhash64("id", "label", "vector").alias("name"))
    zero = F.lit(0).cast("long")
    down_to = lambda low: F.array(F.struct("name", zero.alias("key"), zero.alias("mark"), low.alias("low"), F.lit(HIGHEST).alias("high")))
    near = search(index, route(index, asked.withColumn("windows", down_to(F.lit(LOWEST))), home=True), same=True, k=positives)
    near = first(near, positives).where(F.col("rank") == positives).select("name", F.col("score").alias("least"))
    ball = asked.join(near, "name", "left").withColumn("windows", down_to(F.coalesce("least", F.lit(LOWEST))))
    pairs = first(search(index, route(index, ball), same=True, k=positives), positives).select("name", F.col("id").alias("key"), F.col("score").alias("mark")).distinct()
    # a score under nought has no window; the products may pass 64 bits
    wide = lambda share: F.lit(share).cast("decimal(10,0)") * F.col("mark").cast("decimal(20,0)")
    low, high = F.ceil(wide(window[0]) / F.lit(100).cast("decimal(3,0)")).cast("long"), F.floor(wide(window[1]) / F.lit(100).cast("decimal(3,0)")).cast("long")
    spans = pairs.where("mark >= 0").withColumns({"low": low, "high": high}).groupBy("name").agg(F.collect_list(F.struct("name", "key", "mark", "low", "high")).alias("windows"))
    found = first(search(index, route(index, asked.join(spans, "name")), same=False, k=negatives), negatives)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("mark").alias("positive_score"), F.col("score").alias("negative_score"))
