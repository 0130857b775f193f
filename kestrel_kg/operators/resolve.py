"""Entity resolution: blocked similarity self-join, clusters, canonical entities, redirected relations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as sim
from ..functions import text as tx
from ..session import checkpoint
from .graphs import components, degrees
from .model import Graph, ordered_index


def blocking_pairs(entities: DataFrame) -> DataFrame:
    """left_id, right_id of entities that share a blocking key; each pair once, left under right."""
    keys = entities.select("entity_id", F.explode(tx.blocking_keys(F.col("label"), F.col("aliases"))).alias("key"))
    left, right = keys.withColumnRenamed("entity_id", "left_id"), keys.withColumnRenamed("entity_id", "right_id")
    return left.join(right, "key").where("left_id < right_id").select("left_id", "right_id").distinct()


#: Characters whose frequency orders them; all others count as rarer.
ORDERED = 256
#: Members of a key's list that one task pairs; longer lists are dealt to a triangle of cells.
CELL = 2000


def dealt_pairs(rows: DataFrame, keys: list[str], name: str, fits: Column, cell: int = CELL) -> DataFrame:
    """``rows`` paired with each other on ``keys`` where ``fits`` (over the aliases l and r) holds. A key of more than ``cell`` rows is dealt
    to cells: a row meets each share of the others in a cell of its own, so no task pairs a whole list."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("_parts")).where("_parts > 1")
    rows = rows.join(parts, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(name), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = rows.withColumn("_other", every).withColumn("_cell", F.struct(F.col("_share").alias("l"), F.col("_other").alias("r"))).drop("_parts", "_share", "_other")
    right = rows.withColumn("_other", every).withColumn("_cell", F.struct(F.col("_other").alias("l"), F.col("_share").alias("r"))).drop("_parts", "_share", "_other")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, "_cell")]
    on = fits & (F.col(f"l.{name}") < F.col(f"r.{name}"))
    for one in same:
        on &= one
    return left.alias("l").join(right.alias("r"), on)


def similar_variants(entities: DataFrame, floor: float, cell: int = CELL) -> DataFrame:
    """left_id, right_id, left_text, right_text: variants of two entities that share a blocking key, whose character counts allow a ratio
    of ``floor`` or more. No other pair of variants reaches it.

    A ratio counts matching characters twice, over both lengths; they are at most as many as the characters' counts overlap. Two variants
    of that overlap share one of their first characters in an order from rare to common (prefix filter), so only those meet: their lists are
    by blocking key and character. Lengths and whole counts are compared in the join itself.
    """
    if not 0 < floor <= 1:
        raise ValueError("the floor must lie above 0 and up to 1")
    variants = entities.select("entity_id", tx.blocking_keys(F.col("label"), F.col("aliases")).alias("keys"), F.explode(tx.entity_variants(F.col("label"), F.col("aliases"))).alias("variant"))
    rows = variants.select("entity_id", "keys", sim.sorted_words(F.col("variant")).alias("text")).dropDuplicates(["entity_id", "text"]).withColumn("chars", sim.counted_characters(F.col("text")))
    often = [r.c for r in rows.select(F.explode("chars").alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(ORDERED).collect()]
    rank = F.lit(often) if often else F.array().cast("array<bigint>")
    # array_position is 0 for all rarer ones, so the commonest character comes last
    place = lambda c: F.when(F.array_position(rank, c) > 0, F.lit(len(often)) - F.array_position(rank, c)).otherwise(-1)
    ordered = F.transform(F.array_sort(F.transform("chars", lambda c: F.struct(place(c).alias("p"), c.alias("c")))), lambda x: x["c"])
    n = F.size("chars")
    least = F.ceil(n * F.lit(floor / (2 - floor)) - 1e-9).cast("int")
    rows = rows.select("entity_id", "keys", "text", n.alias("n"), "chars", F.slice(ordered, 1, n - least + 1).alias("first")).where("n > 0")
    rows = checkpoint(rows).withColumn("key", F.explode("keys")).withColumn("char", F.explode("first"))
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))  # noqa: E741
    both = floor * (l("n") + r("n")) - 1e-9
    fits = (2 * F.least(l("n"), r("n")) >= both) & (2 * F.size(F.array_intersect(l("chars"), r("chars"))) >= both)
    # a pair that shares several keys and characters is taken at the first of them
    fits &= (F.array_intersect(l("keys"), r("keys"))[0] == l("key")) & (F.array_intersect(l("first"), r("first"))[0] == l("char"))
    pairs = dealt_pairs(rows, ["key", "char"], "entity_id", fits, cell)
    return pairs.select(l("entity_id").alias("left_id"), r("entity_id").alias("right_id"), l("text").alias("left_text"), r("text").alias("right_text"))


def similar_pairs(entities: DataFrame, floor: float) -> DataFrame:
    """left_id, right_id, lexical: all blocked pairs whose lexical similarity is ``floor`` or more."""
    rows = similar_variants(entities, floor)
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)  # small rows, long work: more tasks than their bytes would get
    found = rows.withColumn("lexical", sim.ratio_of_sorted("left_text", "right_text")).groupBy("left_id", "right_id").agg(F.max("lexical").alias("lexical"))
    return found.where(F.col("lexical") >= floor)


def label_pairs(entities: DataFrame, cell: int = CELL) -> DataFrame:
    """left_id, right_id of entities of one type: the blocking for vectors whose labels carry no names."""
    pairs = dealt_pairs(entities.select("entity_id", "entity_type"), ["entity_type"], "entity_id", F.lit(True), cell)
    return pairs.select(F.col("l.entity_id").alias("left_id"), F.col("r.entity_id").alias("right_id"))


#: Vectors of a block; two blocks meet in one task, ``STRIPE`` rows of the one with all of the other at a time.
VECTOR_BLOCK, STRIPE = 4096, 256


def similar_vectors(entities: DataFrame, threshold: float, *, joining: bool = False, block: int = VECTOR_BLOCK) -> DataFrame:
    """left_id, right_id, semantic of the entities of one type whose cosine reaches ``threshold``; each pair once, left under right.
    ``joining``: only as many of these pairs as it takes to join what they join.

    A type's vectors are dealt to blocks, and each two blocks meet in a group of their own: a vector is sent once for each block of its
    type, and no pair is shuffled unless it is similar. Vectors that are missing, hold a null or have no length are similar to none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and up to 1")
    whole = "entity_type is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)"
    rows = entities.where(whole).select("entity_id", "entity_type", F.size("embedding").alias("n"), "embedding")
    # at most a row for each ``block`` vectors, so it may be broadcast
    parts = rows.groupBy("entity_type", "n").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(F.broadcast(parts), ["entity_type", "n"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    rows = rows.select("entity_type", "n", *cell, (F.col("own") > F.col("other")).alias("second"), "entity_id", "embedding")

    def run(table: pa.Table) -> pa.Table:
        n, same, second = table.column("n")[0].as_py(), table.column("i")[0] == table.column("j")[0], table.column("second")
        one, two = table.filter(pc.invert(second)), table.filter(second)
        two = one if same else two
        (x, a), (y, b) = ((t.column("entity_id").combine_chunks(), t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)) for t in (one, two))
        found = [pa.table({"left_id": pa.array([], pa.string()), "right_id": pa.array([], pa.string()), "semantic": pa.array([], pa.float64())})]
        for p, q, value in close_pairs(a, b, threshold, same, joining):
            left, right = x.take(pa.array(p)), y.take(pa.array(q))
            under = pc.less(left, right)
            part = pa.table({"left_id": pc.if_else(under, left, right), "right_id": pc.if_else(under, right, left), "semantic": pa.array(value)})
            found.append(part.filter(pc.not_equal(left, right)))
        return pa.concat_tables(found)

    return rows.groupBy("entity_type", "n", "i", "j").applyInArrow(run, "left_id string, right_id string, semantic double")


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, joining: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a, rows of b and their cosines from ``threshold`` on, in parts; ``same``: each pair of one matrix once.

    A product of matrices leaves the pairs that can reach the threshold; their cosines are summed in the components' order, as
    ``sim.semantic_similarity`` does. ``joining``: pairs whose ends are joined already are left out.
    """
    norms = [np.sqrt(sum((c * c for c in m.T), np.zeros(len(m)))) for m in (a, b)]
    top = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    with np.errstate(all="ignore"):
        for start in range(0, len(a), STRIPE):
            below = norms[0][start : start + STRIPE, None] * norms[1][None, :]
            # what the order of the sums changes is far less than the margin; what isn't a number is looked at below
            likely = ~(a[start : start + STRIPE] @ b.T < (threshold - 1e-6) * below) | ((below > 0) & (below < 1e-200))
            likely &= below != 0
            if same:
                likely &= np.arange(len(b))[None, :] > np.arange(start, start + len(likely))[:, None]
            if joining:
                likely &= top[start : start + len(likely), None] != top[None, shift:]
            rows, columns = np.nonzero(likely)
            for s in range(0, len(rows), 50_000):
                p, q = rows[s : s + 50_000] + start, columns[s : s + 50_000]
                total = np.zeros(len(p))
                for k in range(a.shape[1]):
                    total += a[p, k] * b[q, k]
                value = total / (norms[0][p] * norms[1][q])
                value = np.where(np.isnan(value), 1.0, np.clip(value, 0.0, 1.0))  # Spark's least and SQL's count NaN as the largest
                good = value >= threshold
                p, q, value = p[good], q[good], value[good]
                if joining:
                    kept = joined_by(top, p, q + shift)
                    p, q, value = p[kept], q[kept], value[kept]
                if len(p):
                    yield p, q, value
            if joining:
                while (top != top[top]).any():
                    top[:] = top[top]


def joined_by(top: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[int]:
    """Places of the links that join two groups, one after the other; ``top`` leads from each member to its group."""
    kept = []
    for n, ends in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        x, y = ends
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append(n)
    return kept


def with_similarity(pairs: DataFrame, entities: DataFrame, alpha: float = 0.6, *, lexical: bool = True) -> DataFrame:
    """The pairs with lexical, semantic and hybrid similarity. Without vectors the semantic part is the lexical one.

    Pairs that bring a column ``lexical`` keep it; ``lexical=False`` counts it as nought.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie within 0 and 1")
    known = "lexical" in pairs.columns
    extra = [] if known or not lexical else ["variants"]
    made = entities.withColumn("variants", tx.entity_variants(F.col("label"), F.col("aliases")))
    of = lambda end: made.select(*[F.col(c).alias(f"{end}_{n}") for c, n in (("entity_id", "id"), ("entity_type", "type"), ("embedding", "vector"))], *[F.col(c).alias(f"{end}_{c}") for c in extra])
    rows = pairs.join(of("left"), "left_id").join(of("right"), "right_id")
    if extra:
        rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "left_id", "right_id")
    if not known:
        rows = rows.withColumn("lexical", sim.lexical_similarity("left_variants", "right_variants") if lexical else F.lit(0.0))
    rows = rows.withColumn("semantic", sim.semantic_similarity(F.col("left_vector"), F.col("right_vector"), F.col("lexical")))
    hybrid = sim.hybrid_similarity(F.col("lexical"), F.col("semantic"), F.col("left_type"), F.col("right_type"), alpha)
    return rows.select("left_id", "right_id", "lexical", "semantic", hybrid.alias("hybrid"))


def matching_pairs(entities: DataFrame, alpha: float = 0.6, threshold: float = 0.85) -> DataFrame:
    """The blocked pairs whose hybrid similarity reaches the threshold, with their similarities.

    A lexical floor follows from the threshold; only where vectors alone could reach it are all blocked pairs compared.
    """
    floor = sim.lexical_floor(threshold, alpha, vectors=bool(entities.where("embedding is not null").limit(1).count()))
    pairs = similar_pairs(entities, floor) if floor > 0 else blocking_pairs(entities)
    return with_similarity(pairs, entities, alpha).where(F.col("hybrid") >= threshold)


def canonical_map(graph: Graph, matches: DataFrame) -> DataFrame:
    """entity_id, component, canonical_id: the member of most edges, then first in order, then by label and id."""
    nodes = graph.entities.select(F.col("entity_id").alias("node"))
    found = components(nodes, matches.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))).withColumnRenamed("node", "entity_id")
    rows = found.join(graph.entities.select("entity_id", "ord", tx.normalize_label(F.col("label")).alias("name")), "entity_id").join(degrees(graph).select("entity_id", "degree"), "entity_id")
    best = rows.groupBy("component").agg(F.min(F.struct((-F.col("degree")).alias("d"), "ord", "name", "entity_id")).alias("best"))
    return rows.select("entity_id", "component").join(best, "component").select("entity_id", "component", F.col("best.entity_id").alias("canonical_id"))


def unique_by_canon(rows: DataFrame, values: Column, order: Column, name: str) -> DataFrame:
    """canonical_id, ``name``: the strings (c: canonical form, v) of an array column of all members in ``order``, the first of each
    canonical form; nulls stay."""
    parts = rows.select("canonical_id", order.alias("o"), F.posexplode(values).alias("p", "v")).withColumn("c", tx.canonical_text(F.col("v")))
    first = parts.groupBy("canonical_id", "c", F.when(F.col("c").isNull(), F.struct("o", "p")).alias("_null")).agg(F.min(F.struct("o", "p", "v")).alias("f"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("f.o").alias("o"), F.col("f.p").alias("p"), F.col("f.v").alias("v"), "c")))
    return first.groupBy("canonical_id").agg(listed.alias(name))


def merged_entities(graph: Graph, mapping: DataFrame) -> DataFrame:
    """Canonical entities with their members' aliases, labels, chunks, metadata, first description and vector; in order of id."""
    rows = graph.entities.join(mapping, "entity_id")
    own = F.col("entity_id") == F.col("canonical_id")
    order = F.struct((~own).alias("o"), F.col("entity_id").alias("i"))
    mine = lambda c: F.max(F.when(own, F.col(c)))
    first = lambda c, test: F.min_by(F.when(test, F.col(c)), F.when(test, order))
    groups = rows.groupBy("canonical_id").agg(
        mine("label").alias("label"), mine("entity_type").alias("entity_type"), F.coalesce(first("description", F.col("description") != ""), F.lit("")).alias("description"),
        first("embedding", F.col("embedding").isNotNull()).alias("embedding"), F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("metadata").alias("meta")))).alias("m"),
    )
    names = F.when(own, F.col("aliases")).otherwise(F.concat(F.array("label"), F.col("aliases")))
    groups = groups.join(unique_by_canon(rows, names, order, "names"), "canonical_id", "left").join(unique_by_canon(rows, F.col("source_chunks"), order, "chunks"), "canonical_id", "left")
    groups = groups.withColumn("form", tx.canonical_text(F.col("label")))
    none = F.array().cast("array<string>")
    clean = F.coalesce(F.transform(F.filter("names", lambda x: (x["c"] != "") & (x["c"] != F.col("form"))), lambda x: x["v"]), none)
    chunks = F.coalesce(F.transform("chunks", lambda x: x["v"]), none)
    read = lambda x: F.coalesce(F.from_json(x["meta"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    meta = F.aggregate(F.transform("m", read), F.create_map().cast("map<string,string>"), lambda a, b: F.map_concat(a, b))
    out = groups.select(F.col("canonical_id").alias("entity_id"), "label", "entity_type", "description", clean.alias("aliases"), chunks.alias("source_chunks"), "embedding", F.to_json(meta).alias("metadata"))
    return ordered_index(out, "ord", "entity_id")


def redirected(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations between canonical entities, without loops, the first of equal ones (equal confidence and chunk too)."""
    to = lambda end: mapping.select(F.col("entity_id").alias(f"{end}_id"), F.col("canonical_id").alias(f"_{end}"))
    rows = relations.join(to("subject"), "subject_id", "left").join(to("object"), "object_id", "left")
    checked = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("a relation refers to an unknown entity"))).otherwise(F.col(c))
    rows = rows.withColumns({"subject_id": checked("_subject"), "object_id": checked("_object")}).drop("_subject", "_object").where("subject_id <> object_id")
    same = Window.partitionBy("subject_id", "predicate", "object_id", "confidence", "source_chunk").orderBy("relation_index")
    return rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*relations.columns)


@dataclass(frozen=True)
class Resolution:
    graph: Graph
    mapping: DataFrame
    before: int
    after: int


def resolve(graph: Graph, *, alpha: float = 0.6, threshold: float = 0.85, pairs: DataFrame | None = None, lexical: bool = True) -> Resolution:
    """Merge near-duplicate entities; a graph without any comes back as it is."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie within 0 and 1")
    if pairs is None and lexical:
        matches = matching_pairs(graph.entities, alpha, threshold)
    else:
        matches = with_similarity(blocking_pairs(graph.entities) if pairs is None else pairs, graph.entities, alpha, lexical=lexical).where(F.col("hybrid") >= threshold)
    mapping = canonical_map(graph, matches)
    before, after = mapping.agg(F.count("*"), F.countDistinct("component")).first()
    if after == before:
        return Resolution(graph, mapping, before, after)
    return Resolution(Graph(merged_entities(graph, mapping), ordered_index(redirected(graph.relations, mapping).withColumnRenamed("relation_index", "_old"), "relation_index", "_old").drop("_old")), mapping, before, after)


def clusters(mapping: DataFrame, entities: DataFrame) -> DataFrame:
    """component, members (ids by label) of the clusters that merge several entities."""
    rows = mapping.join(entities.select("entity_id", "label"), "entity_id").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("label", "entity_id"))).alias("m"))
    return rows.where(F.size("m") > 1).select("component", F.transform("m", lambda x: x["entity_id"]).alias("members"))
