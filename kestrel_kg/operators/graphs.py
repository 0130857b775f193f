"""Graph measures: degrees, PageRank, components, neighbourhoods, subgraphs.

PageRank and components go on in steps whose lineage is cut by checkpoints.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import bucketed, checkpoint
from .model import Graph


def nodes_of(graph: Graph) -> DataFrame:
    return graph.entities.select(F.col("entity_id").alias("node"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("dst", "src")).distinct()


#: Steps of PageRank in one job.
STRIDE = 4


def spread(links: DataFrame, values: DataFrame, alpha: float) -> DataFrame:
    """node, value: what each node gets if every node shares ``alpha`` of its value (node, value) among its links (src, dst, out)."""
    return links.join(values.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.lit(alpha) * F.sum(F.col("value") / F.col("out"))).alias("value"))


class Ranks:
    """PageRank's vector in jobs of several steps.

    A step is x' = A x + e / n, where A spreads along links and e = alpha * (what dangling nodes hold) + 1 - alpha. So after k steps
    x = A^k x0 + sum of e_j * A^(k-j) (1/n). The powers of the uniform vector are made once, for the first few k; a job makes A^k x0 in
    a chain of joins without knowing any e, and the masses observed on the way give the e afterwards: what reaches all nodes in a step is
    what those with links held before it.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, n: int, alpha: float) -> None:
        degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
        self.links = bucketed(edges.join(degree, edges["src"] == degree["node"]).select("src", "dst", "out"), "src")
        self.alpha, self.n = alpha, n
        power = nodes.select("node", F.lit(1 / n).alias("value"))
        rows = nodes.join(degree, "node", "left").select("node", "out", F.lit(1 / n).alias("b0"))
        for k in range(1, STRIDE):
            power = spread(self.links, power, alpha)
            rows = rows.join(power.withColumnRenamed("value", f"b{k}"), "node", "left").fillna(0.0, [f"b{k}"])
        self.powers = [f"b{k}" for k in range(STRIDE)]
        self.state = checkpoint(rows)
        self.x, self.old = F.col("b0"), None
        loose = self.state.where("out is null").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in self.powers]).first()
        self.loose_powers, self.loose = list(loose), loose[0]

    def go(self, steps: int) -> None:
        """On by up to ``STRIDE`` steps."""
        value = self.state.select("node", self.x.alias("value"))
        rows = self.state.select("node", "out", *self.powers, self.x.alias("y0"))
        for k in range(1, steps + 1):
            value = spread(self.links, value, self.alpha)  # used twice: Spark makes the shuffle once
            rows = rows.join(value.withColumnRenamed("value", f"y{k}"), "node", "left").fillna(0.0, [f"y{k}"])
        self.state = checkpoint(rows)
        held = self.state.where("out is null").agg(*[F.coalesce(F.sum(f"y{k}"), F.lit(0.0)) for k in range(1, steps + 1)]).first()
        e = []
        for k in range(steps):
            e.append(self.alpha * self.loose + 1 - self.alpha)
            self.loose = held[k] + sum(x * self.loose_powers[k - i] for i, x in enumerate(e))
        mixed = lambda k: sum((F.lit(e[j]) * F.col(f"b{k - 1 - j}") for j in range(k)), F.col(f"y{k}"))
        self.x, self.old = mixed(steps), mixed(steps - 1)

    def moved(self) -> float:
        """L1 change by the last step."""
        return self.state.agg(F.sum(F.abs(self.x - self.old))).first()[0]


def pagerank(nodes: DataFrame, edges: DataFrame, *, alpha: float = 0.85, max_steps: int = 200, tolerance: float = 1e-6, fixed_steps: int | None = None) -> DataFrame:
    """node, pagerank: uniform teleport, uniform spread of dangling mass, until the L1 change is under ``tolerance`` a node.

    The links are shuffled once, into buckets by source; steps shuffle ranks and contributions only. The change shrinks from step to step,
    so it is looked at once a job, and the last job is done again for the first step under the tolerance.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    ranks, left = Ranks(nodes, edges, n, alpha), fixed_steps or max_steps
    while left:
        steps = min(STRIDE, left)
        start = copy.copy(ranks)
        ranks.go(steps)
        left -= steps
        if not fixed_steps and ranks.moved() < n * tolerance:
            for fewer in range(1, steps):
                again = copy.copy(start)
                again.go(fewer)
                if again.moved() < n * tolerance:
                    ranks = again
                    break
            break
    else:
        if not fixed_steps:
            raise RuntimeError(f"PageRank didn't converge in {max_steps} steps")
    return ranks.state.select("node", ranks.x.alias("pagerank"))


def contracted(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, component: its least node) for every node of ``links`` (a, b), and the number of rounds.

    A round links every node's larger neighbours to its least one (large star), then all smaller ones (small star), until what is left are
    stars around each component's least node. The rounds grow with the logarithm of the longest path; each ends in a checkpoint.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    rounds = 0
    while True:
        # stars: nobody has two parents, and no parent has one
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("x"))
        if not ends.groupBy("x.node").agg(F.sum("x.child").alias("child"), F.max("x.parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpoint(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        rounds += 1
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), rounds


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least name of its weakly connected component."""
    found, _ = contracted(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def degrees(graph: Graph) -> DataFrame:
    """entity_id, in_degree, out_degree, degree of the simple directed graph."""
    ends = graph.edges().select(F.explode(F.array(F.struct(F.col("src").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    sums = ends.groupBy("x.entity_id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    none = F.lit(0).cast("long")
    rows = graph.entities.select("entity_id").join(sums, "entity_id", "left").select("entity_id", F.coalesce("in_degree", none).alias("in_degree"), F.coalesce("out_degree", none).alias("out_degree"))
    return rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def top_by(graph: Graph, values: DataFrame, column: str, limit: int = 10) -> DataFrame:
    rows = graph.entities.select("entity_id", "label", "entity_type").join(values, "entity_id")
    return rows.orderBy(F.desc(column), tx.fold(F.col("label")), "entity_id").limit(limit)


def graph_metrics(graph: Graph) -> DataFrame:
    """One row: entities, relations, components, largest component, isolated entities, density."""
    found = components(nodes_of(graph), graph.edges())
    sizes = found.groupBy("component").count().agg(F.count("*").alias("components"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_component"))
    alone = degrees(graph).agg(F.count("*").alias("entities"), F.count_if(F.col("degree") == 0).alias("isolated_entities"))
    rows = alone.crossJoin(sizes).crossJoin(graph.relations.agg(F.count("*").alias("relations")))
    n = F.col("entities").cast("double")
    return rows.withColumn("density", F.coalesce(F.try_divide(F.col("relations").cast("double"), n * (n - 1)), F.lit(0.0)))


def ball(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, depth (least number of steps from a seed, in either direction, up to ``depth``)."""
    both = symmetric(edges)
    seen = seeds.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        near = both.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = near.join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def neighbours(graph: Graph, entity_id: str, depth: int = 1) -> DataFrame:
    """Entities within ``depth`` steps of one, by label; none for an unknown id or a depth under 1."""
    start = graph.entities.where(F.col("entity_id") == entity_id).select(F.col("entity_id").alias("node"))
    near = ball(graph.edges(), start, max(depth, 0)).where("depth > 0").select(F.col("node").alias("entity_id"), "depth")
    return near.join(graph.entities, "entity_id").orderBy("label", "entity_id")


def labelled(graph: Graph, relations: DataFrame | None = None) -> DataFrame:
    """Relations with the labels and types of both ends."""
    rows = graph.relations if relations is None else relations
    for end in ("subject", "object"):
        names = graph.entities.select(F.col("entity_id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"), F.col("entity_type").alias(f"{end}_type"))
        rows = rows.join(names, f"{end}_id", "left")
    return rows


def five_key() -> list:
    return [tx.fold(F.col("subject_label")), tx.fold(F.col("predicate")), tx.fold(F.col("object_label")), F.col("subject_id"), F.col("object_id")]


def subgraph(graph: Graph, entity_id: str, depth: int = 1, limit: int = 50, offset: int = 0) -> dict[str, object]:
    """The relations inside a ball, by page, with the page's entities and the centre.

    ``depth`` is held within 1 and 2, ``limit`` within 1 and 200. Returns DataFrames ``relations`` and ``nodes`` and the page's figures.
    """
    depth, limit, offset = min(max(depth, 1), 2), min(max(limit, 1), 200), max(offset, 0)
    start = graph.entities.where(F.col("entity_id") == entity_id).select(F.col("entity_id").alias("node"))
    inside = ball(graph.edges(), start, depth).select("node")
    rows = graph.relations.join(inside.withColumnRenamed("node", "subject_id"), "subject_id", "left_semi").join(inside.withColumnRenamed("node", "object_id"), "object_id", "left_semi")
    total = rows.count()
    page = labelled(graph, rows).orderBy(*five_key(), "relation_index").offset(offset).limit(limit)
    ids = page.select(F.col("subject_id").alias("entity_id")).union(page.select("object_id")).union(start).distinct()
    return {"relations": page, "nodes": graph.entities.join(ids, "entity_id", "left_semi"), "total_relations": total, "limit": limit, "offset": offset, "has_more": offset + limit < total}


def path_relations(graph: Graph, entity_id: str, depth: int = 1) -> DataFrame:
    """Relations on undirected paths of at most ``depth`` steps from an entity: those that touch the ball one step smaller."""
    start = graph.entities.where(F.col("entity_id") == entity_id).select(F.col("entity_id").alias("node"))
    inner = ball(graph.edges(), start, min(max(depth, 1), 2) - 1).select("node")
    touching = [graph.relations.join(inner.withColumnRenamed("node", end), end, "left_semi") for end in ("subject_id", "object_id")]
    rows = touching[0].unionByName(touching[1]).dropDuplicates(["relation_index"])
    return labelled(graph, rows).orderBy("predicate", "subject_label", "object_label", "subject_id", "object_id", "relation_index")


def greedy_subgraph(graph: Graph, centres: list[str], *, depth: int = 1, max_nodes: int = 50, types: list[str] | None = None, predicate: str | None = None, batch: int = 5000) -> dict[str, list]:
    """Relations taken in order as long as their ends number at most ``max_nodes``; neighbours fill up if none fits.

    The choice is one after the other by nature. Relations are read in pages of ``batch``, only those that can still fit (once a single
    place is left one end must be taken already, once none is left both), so the driver holds a page, ``max_nodes`` nodes and the result.
    """
    depth, max_nodes = min(max(depth, 1), 3), min(max(max_nodes, 1), 200)
    spark = graph.entities.sparkSession
    start = spark.createDataFrame([(c,) for c in centres], "node string").join(nodes_of(graph), "node", "left_semi")
    near = ball(graph.edges(), start, depth)
    if types:
        allowed = graph.entities.where(F.col("entity_type").isin(types)).select(F.col("entity_id").alias("node"))
        near = near.join(allowed, "node", "left_semi").unionByName(near.where("depth = 0")).distinct()
    inside = near.select("node")
    rows = graph.relations.join(inside.withColumnRenamed("node", "subject_id"), "subject_id", "left_semi").join(inside.withColumnRenamed("node", "object_id"), "object_id", "left_semi")
    rows = rows.where(F.col("predicate") == predicate) if predicate else rows
    found = {r.node for r in start.collect()}
    chosen: list = []
    nodes = set(sorted(found)[:max_nodes])
    key = [*five_key(), F.col("relation_index")]
    ordered = labelled(graph, rows).withColumn("_at", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    page, last = None, None
    while page is None or page:
        room = max_nodes - len(nodes)
        taken = [F.col(c).isin(sorted(nodes)) for c in ("subject_id", "object_id")]
        left = ordered if room > 1 else ordered.where(taken[0] | taken[1] if room else taken[0] & taken[1])
        left = left if last is None else left.where(F.col("_at") > F.struct(*[F.lit(v).cast("long" if isinstance(v, int) else "string").alias(f"k{i}") for i, v in enumerate(last)]))
        page = left.orderBy("_at").limit(batch).collect()
        for r in page:
            last = r["_at"]
            more = nodes | {r.subject_id, r.object_id}
            if len(more) <= max_nodes:
                nodes = more
                chosen.append(r)
            if max_nodes - len(nodes) < min(room, 2):
                break
        else:
            if len(page) < batch:
                break
    if not chosen:
        rest = near.where("depth > 0").join(graph.entities.select(F.col("entity_id").alias("node"), "label"), "node").orderBy(tx.fold(F.col("label")), "node").limit(max(0, max_nodes - len(nodes)))
        nodes |= {r.node for r in rest.collect()}
    return {"nodes": sorted(nodes), "relations": chosen}


def display_ranking(graph: Graph, ranks: DataFrame, focus: list[str], centre: str, nodes: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Relations in the order in which a view with few places shows them; at most max(32, 1.25 * nodes)."""
    touching = lambda ids: F.col("subject_id").isin(ids) | F.col("object_id").isin(ids)
    rows = graph.relations
    for end in ("subject", "object"):
        values = degrees(graph).join(ranks, "entity_id", "left").select(F.col("entity_id").alias(f"{end}_id"), F.col("degree").alias(f"{end}_d"), F.coalesce("pagerank", F.lit(0.0)).alias(f"{end}_p"))
        rows = rows.join(values, f"{end}_id")
    weight = F.lit(0.0)
    for predicate, value in (weights or {}).items():
        weight = F.when(F.col("predicate") == predicate, F.lit(value)).otherwise(weight)
    score = F.when(touching(focus), 30.0).otherwise(0.0) + F.when(touching([centre]), 20.0).otherwise(0.0) + weight + F.sqrt(F.col("subject_d") + F.col("object_d")) + 150 * (F.col("subject_p") + F.col("object_p")) + F.col("confidence")
    first = (touching(focus) | touching([centre])).cast("int")
    return rows.withColumn("display_score", score).orderBy(first.desc(), F.desc("display_score"), "relation_index").limit(max(32, -(-5 * nodes // 4)))
