"""Checks and repairs of a graph against an ontology, inferred relations, quality scores.

The ontology is two small tables: classes(name) and relations(predicate, domain, range), at most a few thousand rows, which are
broadcast. ``Other`` as a domain or range admits every type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .model import Graph, ordered_index

#: A table of more rows than this isn't broadcast.
BROADCAST_ROWS = 10_000
RELAXED = "related_to"


def small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def with_spec(graph: Graph, specs: DataFrame) -> DataFrame:
    """Relations with s_type, o_type, known (predicate), domain, range."""
    kind = lambda end, name: graph.entities.select(F.col("entity_id").alias(end), F.col("entity_type").alias(name))
    spec = small(specs.select("predicate", "domain", "range", F.lit(True).alias("known")))
    return graph.relations.join(spec, "predicate", "left").join(kind("subject_id", "s_type"), "subject_id", "left").join(kind("object_id", "o_type"), "object_id", "left")


def violations(graph: Graph, classes: DataFrame, specs: DataFrame) -> DataFrame:
    """kind, entity_id, relation_index, predicate, subject_id, object_id, expected (array), actual.

    A loop is checked further; an unknown predicate isn't. Missing ends are no domain or range violation.
    """
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    listed = lambda table, column: F.broadcast(table.agg(F.array_sort(F.collect_list(column)).alias("listed")))
    bad = graph.entities.join(small(classes.select(F.col("name").alias("entity_type"))), "entity_type", "left_anti").crossJoin(listed(classes, "name"))
    of_entities = bad.select(F.lit("invalid_entity_type").alias("kind"), "entity_id", F.lit(None).cast("long").alias("relation_index"), none.alias("predicate"), none.alias("subject_id"), none.alias("object_id"), F.col("listed").alias("expected"), F.col("entity_type").alias("actual"))
    known = F.coalesce("known", F.lit(False))
    differs = lambda kind, spec: known & F.col(kind).isNotNull() & (F.col(spec) != "Other") & (F.col(kind) != F.col(spec))
    found = F.array(
        F.when(F.col("subject_id") == F.col("object_id"), F.struct(F.lit(1).alias("rank"), F.lit("self_loop").alias("kind"), nothing.alias("expected"), none.alias("actual"))),
        F.when(~known, F.struct(F.lit(2).alias("rank"), F.lit("invalid_predicate").alias("kind"), F.col("listed").alias("expected"), F.col("predicate").alias("actual"))),
        F.when(differs("s_type", "domain"), F.struct(F.lit(3).alias("rank"), F.lit("domain_violation").alias("kind"), F.array("domain").alias("expected"), F.col("s_type").alias("actual"))),
        F.when(differs("o_type", "range"), F.struct(F.lit(4).alias("rank"), F.lit("range_violation").alias("kind"), F.array("range").alias("expected"), F.col("o_type").alias("actual"))),
    )
    rows = with_spec(graph, specs).crossJoin(listed(specs, "predicate")).select("relation_index", "predicate", "subject_id", "object_id", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v"))
    of_relations = rows.select("v.kind", none.alias("entity_id"), "relation_index", "predicate", "subject_id", "object_id", "v.expected", "v.actual")
    return of_entities.unionByName(of_relations)


def validation(graph: Graph, classes: DataFrame, specs: DataFrame) -> DataFrame:
    """One row: entities, relations, violations by kind and in all, consistency."""
    found = violations(graph, classes, specs)
    kinds = ("invalid_entity_type", "self_loop", "invalid_predicate", "domain_violation", "range_violation")
    rows = found.agg(F.count("*").alias("violations"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    rows = rows.crossJoin(graph.entities.agg(F.count("*").alias("entities"))).crossJoin(graph.relations.agg(F.count("*").alias("relations")))
    checks = F.greatest(F.col("entities") + 4 * F.col("relations"), F.lit(1))
    return rows.withColumn("consistency", F.greatest(F.lit(0.0), 1 - F.col("violations") / checks))


def auto_repair(graph: Graph, classes: DataFrame) -> Graph:
    """Unknown types become Other and loops go; predicates, domains and ranges stay."""
    known = small(classes.select(F.col("name").alias("_known")))
    entities = graph.entities.join(known, F.col("entity_type") == F.col("_known"), "left").withColumn("entity_type", F.coalesce("_known", F.lit("Other"))).drop("_known")
    return Graph(entities.select(*graph.entities.columns), graph.relations.where("subject_id <> object_id"))


def fits(kind: str, spec: str) -> Column:
    return (F.col(spec) == "Other") | (F.col(kind) == F.col(spec))


def with_action(graph: Graph, specs: DataFrame) -> DataFrame:
    """Relations with what their repair is to be."""
    rows = with_spec(graph, specs)
    missing = F.col("s_type").isNull() | F.col("o_type").isNull()
    action = (
        F.when(missing, F.raise_error(F.lit("a relation refers to an unknown entity")).cast("string"))
        .when(F.col("subject_id") == F.col("object_id"), "removed_self_loops")
        .when(F.col("known").isNull(), "invalid_predicate_relaxed")
        .when(fits("s_type", "domain") & fits("o_type", "range"), "kept")
        .when(fits("o_type", "domain") & fits("s_type", "range"), "reversed")
        .otherwise("domain_range_relaxed")
    )
    return rows.withColumn("action", action)


def repaired_relations(graph: Graph, specs: DataFrame) -> DataFrame:
    """Relations after their repair, before equal ones are merged: kept, turned round, or relaxed to ``related_to`` at 0.45 at most."""
    rows = with_action(graph, specs).where("action <> 'removed_self_loops'")
    turned, relaxed = F.col("action") == "reversed", F.col("action").endswith("relaxed")
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    more = F.when(turned, F.create_map(F.lit("repair_action"), F.lit("reversed"), F.lit("repair_original_subject_id"), F.col("subject_id"), F.lit("repair_original_object_id"), F.col("object_id")))
    more = more.when(relaxed, F.create_map(F.lit("repair_action"), F.col("action"), F.lit("repair_original_predicate"), F.col("predicate"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(
        "relation_index", F.when(turned, F.col("object_id")).otherwise(F.col("subject_id")).alias("subject_id"), F.when(relaxed, F.lit(RELAXED)).otherwise(F.col("predicate")).alias("predicate"),
        F.when(turned, F.col("subject_id")).otherwise(F.col("object_id")).alias("object_id"), F.when(relaxed, F.least("confidence", F.lit(0.45))).otherwise(F.col("confidence")).alias("confidence"),
        "source_chunk", F.to_json(F.map_concat(meta, more)).alias("metadata"),
    )


def best_of_equal(relations: DataFrame) -> DataFrame:
    """Of relations of equal ends, predicate and chunk the most confident, at the place of the first."""
    key = ("subject_id", "predicate", "object_id", "source_chunk")
    best = Window.partitionBy(*key).orderBy(F.desc("confidence"), "relation_index")
    rows = relations.withColumns({"_n": F.row_number().over(best), "_at": F.min("relation_index").over(Window.partitionBy(*key))}).where("_n = 1")
    return rows.withColumn("relation_index", F.col("_at")).select(*relations.columns)


def inferred_types(graph: Graph, specs: DataFrame, *, votes: int = 2, share: float = 0.67) -> DataFrame:
    """entity_id, entity_type, votes of entities of type Other whose relations agree on a type: at least ``votes`` and ``share`` of all."""
    rows = with_spec(graph, specs).where((F.col("predicate") != RELAXED) & F.col("known"))
    cast = F.array(F.struct(F.col("subject_id").alias("entity_id"), F.col("s_type").alias("old"), F.col("domain").alias("vote"), F.lit(0).alias("side")), F.struct(F.col("object_id").alias("entity_id"), F.col("o_type").alias("old"), F.col("range").alias("vote"), F.lit(1).alias("side")))
    ballots = rows.select("relation_index", F.explode(cast).alias("b")).where("b.old = 'Other' and b.vote <> 'Other'")
    counts = ballots.groupBy("b.entity_id", "b.vote").agg(F.count("*").alias("votes"), F.min(F.struct("relation_index", "b.side")).alias("first"))
    best = counts.groupBy("entity_id").agg(F.sum("votes").alias("all"), F.min(F.struct((-F.col("votes")).alias("v"), "first", "vote")).alias("top"))
    rows = best.select("entity_id", F.col("top.vote").alias("entity_type"), (-F.col("top.v")).alias("votes"), "all")
    return rows.where((F.col("votes") >= votes) & (F.col("votes") / F.col("all") >= share)).select("entity_id", "entity_type", "votes")


def repair(graph: Graph, specs: DataFrame, *, infer_types: bool = False, deduplicate: bool = True) -> tuple[Graph, DataFrame]:
    """(the repaired graph, relations by action)."""
    if infer_types:
        new = inferred_types(graph, specs).select("entity_id", F.col("entity_type").alias("_new"))
        entities = graph.entities.join(new, "entity_id", "left").withColumn("entity_type", F.coalesce("_new", "entity_type")).select(*graph.entities.columns)
        graph = Graph(entities, graph.relations)
    actions = with_action(graph, specs).groupBy("action").agg(F.count("*").alias("relations"))
    rows = repaired_relations(graph, specs)
    rows = (best_of_equal(rows) if deduplicate else rows).withColumnRenamed("relation_index", "_old")
    return Graph(graph.entities, ordered_index(rows, "relation_index", "_old").drop("_old").select(*graph.relations.columns)), actions


def shared_targets(graph: Graph, predicate: str = "treats", subject: str = "Drug", target: str = "Condition") -> DataFrame:
    """Distinct (target, member) with the target's first place among the relations."""
    kind = lambda end, want: graph.entities.where(F.col("entity_type") == want).select(F.col("entity_id").alias(end))
    rows = graph.relations.where(F.col("predicate") == predicate).join(kind("subject_id", subject), "subject_id", "left_semi").join(kind("object_id", target), "object_id", "left_semi")
    return rows.groupBy(F.col("object_id").alias("target"), F.col("subject_id").alias("member")).agg(F.min("relation_index").alias("at"))


def inferred_relations(graph: Graph, *, predicate: str = "treats", subject: str = "Drug", target: str = "Condition", confidence: float = 0.7) -> DataFrame:
    """One ``related_to`` for each pair of subjects that share a target, credited to the first target by label; none where one exists."""
    names = graph.entities.select(F.col("entity_id"), tx.fold(F.col("label")).alias("name"))
    rows = shared_targets(graph, predicate, subject, target).join(names.withColumnRenamed("entity_id", "member"), "member")
    firsts = rows.groupBy("target").agg(F.min("at").alias("first_at"))
    rows = rows.join(firsts, "target").select("target", "first_at", "member", "name")
    left, right = (rows.select("target", "first_at", F.col("member").alias(e), F.col("name").alias(f"{e}_name")) for e in ("subject_id", "object_id"))
    pairs = left.join(right.drop("first_at"), "target").where(F.struct("subject_id_name", "subject_id") < F.struct("object_id_name", "object_id"))
    pairs = pairs.join(names.select(F.col("entity_id").alias("target"), F.col("name").alias("target_name")), "target")
    best = pairs.groupBy("subject_id", "object_id").agg(F.min(F.struct("target_name", "first_at", "target", "subject_id_name", "object_id_name")).alias("b"))
    old = graph.relations.where(F.col("predicate") == RELAXED).select("subject_id", "object_id")
    known = old.union(old.select("object_id", "subject_id")).distinct()
    best = best.join(known, ["subject_id", "object_id"], "left_anti")
    meta = F.to_json(F.create_map(F.lit("inferred_by"), F.lit("shared_condition_rule"), F.lit("condition_id"), F.col("b.target")))
    order = F.struct("b.target_name", "b.first_at", "b.subject_id_name", "subject_id", "b.object_id_name", "object_id")
    return best.select("subject_id", F.lit(RELAXED).alias("predicate"), "object_id", F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("source_chunk"), meta.alias("metadata"), order.alias("_order"), F.col("b.target").alias("via"))


def quality(graph: Graph, classes: DataFrame, specs: DataFrame, *, default_precision: float = 1.0, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """One row: coverage, consistency, precision, redundancy, quality."""
    real = classes.where("name <> 'Other'")
    used = graph.entities.select(F.col("entity_type").alias("name")).distinct().join(small(real.select("name")), "name", "left_semi")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rows = real.agg(F.count("*").alias("classes")).crossJoin(used.agg(F.count("*").alias("used")))
    rows = rows.crossJoin(graph.relations.agg(F.avg("confidence").alias("mean"))).crossJoin(graph.entities.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases")))
    rows = rows.crossJoin(validation(graph, classes, specs).select("consistency"))
    w = weights
    rows = rows.select(
        share(F.col("used"), F.col("classes")).alias("coverage"), "consistency", F.least(F.greatest(F.coalesce("mean", F.lit(default_precision)), F.lit(0.0)), F.lit(1.0)).alias("precision"), share(F.col("aliases"), F.col("n") + F.col("aliases")).alias("redundancy")
    )
    return rows.withColumn("quality", w[0] * F.col("coverage") + w[1] * F.col("consistency") + w[2] * F.col("precision") - w[3] * F.col("redundancy"))


def refine(graph: Graph, classes: DataFrame, specs: DataFrame, *, rounds: int = 5, gain: float = 0.0005, **rule: str) -> Graph:
    """Repair and inference in turn until the quality gains less than ``gain``."""
    from .build import add_relations

    best = quality(graph, classes, specs).first()["quality"]
    for _ in range(rounds):
        graph, _ = repair(auto_repair(graph, classes), specs)
        graph = add_relations(graph, inferred_relations(graph, **rule).drop("via"))
        value = quality(graph, classes, specs).first()["quality"]
        if value - best < gain:
            break
        best = value
    return graph
