"""Graph construction: extraction payloads to mentions, mentions to entities, labelled relations to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .model import Graph, ordered_index

PAYLOAD = (
    "entities array<struct<label: string, type: string, description: string, aliases: array<string>>>, "
    "relations array<struct<subject: string, predicate: string, object: string, confidence: string>>, _corrupt string"
)
MENTION = ("order_key", "label", "entity_type", "description", "aliases", "source_chunks", "embedding", "metadata")


def mention(label: Column, order_key: Column, *, kind: Column | None = None, description: Column | None = None, aliases: Column | None = None, chunk: Column | None = None) -> list[Column]:
    """The columns of a mention; ``order_key`` decides which of several mentions comes first."""
    none = F.array().cast("array<string>")
    chunks = F.when(chunk.isNotNull(), F.array(chunk)).otherwise(none) if chunk is not None else none
    return [
        order_key.alias("order_key"), label.alias("label"), F.coalesce(kind, F.lit("Other")).alias("entity_type") if kind is not None else F.lit("Other").alias("entity_type"),
        F.coalesce(description, F.lit("")).alias("description") if description is not None else F.lit("").alias("description"), F.coalesce(aliases, none).alias("aliases") if aliases is not None else none.alias("aliases"),
        chunks.alias("source_chunks"), F.lit(None).cast("array<double>").alias("embedding"), F.lit("{}").alias("metadata"),
    ]


def in_order(value: Column, order: Column) -> Column:
    """The arrays of a group, in order, without repetitions."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"])))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """One entity for each normalised label: first label, first type but Other, first description, all aliases and chunks in order."""
    rows = mentions.select(tx.entity_id(F.col("label")).alias("entity_id"), *MENTION)
    order = F.col("order_key")
    first = lambda c, test=None: F.min_by(c, order) if test is None else F.min_by(F.when(test, F.col(c)), F.when(test, order))
    merged = rows.groupBy("entity_id").agg(
        F.min("order_key").alias("_order"), first("label").alias("label"), F.coalesce(first("entity_type", F.col("entity_type") != "Other"), F.lit("Other")).alias("entity_type"),
        F.coalesce(first("description", F.col("description") != ""), F.lit("")).alias("description"), in_order(F.col("aliases"), order).alias("aliases"), in_order(F.col("source_chunks"), order).alias("source_chunks"),
        first("embedding", F.col("embedding").isNotNull()).alias("embedding"), F.to_json(F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("metadata").alias("m")))), lambda r: F.coalesce(F.from_json(r["m"], "map<string,string>"), F.create_map().cast("map<string,string>"))), F.create_map().cast("map<string,string>"), lambda a, b: F.map_concat(a, b))).alias("metadata"),
    )
    return ordered_index(merged, "ord", "_order", "entity_id").drop("_order")


def parse_extractions(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, rejected) of rows chunk_order, chunk_id, payload.

    A payload must be a JSON object with lists of entities (each with a label) and relations (each with subject, predicate, object and,
    if given, a numeric confidence); one bad item rejects the payload, which then stands in ``rejected`` with a reason.
    """
    read = payloads.withColumn("p", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), "malformed JSON")
        .when(F.col("p.entities").isNull() | F.col("p.relations").isNull(), "entities and relations must be lists")
        .when(F.exists("p.entities", lambda e: blank(e["label"])), "an entity without label")
        .when(F.exists("p.relations", lambda r: blank(r["subject"]) | blank(r["predicate"]) | blank(r["object"])), "a relation without subject, predicate or object")
        .when(F.exists("p.relations", lambda r: r["confidence"].isNotNull() & r["confidence"].try_cast("double").isNull()), "a confidence that is no number")
    )
    read = read.withColumn("reason", reason)
    good = read.where("reason is null")
    entities = good.select("chunk_order", "chunk_id", F.posexplode("p.entities").alias("pos", "e")).select(
        "chunk_order", "chunk_id", F.col("pos").cast("long"), F.trim("e.label").alias("label"), F.coalesce("e.type", F.lit("Other")).alias("entity_type"), F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"),
    )
    relations = good.select("chunk_order", "chunk_id", F.posexplode("p.relations").alias("pos", "r")).select(
        "chunk_order", "chunk_id", F.col("pos").cast("long"), F.trim("r.subject").alias("subject"), F.trim("r.predicate").alias("predicate"), F.trim("r.object").alias("object"), F.coalesce(F.col("r.confidence").cast("double"), F.lit(1.0)).alias("confidence")
    )
    return entities, relations, read.where("reason is not null").select("chunk_order", "chunk_id", "payload", "reason")


def order_of(kind: int, end: int) -> Column:
    """Inside a chunk all entities come before all relations, a subject before its object."""
    return F.struct(F.col("chunk_order").cast("long"), F.lit(kind).alias("kind"), F.col("pos").cast("long"), F.lit(end).alias("end"))


def build_graph(entities: DataFrame, relations: DataFrame, *, strict: bool = True) -> Graph:
    """A graph of extracted entities and labelled relations (columns as from ``parse_extractions``).

    Endpoints that no entity names become entities of type Other. ``strict``: a relation between equal labels is an error; else it is
    left out, though its endpoint stays an entity.
    """
    found = entities.select(*mention(F.col("label"), order_of(0, 0), kind=F.col("entity_type"), description=F.col("description"), aliases=F.col("aliases"), chunk=F.col("chunk_id")))
    for end, column in enumerate(("subject", "object")):
        found = found.unionByName(relations.select(*mention(F.col(column), order_of(1, end), chunk=F.col("chunk_id"))))
    rows = relations.select(
        tx.entity_id(F.col("subject")).alias("subject_id"), "predicate", tx.entity_id(F.col("object")).alias("object_id"), "confidence", F.col("chunk_id").alias("source_chunk"), F.lit("{}").alias("metadata"), order_of(1, 0).alias("_order")
    )
    loops = F.col("subject_id") == F.col("object_id")
    if strict and rows.where(loops).limit(1).count():
        raise ValueError("a relation joins an entity with itself")
    return Graph(merge_entities(found), ordered_index(rows.where(~loops), "relation_index", "_order").drop("_order"))


def add_relations(graph: Graph, new: DataFrame) -> Graph:
    """Append relations (same columns without relation_index, and ``_order``); both ends must be entities."""
    ends = new.select(F.col("subject_id").alias("entity_id")).union(new.select("object_id"))
    if ends.join(graph.entities, "entity_id", "left_anti").limit(1).count():
        raise KeyError("a relation refers to an unknown entity")
    start = graph.relations.agg(F.coalesce(F.max("relation_index") + 1, F.lit(0))).first()[0]
    rows = ordered_index(new, "relation_index", "_order").drop("_order").withColumn("relation_index", F.col("relation_index") + start)
    return Graph(graph.entities, graph.relations.unionByName(rows))


def with_cache(requests: DataFrame, cache: DataFrame, key: Column, answer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests with ``payload`` and ``cache_hit``, the enlarged cache, new cache rows).

    ``cache``: key, payload. Requests of equal key are answered once: ``answer`` gets the missing keys' rows and returns key, payload.
    """
    keyed = requests.withColumn("key", key)
    missing = keyed.join(cache, "key", "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("_n = 1").drop("_n")
    fresh = answer(missing).select("key", "payload")
    known = cache.select("key", "payload", F.lit(True).alias("cache_hit")).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    return keyed.join(known, "key", "left"), cache.select("key", "payload").unionByName(fresh), fresh


def chunk_key(text: Column) -> Column:
    """Extraction answers are kept by the chunk's text alone."""
    return F.md5(text)


def typing_key(label: Column) -> Column:
    return F.md5(tx.normalize_label(label))


def apply_types(graph: Graph, typed: DataFrame, classes: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with the types of ``typed`` (entity_id, payload, cache_hit), classes unknown to the ontology as Other; counts by class."""
    answer = F.from_json("payload", "`class` string, confidence double, rationale string")
    rows = typed.select("entity_id", "cache_hit", answer.alias("a")).join(F.broadcast(classes.select(F.col("name").alias("_name"))), F.col("a.class") == F.col("_name"), "left")
    rows = rows.select("entity_id", F.coalesce("_name", F.lit("Other")).alias("_type"), F.col("a.confidence").alias("confidence"), "cache_hit")
    stats = rows.groupBy(F.col("_type").alias("assigned_class")).agg(F.count("*").alias("typed"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"))
    entities = graph.entities.join(rows.select("entity_id", "_type"), "entity_id", "left").withColumn("entity_type", F.coalesce("_type", "entity_type")).drop("_type")
    return Graph(entities, graph.relations), stats


def extraction_prompt(text: str, classes: list[str], predicates: list[str]) -> str:
    return "\n".join(
        ["Extract the entities and relations that the text states.", f"Entity types: {', '.join(sorted(classes))}.", f"Predicates: {', '.join(sorted(predicates))}.", 'Return JSON {"entities": [{"label", "type", "description", "aliases"}], "relations": [{"subject", "predicate", "object", "confidence"}]}.', "Text:", text]
    )


def typing_prompt(label: str, description: str, aliases: list[str], classes: dict[str, str]) -> str:
    listed = "\n".join(f"- {name}: {about}" for name, about in sorted(classes.items()))
    return f'Choose the class of the entity.\nClasses:\n{listed}\nEntity: {label}\nDescription: {description}\nAliases: {", ".join(aliases)}\nReturn JSON {{"class", "confidence", "rationale"}}.'
