"""Sinks and graph stores: Parquet tables, interchange JSON, rows for a property-graph store, reports."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable
from typing import IO, Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graphs, retrieve
from ..operators.model import Graph, ordered_index
from ..session import checkpoint


def write_tables(graph: Graph, folder: str, ranks: DataFrame | None = None) -> None:
    """The native form: one Parquet table each."""
    graph.entities.write.mode("overwrite").parquet(f"{folder}/entities")
    graph.relations.write.mode("overwrite").parquet(f"{folder}/relations")
    if ranks is not None:
        ranks.write.mode("overwrite").parquet(f"{folder}/pagerank")


def read_tables(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/entities"), spark.read.parquet(f"{folder}/relations"))


def write_json(graph: Graph, path: str, ranks: DataFrame | None = None) -> None:
    """One JSON document (entities by id, relations in order, ranks by id), streamed row by row through the driver."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def members(rows: Iterable[Row], key: str) -> Iterable[str]:
        for r in rows:
            value = r.asDict()
            name = value.pop(key)
            if "metadata" in value:
                value["metadata"] = json.loads(value["metadata"])
            yield f"    {json.dumps(name, ensure_ascii=False)}: {indented(value.get('pagerank', value))}"

    entities = graph.entities.drop("ord").orderBy("entity_id").toLocalIterator()
    relations = graph.relations.orderBy("relation_index").drop("relation_index").toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "entities": ')
        listed(f, "{}", members(entities, "entity_id"))
        f.write(',\n  "relations": ')
        listed(f, "[]", ("    " + indented(r.asDict() | {"metadata": json.loads(r.metadata)}) for r in relations))
        f.write(',\n  "pagerank": ')
        listed(f, "{}", members(ranks.orderBy("entity_id").toLocalIterator(), "entity_id") if ranks is not None else ())
        f.write("\n}")


def indented(value: object) -> str:
    """JSON with two spaces a level, for a place two levels down."""
    return json.dumps(value, ensure_ascii=False, indent=2).replace("\n", "\n    ")


def listed(file: IO[str], ends: str, items: Iterable[str]) -> None:
    """The items between the two ``ends``, one after the other as they come."""
    mark = ends[0] + "\n"
    for item in items:
        file.write(mark + item)
        mark = ",\n"
    file.write(ends if mark[0] == ends[0] else "\n  " + ends[1])


def json_text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def relation_digest(subject: str, predicate: str, object_: str, chunk: str | None, metadata: str) -> str:
    parts = {"subject_id": subject, "predicate": predicate, "object_id": object_, "source_chunk": chunk, "metadata": json.loads(metadata)}
    return hashlib.md5(json_text(parts).encode()).hexdigest()


def relation_key(*columns: str) -> Column:
    """MD5 of the relation without its confidence; in Arrow batches because the digest is over JSON as Python writes it."""

    def digests(*values: pd.Series) -> pd.Series:
        return pd.Series([relation_digest(*row) for row in zip(*values, strict=True)], dtype=object)

    return F.pandas_udf(digests, "string")(*columns)


def store_rows(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows for a property-graph store: no loops, the last of the edges of equal ends, type, predicate and key."""
    rows = graph.relations.where("subject_id <> object_id").withColumn("relation_type", tx.relationship_type(F.col("predicate")))
    rows = rows.withColumn("relation_key", relation_key("subject_id", "predicate", "object_id", "source_chunk", "metadata"))
    key = ["subject_id", "relation_type", "object_id", "predicate", "relation_key"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct("confidence", "source_chunk", "metadata"), "relation_index").alias("r"))
    return graph.entities.drop("ord"), last.select(*key, "r.*")


def upsert(graph: Graph, connect: Callable[[], object], batch: int = 1000, clear: bool = False) -> None:
    """Send the rows in batches; ``connect()`` gives an object with ``prepare(clear)``, ``nodes(list)``, ``edges(list)`` and ``close()``.

    The driver prepares the store (unique ids; emptied if ``clear``), then every task opens its own. Rows are merged by key, so that
    a task done again changes nothing; the edges are sent after all the nodes.
    """
    target = connect()
    target.prepare(clear)
    target.close()

    def sender(method: str) -> Callable[[Iterable[Row]], None]:
        def send(rows: Iterable[Row]) -> None:
            target, held = connect(), []
            for row in rows:
                held.append(row.asDict())
                if len(held) == batch:
                    getattr(target, method)(held)
                    held = []
            if held:
                getattr(target, method)(held)
            target.close()

        return send

    nodes, edges = store_rows(graph)
    nodes.foreachPartition(sender("nodes"))
    edges.foreachPartition(sender("edges"))


def from_store(nodes: DataFrame, edges: DataFrame) -> Graph:
    """A graph of a store's rows: loops left out, a missing or empty type is Other and predicate related_to, a missing or zero confidence is one, bad metadata is empty."""
    none = F.array().cast("array<string>")
    meta = F.when(F.try_parse_json("metadata_json").isNotNull(), F.col("metadata_json")).otherwise("{}")
    entities = nodes.select(F.col("id").alias("entity_id"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("Other")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("source_chunks", none).alias("source_chunks"), "embedding", meta.alias("metadata"))
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    predicate = F.coalesce(F.nullif("predicate", F.lit("")), F.lit("related_to")).alias("predicate")
    relations = edges.where("subject_id <> object_id").select("subject_id", predicate, "object_id", confidence.alias("confidence"), "source_chunk", meta.alias("metadata"))
    return Graph(ordered_index(entities, "ord", "entity_id"), ordered_index(relations, "relation_index", "subject_id", "predicate", "object_id", "source_chunk", "confidence"))


class CypherTarget:
    """The target of ``upsert`` in a property-graph database that speaks Cypher; ``session``: an object with ``run(text, **values)`` and ``close()``."""

    def __init__(self, session: object) -> None:
        self.session = session

    @staticmethod
    def connect(uri: str, user: str, password: str, database: str | None = None) -> CypherTarget:
        from neo4j import GraphDatabase  # needed on the executors only where this target is used

        return CypherTarget(GraphDatabase.driver(uri, auth=(user, password)).session(database=database))

    def prepare(self, clear: bool = False) -> None:
        self.session.run("CREATE CONSTRAINT entity_id IF NOT EXISTS FOR (e:Entity) REQUIRE e.id IS UNIQUE")
        if clear:
            self.session.run("MATCH (e:Entity) DETACH DELETE e")

    def nodes(self, rows: list[dict]) -> None:
        values = [{("id" if k == "entity_id" else "metadata_json" if k == "metadata" else k): v for k, v in r.items()} for r in rows]
        self.session.run("UNWIND $rows AS row MERGE (e:Entity {id: row.id}) SET e += row", rows=values)

    def edges(self, rows: list[dict]) -> None:
        """A statement for each relationship type, because a type can't be a parameter; types hold letters, digits and _ only."""
        types: dict[str, list[dict]] = {}
        for r in rows:
            types.setdefault(r["relation_type"], []).append(r)
        for name, part in types.items():
            self.session.run(
                "UNWIND $rows AS row MATCH (s:Entity {id: row.subject_id}) MATCH (o:Entity {id: row.object_id}) "
                f"MERGE (s)-[r:`{name}` {{predicate: row.predicate, relation_key: row.relation_key}}]->(o) "
                "SET r.confidence = row.confidence, r.source_chunk = row.source_chunk, r.metadata_json = row.metadata",
                rows=part,
            )

    def close(self) -> None:
        self.session.close()


class Store(Protocol):
    def read_graph(self) -> Graph: ...
    def write_graph(self, graph: Graph, clear: bool = False) -> None: ...
    def stats(self) -> dict[str, int]: ...
    def search_entities(self, query: str, limit: int = 20) -> list[Row]: ...
    def get_subgraph(self, entity_id: str, depth: int = 1, limit: int = 50, offset: int = 0) -> dict[str, object]: ...


def merged(old: Graph, new: Graph) -> Graph:
    """``new`` over ``old``: entities by id, relations by ends, predicate and key."""
    entities = old.entities.join(new.entities, "entity_id", "left_anti").withColumn("_new", F.lit(0)).unionByName(new.entities.withColumn("_new", F.lit(1)))
    keyed = lambda g, n: g.relations.withColumns({"_new": F.lit(n), "_key": relation_key("subject_id", "predicate", "object_id", "source_chunk", "metadata")})
    relations = keyed(old, 0).join(keyed(new, 1).select("_key").distinct(), "_key", "left_anti").unionByName(keyed(new, 1))
    names = [c for c in new.relations.columns if c != "relation_index"]
    return Graph(
        ordered_index(entities.withColumnRenamed("ord", "_old"), "ord", "_new", "_old").select(*new.entities.columns),
        ordered_index(relations.withColumnRenamed("relation_index", "_old"), "relation_index", "_new", "_old").select("relation_index", *names).select(*new.relations.columns),
    )


class TableStore:
    """A store over Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read_graph(self) -> Graph:
        return read_tables(self.spark, self.folder)

    def write_graph(self, graph: Graph, clear: bool = False) -> None:
        """Entities and relations by key: the graph's replace the store's of equal key, the others stay unless ``clear``."""
        if not clear and os.path.exists(f"{self.folder}/entities"):
            graph = merged(self.read_graph(), graph)
        write_tables(Graph(checkpoint(graph.entities), checkpoint(graph.relations)), self.folder)

    def stats(self) -> dict[str, int]:
        graph = self.read_graph()
        return {"entities": graph.entities.count(), "relations": graph.relations.count()}

    def search_entities(self, query: str, limit: int = 20) -> list[Row]:
        return retrieve.search(self.read_graph(), query, limit=limit)[0].collect()

    def get_subgraph(self, entity_id: str, depth: int = 1, limit: int = 50, offset: int = 0) -> dict[str, object]:
        found = graphs.subgraph(self.read_graph(), entity_id, depth, limit, offset)
        return found | {"relations": found["relations"].collect(), "nodes": found["nodes"].collect()}


def read_cache(spark: SparkSession, folder: str | None, name: str) -> DataFrame:
    """key, payload of the answers kept under a folder; none where there is no table yet."""
    empty = spark.createDataFrame([], "key string, payload string")
    if folder is None:
        return empty
    try:
        return spark.read.schema(empty.schema).parquet(f"{folder}/{name}").groupBy("key").agg(F.min("payload").alias("payload"))
    except AnalysisException:
        return empty


def append_cache(fresh: DataFrame, folder: str | None, name: str) -> None:
    """Keep those new answers that are JSON objects, whatever their shape."""
    if folder is not None:
        fresh.where(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{")).select("key", "payload").write.mode("append").parquet(f"{folder}/{name}")


def save_json(payload: object, path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)
    return path


def fixed_width(rows: list[dict]) -> str:
    """A table for a console."""
    if not rows:
        return ""
    cells = [list(rows[0]), *[[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)
