"""A property-graph store as a Spark data source: reads by ranges of keys, writes in batches that are merged by key.

    spark.dataSource.register(PropertyGraph)
    nodes = spark.read.format("property_graph").options(kind="nodes", partitions=64, uri=..., user=..., password=...).load()

The option ``session`` names a function (``package.module:function``) that makes of the options an object with ``run(text, **values)``,
which gives rows by name, and ``close()``; ``bolt`` is the default. Driver and tasks each open their own.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.model import Graph
from .stores import CypherTarget, from_store, store_rows

KINDS = {
    "nodes": "id string, label string, entity_type string, description string, aliases array<string>, source_chunks array<string>, embedding array<double>, metadata_json string, pagerank double",
    "edges": "subject_id string, predicate string, object_id string, confidence double, source_chunk string, metadata_json string",
}
COLUMNS = {kind: [c.split()[0] for c in ddl.split(", ")] for kind, ddl in KINDS.items()}
INSIDE = "({0}.id >= $low OR $low IS NULL) AND ({0}.id < $high OR $high IS NULL)"
SIZE = "MATCH (n:Entity) RETURN count(n) AS size"
#: The id that so many others come before.
BOUND = "MATCH (n:Entity) WITH n.id AS id ORDER BY id SKIP $place LIMIT 1 RETURN id"
READ = {
    "nodes": f"MATCH (n:Entity) WHERE {INSIDE.format('n')} RETURN " + ", ".join(f"n.{c} AS {c}" for c in COLUMNS["nodes"]),
    "edges": f"MATCH (a:Entity)-[e]->(b:Entity) WHERE {INSIDE.format('a')} RETURN a.id AS subject_id, b.id AS object_id, " + ", ".join(f"e.{c} AS {c}" for c in COLUMNS["edges"] if not c.endswith("_id")),
}


def bolt(options: dict[str, str]) -> object:
    """A session of the vendor's driver, where that is installed."""
    from neo4j import GraphDatabase

    return GraphDatabase.driver(options["uri"], auth=(options.get("user", ""), options.get("password", ""))).session(database=options.get("database"))


def opened(options: dict[str, str]) -> object:
    module, _, name = options.get("session", f"{__name__}:bolt").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def kind_of(options: dict[str, str]) -> str:
    kind = options.get("kind", "nodes")
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind}")
    return kind


@dataclass
class KeyRange(InputPartition):
    """Ids from low up to, and without, high; None: open."""

    low: str | None
    high: str | None


@dataclass
class Written(WriterCommitMessage):
    rows: int


class PropertyGraph(DataSource):
    """Nodes or edges (option ``kind``) of a store; see the module."""

    @classmethod
    def name(cls) -> str:
        return "property_graph"

    def schema(self) -> str:
        return KINDS[kind_of(self.options)]

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(dict(self.options), overwrite)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.kind = options, kind_of(options)

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of about equally many nodes, at most ``partitions`` (8) of them; edges go by where they start."""
        session = opened(self.options)
        size = next(iter(session.run(SIZE)))["size"]
        parts = max(1, min(int(self.options.get("partitions", 8)), size))
        bounds = [next(iter(session.run(BOUND, place=size * k // parts)))["id"] for k in range(1, parts)]
        session.close()
        bounds = sorted(set(bounds))
        return [KeyRange(low, high) for low, high in zip([None, *bounds], [*bounds, None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        session = opened(self.options)
        for row in session.run(READ[self.kind], low=partition.low, high=partition.high):
            yield tuple(converted(c, row[c]) for c in COLUMNS[self.kind])
        session.close()


def converted(name: str, value: object) -> object:
    """Numbers as doubles: stores keep whole ones as integers."""
    if name == "embedding":
        return None if value is None else [float(x) for x in value]
    return float(value) if name in ("confidence", "pagerank") and value is not None else value


class BatchWriter(DataSourceWriter):
    """Rows of ``store_rows`` in batches of ``batch`` (1000). They are merged by key, so a task done again changes nothing, and what a failed
    job has written is written again by the next. ``overwrite`` empties the store first (with nodes only: edges need their ends)."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.kind, self.overwrite = options, kind_of(options), overwrite
        target = CypherTarget(opened(options))
        target.prepare(overwrite and self.kind == "nodes")
        target.close()

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        target, held, n = CypherTarget(opened(self.options)), [], 0
        for row in iterator:
            held.append(row.asDict())
            n += 1
            if len(held) == int(self.options.get("batch", 1000)):
                getattr(target, self.kind)(held)
                held = []
        if held:
            getattr(target, self.kind)(held)
        target.close()
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        if any(m is None for m in messages):
            raise RuntimeError("a task's rows were not confirmed")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to undo: the rows are merged again when the job is run again."""


def read_store(spark: SparkSession, **options: str) -> tuple[Graph, DataFrame]:
    """The store's graph, and the ranks that its nodes hold (entity_id, pagerank)."""
    spark.dataSource.register(PropertyGraph)
    nodes, edges = (spark.read.format("property_graph").options(kind=kind, **options).load() for kind in KINDS)
    return from_store(nodes, edges), nodes.where("pagerank is not null").select(F.col("id").alias("entity_id"), "pagerank")


def write_store(graph: Graph, *, ranks: DataFrame | None = None, clear: bool = False, **options: str) -> None:
    """The graph merged into the store, or in place of what it holds; all nodes before the first edge."""
    spark = graph.entities.sparkSession
    spark.dataSource.register(PropertyGraph)
    nodes, edges = store_rows(graph)
    if ranks is not None:
        nodes = nodes.join(ranks, "entity_id", "left")
    mode = "overwrite" if clear else "append"
    nodes.write.format("property_graph").options(kind="nodes", **options).mode(mode).save()
    edges.write.format("property_graph").options(kind="edges", **options).mode("append").save()
