"""File sources: Markdown folders, graph JSON, ontology, benchmark questions, metric files, settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.model import Graph, ordered_index

ENTITY = "label: string, entity_type: string, description: string, aliases: array<string>, source_chunks: array<string>, embedding: array<double>, metadata: map<string,string>"
RELATION = "subject_id: string, predicate: string, object_id: string, confidence: double, source_chunk: string, metadata: map<string,string>"
GRAPH = f"entities map<string,struct<{ENTITY}>>, relations array<struct<{RELATION}>>, pagerank map<string,double>"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, source_path, text and document_order of every ``*.md`` file below ``folder``, whatever the suffix's case."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        raise FileNotFoundError(folder)
    if files.isFile(path):
        raise NotADirectoryError(folder)
    root = files.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("value").alias("text"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("source_path"))
    rows = rows.where(F.lower("source_path").endswith(".md"))
    relative = F.substring_index(F.col("source_path"), root, -1)
    rows = rows.select(tx.document_id(relative).alias("document_id"), "source_path", "text", tx.fold(relative).alias("_order"))
    return ordered_index(rows, "document_order", "_order", "source_path").drop("_order")


#: How the indented form begins, and where its members end: with a brace four blanks deep. Line ends can't stand inside JSON strings.
INDENTED, MEMBER_END = '{\n  "entities": {', "\n    }"


def split_members(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Entities (entity_id, e), relations (relation_index, r) and ranks (entity_id, pagerank) of a document indented by two blanks, in as
    many tasks as the file has splits; None for another form.

    The text source cuts the file where members end, whatever split that is in; sections are told by the heads that come before their
    first member. Ranks are lines of their own.
    """
    whole = spark.read.option("lineSep", MEMBER_END).text(path)
    head = whole.where("_metadata.file_block_start = 0").limit(1).first()
    if head is None or not head[0].startswith(INDENTED):
        return None
    rows = whole.select("value", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    # a member, after a comma or the section's head; what is left of ends is no member
    part = F.split(F.col("value"), r'(?:^\{|\n  [}\]],|\n  "\w+": (?:\{\}|\[\]),)?\n  "(?:entities|relations|pagerank)": [\[{](?=\n)')
    rows = rows.select("at", F.explode(part).alias("text")).where(~F.col("text").rlike(r"\n  [}\]]\s*\}\s*$"))
    rows = rows.select("at", F.regexp_replace("text", r"^[\s,]+", "").alias("text")).where((F.col("text") != "{") & F.col("text").rlike('^["{]'))
    member = F.from_json(F.concat(F.lit("{"), "text", F.lit("}}")), f"map<string,struct<{ENTITY}>>")
    item = F.from_json(F.concat(F.lit("["), "text", F.lit("}]")), f"array<struct<{RELATION}>>")
    named, listed = (rows.where(F.col("text").startswith(mark)) for mark in '"{')
    if named.where(member.isNull()).limit(1).count() or listed.where(item.isNull()).limit(1).count():
        return None
    entities = named.select(F.explode(member).alias("entity_id", "e"))
    relations = ordered_index(listed.select("at", F.posexplode(item).alias("p", "r")), "relation_index", "at", "p").select("relation_index", "r")
    line = spark.read.text(path).select(F.regexp_extract("value", r'^    ("(?:[^"\\]|\\.)*"): (-?[0-9][0-9.eE+\-]*),?$', 0).alias("l")).where("l <> ''")
    pair = F.from_json(F.concat(F.lit("{"), F.rtrim(F.regexp_replace("l", ",$", "")), F.lit("}")), "map<string,double>")
    return entities, relations, line.select(F.explode(pair).alias("entity_id", "pagerank"))


def read_graph(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """A graph document and its saved ranks (entity_id, pagerank). Self-loops are refused. The form that ``write_json`` writes is read in
    parallel, any other as one document."""
    doc = split_members(spark, path)
    if doc is None:
        one = spark.read.schema(GRAPH).json(path, multiLine=True)
        doc = one.select(F.explode("entities").alias("entity_id", "e")), one.select(F.posexplode("relations").alias("relation_index", "r")), one.select(F.explode("pagerank").alias("entity_id", "pagerank"))
    rows = doc[0].select("entity_id", "e.*")
    empty = F.array().cast("array<string>")
    entities = rows.select(
        "entity_id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("entity_type", F.lit("Other")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("aliases", empty).alias("aliases"), F.coalesce("source_chunks", empty).alias("source_chunks"), "embedding", F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("metadata"),
    )
    relations = doc[1].select(
        F.col("relation_index").cast("long"), "r.subject_id", "r.predicate", "r.object_id", F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), "r.source_chunk", F.coalesce(F.to_json("r.metadata"), F.lit("{}")).alias("metadata")
    )
    if relations.where("subject_id = object_id").limit(1).count():
        raise ValueError("a relation joins an entity with itself")
    return Graph(ordered_index(entities, "ord", "entity_id"), relations), doc[2]


@dataclass(frozen=True)
class Ontology:
    classes: dict[str, str]
    relations: dict[str, tuple[str, str, str]]
    axioms: tuple[str, ...] = ()

    def class_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.classes.items()), "name string, description string")

    def relation_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, *x) for p, x in self.relations.items()], "predicate string, domain string, range string, description string")


def load_ontology(path: str) -> Ontology:
    """Classes, relations and axioms; every domain and range must be a declared class."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    describe = lambda x: x.get("description", "") if isinstance(x, dict) else str(x)
    classes = {k: describe(v) for k, v in doc["classes"].items()}
    relations = {k: (v["domain"], v["range"], v.get("description", "")) for k, v in doc["relations"].items()}
    for name, (domain, range_, _) in relations.items():
        for end in (domain, range_):
            if end not in classes:
                raise ValueError(f"relation {name} refers to the undeclared class {end}")
    return Ontology(classes, relations, tuple(doc.get("axioms", ())))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """id, question, question_type, relevant_entity_labels."""
    schema = "questions array<struct<id: string, question: string, type: string, relevant_entity_labels: array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("questions").alias("pos", "q"))
    if rows.where("q.question is null or q.relevant_entity_labels is null").limit(1).count():
        raise ValueError("a question needs its text and a list of labels")
    return rows.select(
        F.coalesce("q.id", F.format_string("q%03d", F.col("pos") + 1)).alias("id"), "q.question", F.coalesce("q.type", F.lit("unknown")).alias("question_type"), "q.relevant_entity_labels"
    )


def uploaded(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Documents given as ``{"name": ..., "content": ...}``."""
    for d in documents:
        if not isinstance(d, dict) or not str(d.get("content") or "").strip():
            raise ValueError("a document needs a name and content")
    rows = spark.createDataFrame([(i, str(d.get("name") or "document"), str(d["content"])) for i, d in enumerate(documents)], "document_order long, name string, text string")
    name = tx.plain_filename(F.col("name"))
    return rows.select(tx.document_id(name).alias("document_id"), name.alias("source_path"), "text", "document_order")


def read_metrics(folder: str, names: tuple[str, ...] = ("retrieval_metrics", "baseline_metrics", "generation_metrics", "latency_results", "dedup_ablation")) -> dict[str, object]:
    """Saved metric files; absent ones are None."""
    out: dict[str, object] = {}
    for name in names:
        path = os.path.join(folder, f"{name}.json")
        out[name] = json.load(open(path, encoding="utf-8")) if os.path.exists(path) else None
    return out


def load_dotenv(path: str, override: bool = False, environ: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a file of NAME=value lines; names that are set already keep their values unless ``override``."""
    environ = os.environ if environ is None else environ
    found: dict[str, str] = {}
    if not os.path.exists(path):
        return found
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            name, mark, value = line.partition("=")
            if not line or line.startswith("#") or not mark:
                continue
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            found[name.strip()] = value
            if override or name.strip() not in environ:
                environ[name.strip()] = value
    return found
