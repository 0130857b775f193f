"""The test tables as a graph: regions, nations, suppliers, parts, with planted defects for checks and repairs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.build import mention, merge_entities
from ..operators.model import Graph, ordered_index
from ..session import checkpoint

CLASSES = ("Region", "Nation", "Supplier", "Part", "Other")
SPECS = (("located_in", "Nation", "Region"), ("based_in", "Supplier", "Nation"), ("supplies", "Supplier", "Part"), ("related_to", "Other", "Other"))
CENTRE = "Supplier#000000000"
PREFERRED = ("supplies", "based_in", "located_in", "related_to")
QUESTIONS = ("small widget 7", "supplier nation_3", "promo plate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CLASSES], "name string")


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, "") for s in SPECS], "predicate string, domain string, range string, description string")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query long, question string")


def part_label() -> Column:
    return F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda rank, column: F.struct(F.lit(rank).alias("rank"), F.col(column).cast("long").alias("key"))
    region = table(spark, sf_dir, "region").select(*mention(F.col("r_name"), key(0, "r_regionkey"), kind=F.lit("Region")))
    nation = table(spark, sf_dir, "nation").select(*mention(F.col("n_name"), key(1, "n_nationkey"), kind=F.lit("Nation")))
    supplier = table(spark, sf_dir, "supplier").select(*mention(F.col("s_name"), key(2, "s_suppkey"), kind=F.lit("Supplier")))
    kind = F.when(F.col("p_partkey") % 97 == 0, "Gadget").when(F.col("p_partkey") % 89 == 0, "Other").otherwise("Part")
    part = table(spark, sf_dir, "part").select(*mention(part_label(), key(3, "p_partkey"), kind=kind, description=F.col("p_type"), aliases=F.array("p_brand")))
    return region.unionByName(nation).unionByName(supplier).unionByName(part)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    edge = lambda s, p, o, confidence, chunk, order: [tx.entity_id(s).alias("subject_id"), p.alias("predicate"), tx.entity_id(o).alias("object_id"), confidence.alias("confidence"), chunk.alias("source_chunk"), F.lit("{}").alias("metadata"), order.alias("_order")]
    place = lambda kind, *keys: F.struct(F.lit(kind).alias("kind"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    fill = lambda key: (F.col(key).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), zero, zero)
    located = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(*edge(F.col("n_name"), F.lit("located_in"), F.col("r_name"), F.lit(1.0), none, place(0, *fill("n_nationkey"))))
    based = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(*edge(F.col("s_name"), F.lit("based_in"), F.col("n_name"), F.lit(1.0), none, place(1, *fill("s_suppkey"))))
    items = read("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49))
    items = ordered_index(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"), "n", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = items.join(read("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(read("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    swap, ships, loop = F.col("n") % 11 == 3, F.col("n") % 13 == 5, F.col("n") % 17 == 7
    label = part_label()
    subject = F.when(swap, label).otherwise(F.col("s_name"))
    object_ = F.when(swap, F.col("s_name")).when(~ships & loop, F.col("s_name")).otherwise(label)
    predicate = F.when(~swap & ships, "ships").otherwise("supplies")
    chunk = F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit("::chunk-"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"))
    order = place(2, F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"))
    supplied = rows.select(*edge(subject, predicate, object_, F.round(1 - F.col("l_discount"), 2), chunk, order))
    return ordered_index(located.unionByName(based).unionByName(supplied), "relation_index", "_order").drop("_order")


@lru_cache(maxsize=4)
def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, made once for each session and folder and kept in the shared folder."""
    return Graph(checkpoint(merge_entities(mentions(spark, sf_dir))), checkpoint(relations(spark, sf_dir)))
