"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node of ``links``, by alternating large-star and small-star steps.

    Each step replaces links by links to the least neighbour, until what is left is a star around each component's least node; links
    that are stars from the start need no step. All tables of a step are written to the shared folder: small ones are then read in few
    tasks and joined without a shuffle, however many partitions a shuffle has.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    while True:
        edges = written(edges, "edges")
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e")).select("e.*")
        lower = F.col("other") < F.col("node")
        nodes = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("component"), F.sum(lower.cast("long")).alias("lower"), F.max(~lower).alias("higher"))
        nodes = written(nodes, "nodes")
        if not nodes.where("lower > 1 or lower = 1 and higher").limit(1).count():
            return nodes.select("node", "component")
        large = written(edges.join(nodes.select(F.col("node").alias("v"), "component"), "v").select("u", F.col("component").alias("v")), "large-stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        edges = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
