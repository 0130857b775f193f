"""The graph's tables and a dense order index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


@dataclass(frozen=True)
class Graph:
    """entities(entity_id, ord, label, entity_type, description, aliases, source_chunks, embedding, metadata);
    relations(relation_index, subject_id, predicate, object_id, confidence, source_chunk, metadata)."""

    entities: DataFrame
    relations: DataFrame

    def edges(self) -> DataFrame:
        """The simple directed graph: parallel relations are one edge."""
        return self.relations.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).distinct()


def ordered_index(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with a dense index from nought in ``order``, without gathering the rows in one task.

    The sorted rows are fixed by a checkpoint; only the numbers of rows of its partitions come to the driver.
    """
    rows = checkpoint(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = dict(rows.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    first, total = [], 0
    for p in sorted(sizes):
        first.append((p, total - (p << 33)))
        total += sizes[p]
    if not first:
        return rows.withColumn(name, F.col("_at")).drop("_at")
    starts = F.broadcast(rows.sparkSession.createDataFrame(first, "_p long, _first long"))
    return rows.withColumn("_p", F.shiftright("_at", 33)).join(starts, "_p").withColumn(name, F.col("_at") + F.col("_first")).drop("_at", "_p", "_first")


