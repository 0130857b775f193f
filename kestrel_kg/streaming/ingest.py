"""Streaming ingestion: documents become chunks and index terms, extraction payloads a graph, in files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators.build import build_graph, parse_extractions
from ..operators.chunking import chunk
from ..operators.model import Graph


def chunk_stream(documents: DataFrame, folder: str, *, size: int = 800, overlap: int = 100, checkpoint: str) -> StreamingQuery:
    """Chunks of a stream (document_id, text) as Parquet; the file sink and the checkpoint give each chunk once."""
    rows = chunk(documents, size, overlap)
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_stream(documents: DataFrame, folder: str, *, checkpoint: str) -> StreamingQuery:
    """Term counts of each micro-batch's documents, appended under the batch's number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("document_id", F.explode(tx.search_tokens(F.col("text"))).alias("token")).groupBy("document_id", "token").agg(F.count("*").alias("tf"))
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The tables of a growing graph; a batch's rows lie under its number.
PARTS = ("entities", "relations", "rejected")


def graph_stream(payloads: DataFrame, folder: str, *, checkpoint: str) -> StreamingQuery:
    """Mentions, relations and rejected payloads of a stream (chunk_order, chunk_id, payload). A repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["chunk_id"]).persist()
        for name, part in zip(PARTS, parse_extractions(rows), strict=True):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        rows.unpersist()

    return payloads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_graph(spark: SparkSession, folder: str, *, strict: bool = False) -> Graph:
    """The graph of all batches so far, the same as of one batch with all their chunks, in whatever order they came.

    A chunk that came in several batches counts as the first of them brought it, so a sender may send again.
    """
    entities, relations, _ = (spark.read.parquet(f"{folder}/{name}") for name in PARTS)
    once = entities.select("chunk_id", "batch").union(relations.select("chunk_id", "batch")).groupBy("chunk_id").agg(F.min("batch").alias("batch"))
    kept = lambda rows: rows.join(once, ["chunk_id", "batch"], "left_semi").drop("batch")
    return build_graph(kept(entities), kept(relations), strict=strict)


def event_latency(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs and mean seconds by stage and window of a stream (stage, ts, seconds); rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "stage")
    return rows.agg(F.count("*").alias("runs"), F.avg("seconds").alias("mean")).select(F.col("window.start").alias("start"), "stage", "runs", "mean")
