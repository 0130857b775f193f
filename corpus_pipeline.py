"""Corpus pipeline: stages over the table ``documents``, each written as Parquet and read again by the next.

Cases: null and empty texts have no words, so the quality rules reject them; an empty table gives no rows in any stage. Rows with equal
ids count as one document in the near-dedup, and stay or go together; rows without an id are never copies of others. Of equally good
copies the one with the smallest id stays, of equal lines the first by id and place. Extra columns pass through all stages but the last;
those named like an operator's results keep their own values. ``n_chars`` is made anew where a text is cut. The stages set the session's
size of Arrow batches (``common.BATCH_BYTES``), if it has none of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel_kg.llm import decontaminate, linededup, neardup, packing, quality
from kestrel_kg.llm.common import bound_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    bound_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs; documents that consist of such copies alone go."""
    bound_batches(spark)
    found = linededup.dedup_lines(docs).where("n_lines = 0 or n_deleted_lines < n_lines")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    bound_batches(spark)
    copies = neardup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents, and cut the hit spans of 13 words or more out of the others."""
    bound_batches(spark)
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    cut = decontaminate.remove(decontaminate.remove(found, action="documents"), action="spans")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in token sequences."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: The fitted thresholds, prefix doubling, near-duplicate components and packing have no SQL form here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
