"""Overlapping word windows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def chunk(documents: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """document_id, chunk_id, chunk_index, text, source_path, start_word, end_word of documents (document_id, text[, source_path]).

    A window starts every ``size - overlap`` words; the first one to reach the end is the last. Texts without words give none.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    path = F.col("source_path") if "source_path" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("document_id", path.alias("source_path"), tx.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / F.lit(step)), F.lit(0)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("i"), (i * step).alias("a"), F.least(i * step + size, F.size("w")).alias("b"), F.array_join(F.slice("w", i * step + 1, F.lit(size)), " ").alias("t")),
    )
    rows = rows.select("document_id", "source_path", F.explode(windows).alias("x"))
    return rows.select(
        "document_id", F.format_string("%s::chunk-%04d", "document_id", F.col("x.i")).alias("chunk_id"), F.col("x.i").alias("chunk_index"), F.col("x.t").alias("text"), "source_path", F.col("x.a").alias("start_word"), F.col("x.b").alias("end_word")
    )
