"""The queries of this package: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    listed = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), "contaminated"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    found = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    found = lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


#: A deployment passes its own secret to ``pii.pseudonymise``.
DEMONSTRATION_KEY = "demonstration key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_KEY)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted_lines", "n_deleted_words", "text")


#: (host, path, verdict)
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    found = urls.judge(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return found.select("page_id", "host", "path", "rule", "verdict", "weight", F.array_join("terms", ",").alias("terms"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 50 == 0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.mine(table(spark, sf_dir, "documents"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express."""
    return op5_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express."""
    return op6_quality(spark, sf_dir).drop("kept", "llr")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html, op2_chat, op3_decontaminate, op4_warc, op5_lm, op6_quality, op7_neardup, op8_packing, op9_pii, op10_linededup, op11_urls, op12_negatives, op13_phrases, lm_base, quality_base)}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.oracle()
