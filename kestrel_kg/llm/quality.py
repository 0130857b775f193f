"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Every document's words and adjacent word pairs are hashed to ``2 ** bits`` buckets. Two multinomials over the buckets are
estimated: one from all documents, one from trusted documents (labelled of good quality and not toxic). A document's score is the
mean over its n-grams of ``log(p_trusted / p_raw)``; it is kept if the score reaches the threshold, which is a plain comparison.

Bounds: the corpus counts cover all documents. The classifier's labelled rows are limited to ``max_labelled`` documents, those of
least hash, so that they can be broadcast; the two count vectors have ``2 ** bits`` entries whatever the input.

Cases: null and empty texts have no words, so zeros and ``base_failed``. Null ids are kept as they are; repeated rows are scored
each. Without labels of both kinds the method gives no verdict against any document (threshold minus infinity). Extra columns pass
through ``score``; those named like its results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WordHash, code_points, lean, texts, with_columns

SYMBOLS = b"#*$%&|<>"
PAIR = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class QualityModel:
    ratio: np.ndarray
    threshold: float
    bits: int


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the words and of the adjacent word pairs."""
    shift = np.uint64(64 - bits)
    one = (hashes * PAIR) >> shift
    two = ((hashes[:-1] * PAIR + hashes[1:]) * STEP) >> shift
    return np.concatenate([one, two]).astype(np.int64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    key = (hashes[:-2] * PAIR + hashes[1:-1]) * STEP + hashes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids with ``trusted`` true or false, those of least hash."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("quality = 0 or toxic = 0")
        .select("doc_id", (F.col("quality") == 1).alias("trusted"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )


def fit(docs: DataFrame, labels: DataFrame, *, bits: int = 16, max_labelled: int = 20_000, smoothing: float = 1.0, min_words: int = 50) -> QualityModel:
    """Count all documents once, then choose the threshold that best parts the labelled documents of ``min_words`` words or more."""
    size = 1 << bits
    sample = labelled_sample(labels, max_labelled).cache()
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, raw, trusted = WordHash(), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for text, good in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(buckets(words.array(text.split()), bits), minlength=size)
                raw += counts
                if good:
                    trusted += counts
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(trusted[some])], names=["bucket", "raw", "trusted"])

    rows = marked.select("text", "trusted").mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    raw, trusted = np.full(size, smoothing), np.full(size, smoothing)
    for b, r, t in rows:
        raw[b] += r
        trusted[b] += t
    ratio = (np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())).astype(np.float32)
    found = QualityModel(ratio, float("-inf"), bits)
    known = score(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), found, keep=["trusted"], min_words=min_words)
    known = [(s, t) for s, t, n in known.select("llr", "trusted", "n_words").collect() if n >= min_words]
    sample.unpersist()
    return QualityModel(ratio, best_threshold(known), bits)


def best_threshold(known: list[tuple[float, bool]]) -> float:
    """The cut of largest (share of trusted kept - share of others kept), in the middle of its gap; the lowest of equal ones."""
    known = sorted(known)
    good = sum(t for _, t in known)
    bad = len(known) - good
    if not good or not bad:
        return float("-inf")
    best, at, lost_good, lost_bad = 0.0, float("-inf"), 0, 0
    for (s, t), (after, _) in zip(known, known[1:] + [(float("inf"), True)], strict=True):
        lost_good, lost_bad = lost_good + t, lost_bad + (not t)
        gain = lost_bad / bad - lost_good / good
        if after > s and gain > best and after != float("inf"):
            best, at = gain, (s + after) / 2
    return at


def score(docs: DataFrame, model: QualityModel, *, keep: list[str] | None = None, min_words: int = 50) -> DataFrame:
    """The ``keep`` columns (all: None) of each document with its counts, its score ``llr``, ``base_failed`` and ``kept``."""
    ratio, threshold, bits = model.ratio, model.threshold, model.bits
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        words, ratio = WordHash(), shared.value
        for batch in batches:
            rows = []
            for text in texts(batch):
                found = text.split()
                hashes = words.array(found)
                n = len(found)
                llr = float(ratio[buckets(hashes, bits)].mean(dtype=np.float64)) if n else 0.0
                repeated = repeated_words(hashes)
                failed = n < min_words or 100 * repeated > 50 * n
                spaces = len(text) - len(text.translate(None, SPACE))
                rows.append((n, code_points(text) - spaces, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), repeated, llr, failed, not failed and llr >= threshold))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            yield {n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*rows, strict=True) if rows else [[]] * 8, strict=True)}

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"
    return with_columns(docs, run, added, keep, ["text"])
