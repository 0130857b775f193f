"""Evaluation aggregates and the dashboard's figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..session import checkpoint
from .model import Graph
from .retrieve import grouped_by_length, half_up, question_blocks


def hit_labels(graph: Graph, hits: DataFrame) -> DataFrame:
    """query, rank, label: every normal form of a hit's label and aliases."""
    names = graph.entities.select(F.col("entity_id").alias("doc"), F.explode(F.concat(F.array("label"), "aliases")).alias("name"))
    return hits.join(names, "doc").select("query", "rank", tx.normalize_eval_label(F.col("name")).alias("label")).where("label <> ''").distinct()


def retrieval_metrics(found: DataFrame, expected: DataFrame, *, cut: int = 10, hits_at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query, hit_at_k..., reciprocal_rank, average_precision of found (query, rank, label) against expected (query, label).

    A rank counts once, if it shows an expected label that no smaller rank shows; precision is over at most ``cut`` ranks.
    """
    want = expected.select("query", "label").distinct()
    sizes = want.groupBy("query").agg(F.count("*").alias("n"))
    first = found.join(want, ["query", "label"]).groupBy("query", "label").agg(F.min("rank").alias("rank"))
    ranks = first.select("query", "rank").distinct()
    ranks = ranks.withColumn("hit", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    ordered = F.sort_array(F.collect_list(F.when(F.col("rank") <= cut, F.struct("rank", (F.col("hit") / F.col("rank")).alias("p")))))
    rows = ranks.groupBy("query").agg(F.min("rank").alias("best"), F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x["p"]).alias("total"))
    rows = sizes.join(rows, "query", "left")
    at = [F.coalesce(F.col("best") <= k, F.lit(False)).cast("double").alias(f"hit_at_{k}") for k in hits_at]
    return rows.select("query", *at, F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("total") / F.least("n", F.lit(cut)), F.lit(0.0)).alias("average_precision"))


def metric_means(metrics: DataFrame, *by: str) -> DataFrame:
    names = {"hit_at_5": "hit_at_5", "hit_at_10": "hit_at_10", "reciprocal_rank": "mrr", "average_precision": "map_at_10"}
    return metrics.groupBy(*by).agg(F.count("*").alias("questions"), *[F.bround(F.avg(c), 4).alias(n) for c, n in names.items()])


#: Systems that are compared, and the mode that each of them is.
BASELINES = {"naive_rag": "lexical_only", "rank_fusion": "hybrid_rrf", "proposed": "lexical_structural"}


def baselines(means: DataFrame) -> DataFrame:
    """``means`` by mode under the names of the systems."""
    systems = means.sparkSession.createDataFrame(list(BASELINES.items()), "system string, mode string")
    return means.join(F.broadcast(systems), "mode")


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def faithfulness(answer: Column, context: Column, *, share: float = 0.35) -> Column:
    """Share of an answer's claims of whose words at least ``share`` lie in the context; 1 for an answer that says it isn't supported."""
    known = tx.content_tokens(context)
    claims = F.filter(F.transform(F.split(answer, r"[.!?;\n]+"), tx.content_tokens), lambda c: F.size(c) > 0)
    good = F.filter(claims, lambda c: shared(c, known) / F.size(c) >= share)
    refuses = tx.fold(answer).rlike("not supported|не поддерж")
    return F.when(refuses, 1.0).otherwise(F.coalesce(F.try_divide(F.size(good).cast("double"), F.size(claims).cast("double")), F.lit(0.0)))


def relevance(question: Column, answer: Column) -> Column:
    """F1 of the word sets."""
    a, b = tx.content_tokens(question), tx.content_tokens(answer)
    both = shared(a, b).cast("double")
    return F.coalesce(F.try_divide(2 * both, (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


def context_scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """query, context_precision (hits with an expected label), context_recall (expected labels that occur)."""
    want = expected.select("query", "label").distinct()
    ranks = found.groupBy("query").agg(F.countDistinct("rank").alias("hits"))
    match = found.join(want, ["query", "label"]).groupBy("query").agg(F.countDistinct("rank").alias("good"), F.countDistinct("label").alias("covered"))
    sizes = want.groupBy("query").agg(F.count("*").alias("n"))
    rows = ranks.join(sizes, "query", "full").join(match, "query", "left")
    ratio = lambda a, b, empty: F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)).cast("double"), b.cast("double")), F.lit(empty))
    return rows.select("query", ratio(F.col("good"), F.col("hits"), 0.0).alias("context_precision"), ratio(F.col("covered"), F.col("n"), 1.0).alias("context_recall"))


def latency(timings: DataFrame) -> DataFrame:
    """stage, runs, mean, std (of the sample; nought for one run), min, max of timings (stage, seconds)."""
    s = F.col("seconds")
    return timings.groupBy("stage").agg(F.count("*").alias("runs"), F.avg(s).alias("mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """True and false positives and negatives of pairs (predicted, actual[, pairs: how many a row stands for]), precision, recall, F1."""
    p, a = F.col("predicted"), F.col("actual")
    number = (lambda test: F.coalesce(F.sum(F.when(test, F.col("pairs"))), F.lit(0))) if "pairs" in pairs.columns else F.count_if
    rows = pairs.groupBy(*by).agg(number(p & a).alias("tp"), number(p & ~a).alias("fp"), number(~p & a).alias("fn"), number(~p & ~a).alias("tn"))
    ratio = lambda x, y, empty: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(empty))
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)})
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def ablation(pairs: DataFrame, alphas: list[float], thresholds: list[float]) -> DataFrame:
    """Confusion at every (alpha, theta) of pairs (lexical, semantic, left_type, right_type, actual); similarities are computed once."""
    from ..functions.similarity import hybrid_similarity

    spark = pairs.sparkSession
    grid = F.broadcast(spark.createDataFrame([(a, t) for a in alphas for t in thresholds], "alpha double, theta double"))
    value = hybrid_similarity(F.col("lexical"), F.col("semantic"), F.col("left_type"), F.col("right_type"), 0.0)
    compatible = (F.col("left_type") == F.col("right_type")) | (F.col("left_type") == "Other") | (F.col("right_type") == "Other")
    value = F.when(compatible, F.col("alpha") * F.col("semantic") + (1 - F.col("alpha")) * F.col("lexical")).otherwise(value)
    rows = pairs.crossJoin(grid).withColumn("predicted", value >= F.col("theta"))
    return confusion(rows, "alpha", "theta").orderBy(F.desc("f1"), F.desc("precision"), "alpha", "theta")


def scored_pairs(vectors: DataFrame, asked: DataFrame, bounds: list[float], *, digits: int = 9) -> DataFrame:
    """semantic, actual, pairs: how many pairs of a row of ``asked`` with another row of ``vectors`` (both: id, label, embedding) have a
    semantic similarity, rounded to ``digits`` places, from ``semantic`` up to the next of ``bounds``; actual: their labels are equal.

    ``bounds`` (and nought) are the values at which a prediction can change. A task compares its vectors with a block of the asked ones by
    a product of matrices and counts; what lies near a bound is summed again in the components' order. Pairs without a similarity (vectors
    that are missing, unequally long or nought) count at nought, pairs of a null id or label not at all.
    """
    cuts = np.unique(np.round(np.array([0.0, *(x for x in bounds if 0 < x <= 1)]) * 10**digits).astype(np.int64))
    whole = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    known = "id is not null and label is not null"
    rows = vectors.where(known).select(F.col("id").cast("long").alias("id"), "label", whole.alias("embedding"))
    mine = asked.where(known).select(F.col("id").cast("long").alias("query"), F.col("id").cast("long").alias("id"), "label", whole.alias("embedding"))
    out = None
    for block in question_blocks(mine):
        ids, labels = block.column("id").to_numpy(), block.column("label").combine_chunks()
        groups = [(d, at, m, norms(m)) for d, at, m in grouped_by_length(block.column("embedding").combine_chunks())]

        def run(batches: Iterator[pa.RecordBatch], ids=ids, labels=labels, groups=groups) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((2, len(cuts)), np.int64)
            names = {x: i for i, x in enumerate(labels.unique().to_pylist())}
            own = np.array([names[x] for x in labels.to_pylist()])
            for whole_batch in batches:
                for start in range(0, whole_batch.num_rows, 512):
                    b = whole_batch.slice(start, 512)
                    equal = own[:, None] == np.array([names.get(x, -1) for x in b.column(1).to_pylist()])[None, :]
                    other = ids[:, None] != b.column(0).to_numpy()[None, :]
                    place = np.zeros(equal.shape, np.int64)
                    for d, at, m in grouped_by_length(b.column(2)):
                        for e, asked_at, a, a_norms in groups:
                            if d == e:
                                place[np.ix_(asked_at, at)] = intervals(a, m, a_norms, norms(m), cuts, digits)
                    for k, test in enumerate((other & ~equal, other & equal)):
                        counts[k] += np.bincount(place[test], minlength=len(cuts))
            k, c = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cuts[c] / 10.0**digits), pa.array(k == 1), pa.array(counts[k, c])], names=["semantic", "actual", "pairs"])

        found = rows.mapInArrow(run, "semantic double, actual boolean, pairs long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select(F.lit(0.0).alias("semantic"), F.lit(True).alias("actual"), F.lit(0).cast("long").alias("pairs")).limit(0)
    return out.groupBy("semantic", "actual").agg(F.sum("pairs").alias("pairs"))


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((c * c for c in m.T), np.zeros(len(m))))


def intervals(a: np.ndarray, b: np.ndarray, a_norms: np.ndarray, b_norms: np.ndarray, cuts: np.ndarray, digits: int) -> np.ndarray:
    """Places in ``cuts`` (whole numbers of the last digit, from nought) of the similarities of the rows of ``a`` and ``b``."""
    with np.errstate(all="ignore"):
        below = a_norms[:, None] * b_norms[None, :]
        value = (a @ b.T) / below * 10.0**digits
        place = np.maximum(np.searchsorted(cuts, value, side="right") - 1, 0)
        near = ~np.isfinite(value) | (below < 1e-200) | (np.abs(value - cuts[place]) < 2) | (np.append(cuts[1:], np.iinfo(np.int64).max)[place] - value < 2)
        rows, columns = np.nonzero(near)
        for s in range(0, len(rows), 50_000):
            p, q = rows[s : s + 50_000], columns[s : s + 50_000]
            total = np.zeros(len(p))
            for k in range(a.shape[1]):
                total += a[p, k] * b[q, k]
            exact = total / below[p, q]
            # Spark's least and SQL's count NaN as the largest; there is no similarity to a vector of length nought
            exact = np.where(below[p, q] == 0, 0.0, np.where(np.isnan(exact), 1.0, np.clip(exact, 0.0, 1.0)))
            whole = np.round(half_up(exact, digits) * 10.0**digits).astype(np.int64)
            place[p, q] = np.searchsorted(cuts, whole, side="right") - 1
    return place


def label_lookup(graph: Graph, labels: DataFrame) -> DataFrame:
    """label, entity_id of the first entity whose label or alias is equal in normal form."""
    names = graph.entities.select("entity_id", "ord", F.explode(F.concat(F.array("label"), "aliases")).alias("name")).select("entity_id", "ord", tx.normalize_label(F.col("name")).alias("key"))
    rows = labels.withColumn("key", tx.normalize_label(F.col("label"))).join(names, "key")
    return rows.groupBy("label").agg(F.min_by("entity_id", "ord").alias("entity_id"))


#: Words of a passage that are looked for together, and characters where a passage has no whole word.
WINDOW_WORDS, WINDOW_CHARS = 5, 8


def fingerprints(items: Column, width: Column) -> Column:
    """Hashes of all stretches of ``width`` items of an array."""
    n = F.size(items) - width + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.array_join(F.slice(items, i + 1, width), " "))))).otherwise(F.array().cast("array<bigint>"))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """query, doc of the documents (doc, text) whose text holds the passage (query, passage) as it stands.

    The words inside a passage, its first and last ones left out (they may be parts of longer words), are whole words of any text that holds
    it. So texts meet passages by the hash of as many of these words as there are, up to ``WINDOW_WORDS``, and then are compared. Passages
    without such a word meet by their first characters.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    chars = lambda c: F.filter(F.split(c, ""), lambda w: w != "")
    inner = F.when(F.size(words(F.col("passage"))) > 2, F.slice(words(F.col("passage")), 2, F.size(words(F.col("passage"))) - 2)).otherwise(F.array().cast("array<string>"))
    asked = passages.where("passage is not null").select("query", "passage", inner.alias("inner"))
    by_words = F.size("inner") > 0
    width = F.when(by_words, F.least(F.size("inner"), F.lit(WINDOW_WORDS))).otherwise(F.least(F.length("passage"), F.lit(WINDOW_CHARS)))
    first = F.when(by_words, F.slice("inner", 1, width)).otherwise(F.slice(chars(F.col("passage")), 1, width))
    asked = checkpoint(asked.select("query", "passage", by_words.alias("words"), width.alias("width"), F.xxhash64(F.array_join(first, " ")).alias("mark")))
    kinds = [(r.words, r.width) for r in asked.select("words", "width").distinct().orderBy("words", "width").collect()]  # at most 14
    none = docs.select("doc", "text", F.lit(True).alias("words"), F.lit(0).alias("width"), F.lit(0).cast("long").alias("mark")).limit(0)
    for whole, n in kinds:
        items = words(F.col("text")) if whole else chars(F.col("text"))
        marks = F.explode(fingerprints(F.col("items"), F.lit(n))) if n else F.xxhash64(F.lit(""))
        parted = docs.where("text is not null").select("doc", "text", items.alias("items"))  # a column, so that no window parts the text again
        none = none.unionByName(parted.select("doc", "text", F.lit(whole).alias("words"), F.lit(n).alias("width"), marks.alias("mark")))
    small = F.broadcast(asked) if asked.limit(10_001).count() <= 10_000 else asked
    return none.join(small, ["words", "width", "mark"]).where(F.contains("text", F.col("passage"))).select("query", "doc").distinct()


def type_counts(graph: Graph) -> DataFrame:
    return graph.entities.groupBy("entity_type").agg(F.count("*").alias("entities"))


def predicate_counts(graph: Graph, limit: int = 10) -> DataFrame:
    """The most frequent predicates; of equal ones the first seen."""
    rows = graph.relations.groupBy("predicate").agg(F.count("*").alias("relations"), F.min("relation_index").alias("first"))
    return rows.orderBy(F.desc("relations"), "first").limit(limit).select("predicate", "relations")


def chunk_counts(graph: Graph) -> DataFrame:
    """One row: distinct source chunks of entities and relations, aliases."""
    chunks = graph.entities.select(F.explode("source_chunks").alias("chunk")).union(graph.relations.where("source_chunk is not null").select("source_chunk"))
    return chunks.agg(F.countDistinct("chunk").alias("source_chunks")).crossJoin(graph.entities.agg(F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases")))


def report(sections: dict[str, list[dict]]) -> str:
    """Markdown tables; numbers with four places."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    out = ["# Evaluation"]
    for title, rows in sections.items():
        out += ["", f"## {title}", ""]
        if rows:
            out += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0])]
            out += ["| " + " | ".join(map(show, r.values())) + " |" for r in rows]
    return "\n".join(out) + "\n"
