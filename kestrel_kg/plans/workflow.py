"""From a folder of Markdown to a checked graph with ranks; answers; the full evaluation."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clients
from ..functions import text as tx
from ..operators import build, chunking, context, evaluate, graphs, ontology, resolve, retrieve
from ..operators.model import Graph
from ..session import checkpoint
from ..sources import files, stores


@dataclass
class Built:
    graph: Graph
    ranks: DataFrame
    summary: dict[str, object] = field(default_factory=dict)


#: The trial question of a build's summary.
DEMO_QUESTION = "Which drug treats Ph+ acute lymphoblastic leukemia?"


def checked(graph: Graph, classes: DataFrame, specs: DataFrame) -> dict[str, object]:
    return ontology.validation(graph, classes, specs).first().asDict()


def summary_path(path: str) -> str:
    return os.path.join(os.path.dirname(path), "run_summary.json")


def repair_report(before: Graph, after: Graph, actions: DataFrame, classes: DataFrame, specs: DataFrame, types: DataFrame | None = None, most: int = 100) -> dict[str, object]:
    """What a repair did: violations, relations and predicates before and after, actions, the types that it inferred (``most`` of them by id)."""

    def told(graph: Graph) -> dict[str, object]:
        row = checked(graph, classes, specs)
        kinds = ("invalid_entity_type", "self_loop", "invalid_predicate", "domain_violation", "range_violation")
        return {"consistency_score": row["consistency"], "violation_count": row["violations"], "counts": {"entities": row["entities"], "relations": row["relations"]}, "violation_types": {k: row[k] for k in sorted(kinds) if row[k]}}

    spread = lambda graph: {r["predicate"]: r["n"] for r in graph.relations.groupBy("predicate").agg(F.count("*").alias("n")).orderBy("predicate").collect()}
    done = {r["action"]: r["relations"] for r in actions.collect()}
    n_types = types.count() if types is not None else 0
    left, right = spread(before), spread(after)
    counts = {"removed_self_loops": 0, "deduplicated_relations": sum(left.values()) - done.get("removed_self_loops", 0) - sum(right.values()), "inferred_entity_types": n_types} | done
    return {
        "validation_before": told(before), "validation_after": told(after), "relation_count_before": sum(left.values()), "relation_count_after": sum(right.values()), "entity_count": after.entities.count(),
        "actions": dict(sorted(counts.items())), "inferred_types": [r.asDict() for r in types.orderBy("entity_id").limit(most).collect()] if types is not None else [], "inferred_type_count": n_types,
        "predicate_distribution_before": left, "predicate_distribution_after": right,
    }


def cut(graph: Graph) -> Graph:
    return Graph(checkpoint(graph.entities), checkpoint(graph.relations))


def build_graph(
    spark: SparkSession, folder: str, onto: files.Ontology, make: Callable[[], clients.TextModel], *, size: int = 800, overlap: int = 100, alpha: float = 0.6, threshold: float = 0.85, cache: str | None = None, rule: dict[str, str] | None = None,
    question: str = DEMO_QUESTION, path: str = "",
) -> Built:
    """Scan, chunk, extract (each distinct text once), type, resolve, check, repair, infer, rank.

    ``cache``: folder in which the model's answers stay, so that a later run asks only for texts and labels that are new. ``path``: where
    the caller saves the graph, for the summary; ``question``: retrieved at the end as a trial.
    """
    classes, specs = onto.class_table(spark), onto.relation_table(spark)
    documents = files.read_markdown(spark, folder)
    chunks = chunking.chunk(documents, size, overlap).join(documents.select("document_id", "document_order"), "document_id")
    chunks = checkpoint(chunks.withColumn("chunk_order", F.col("document_order") * (1 << 20) + F.col("chunk_index")))
    prompts = stores.read_cache(spark, cache, "extraction")
    head, _, tail = build.extraction_prompt("\0", list(onto.classes), list(onto.relations)).partition("\0")
    asked = lambda missing: checkpoint(clients.complete_all(missing.select("key", F.concat(F.lit(head), "text", F.lit(tail)).alias("prompt")), make, "extraction"))
    answered, _, fresh = build.with_cache(chunks.select("chunk_order", "chunk_id", "text"), prompts, build.chunk_key(F.col("text")), asked)
    answered = checkpoint(answered.select("chunk_order", "chunk_id", "payload"))
    stores.append_cache(fresh, cache, "extraction")
    entities, relations, rejected = build.parse_extractions(answered)
    bad = rejected.first()
    if bad is not None:
        raise ValueError(f"chunk {bad.chunk_id}: {bad.reason}")
    graph = cut(build.build_graph(entities, relations))
    raw = graph.entities.count(), graph.relations.count()
    head, _, tail = build.typing_prompt("\0", "\1", ["\2"], onto.classes).partition("\0")
    middle, _, rest = tail.partition("\1")
    inner, _, end = rest.partition("\2")
    prompt = F.concat(F.lit(head), "label", F.lit(middle), "description", F.lit(inner), F.array_join("aliases", ", "), F.lit(end))
    typed = lambda missing: checkpoint(clients.complete_all(missing.select("key", prompt.alias("prompt")), make, "typing"))
    known = stores.read_cache(spark, cache, "typing")
    answered, _, fresh = build.with_cache(graph.entities.select("entity_id", "label", "description", "aliases"), known, build.typing_key(F.col("label")), typed)
    answered = checkpoint(answered.select("entity_id", "payload", "cache_hit"))
    stores.append_cache(fresh, cache, "typing")
    graph, typing = build.apply_types(graph, answered, classes)
    typing_rows = [r.asDict() for r in typing.orderBy("assigned_class").collect()]
    found = resolve.resolve(cut(graph), alpha=alpha, threshold=threshold)
    merged = cut(found.graph)
    broken = checked(merged, classes, specs)
    graph = cut(ontology.auto_repair(merged, classes))
    mended = checked(graph, classes, specs)
    new = ontology.inferred_relations(graph, **(rule or {})).drop("via")
    added = new.count()
    graph = cut(build.add_relations(graph, new)) if added else graph
    ranks = checkpoint(graphs.pagerank(graphs.nodes_of(graph), graph.edges()).withColumnRenamed("node", "entity_id"))
    trial = checkpoint(retrieve.Retriever.of(graph, ranks).retrieve(spark.createDataFrame([(0, question)], "query long, question string"), "hybrid_rrf", 5))
    hits = trial.withColumnRenamed("doc", "entity_id").join(graph.entities.select("entity_id", "label", "entity_type"), "entity_id").orderBy("rank").select("rank", "entity_id", "label", "entity_type", "score")
    summary = {
        "documents_processed": chunks.select("document_id").distinct().count(), "chunks_processed": chunks.count(), "entity_count_raw": raw[0], "relation_count_raw": raw[1],
        "entity_count_final": graph.entities.count(), "relation_count_final": graph.relations.count(), "dedup_merged_count": found.before - found.after,
        "typing": {"typed": sum(r["typed"] for r in typing_rows), "cache_hits": sum(r["cache_hits"] for r in typing_rows), "cache_misses": sum(r["cache_misses"] for r in typing_rows), "classes": {r["assigned_class"]: r["typed"] for r in typing_rows}},
        "consistency_before": broken["consistency"], "consistency_after_repair": mended["consistency"], "consistency_final": checked(graph, classes, specs)["consistency"],
        "repair": {"repaired_unknown_types": broken["invalid_entity_type"], "removed_self_loops": broken["self_loop"], "violations_before": broken["violations"], "violations_after": mended["violations"]},
        "reasoning": {"inferred_relations": added}, "pagerank_computed": ranks.limit(1).count() > 0, "graph_path": path, "summary_path": summary_path(path),
        "retrieval_query": question, "retrieved_entities": [r.asDict() for r in hits.collect()],
    }
    return Built(graph, ranks, summary)


def ask(spark: SparkSession, retriever: retrieve.Retriever, question: str, *, mode: str = "lexical_structural", limit: int = 10, model: clients.TextModel | None = None) -> dict[str, object]:
    """Hits, context, answer, relations and chunks for one question; the operators take whole tables of them."""
    if not question.strip():
        raise ValueError("the question is empty")
    started = time.perf_counter()
    questions = spark.createDataFrame([(0, question)], "query long, question string")
    hits = checkpoint(retriever.retrieve(questions, mode, min(max(limit, 1), 20)))
    text = checkpoint(context.context_text(retriever.graph, questions, hits))
    told = text.first()["context"]
    if model is None:
        answer = context.answers(questions, text).first()["answer"]
    else:
        answer = context.tidy_answer(model.complete(context.answer_prompt(question, told)).strip(), question)
    relations = context.relation_payload(retriever.graph, hits)
    chunks = context.source_chunks(retriever.graph, hits, relations)
    rows = hits.join(retriever.graph.entities.withColumnRenamed("entity_id", "doc"), "doc").orderBy("rank")
    return {
        "question": question, "mode": mode, "answer": answer, "context": told, "entities": [r.asDict(True) for r in rows.select("doc", "label", "entity_type", "score", "rank", "components").collect()],
        "relations": [r.asDict() for r in relations.orderBy("pos").collect()], "source_chunks": [r.chunk_id for r in chunks.orderBy("pos").collect()], "seconds": time.perf_counter() - started,
    }


def evaluate_modes(retriever: retrieve.Retriever, questions: DataFrame, limit: int = 10) -> DataFrame:
    """Metrics by mode of questions (query, question, question_type, relevant_entity_labels), all questions in one batch for each mode."""
    want = questions.select("query", F.explode("relevant_entity_labels").alias("name")).select("query", tx.normalize_eval_label(F.col("name")).alias("label"))
    out = None
    for mode in retrieve.MODES:
        hits = retriever.retrieve(questions.select("query", "question"), mode, limit)
        rows = evaluate.retrieval_metrics(evaluate.hit_labels(retriever.graph, hits), want).join(questions.select("query", "question_type"), "query").withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluate_answers(retriever: retrieve.Retriever, questions: DataFrame, limit: int = 10, mode: str = "lexical_structural") -> DataFrame:
    """query, faithfulness, answer_relevance, context_precision, context_recall with deterministic answers."""
    asked = questions.select("query", "question")
    hits = checkpoint(retriever.retrieve(asked, mode, limit))
    text = checkpoint(context.context_text(retriever.graph, asked, hits))
    want = questions.select("query", F.explode("relevant_entity_labels").alias("name")).select("query", tx.normalize_eval_label(F.col("name")).alias("label"))
    said = context.answers(asked, text).join(text.select("query", "context"), "query").join(asked, "query")
    said = said.select("query", evaluate.faithfulness(F.col("answer"), F.col("context")).alias("faithfulness"), evaluate.relevance(F.col("question"), F.col("answer")).alias("answer_relevance"))
    return said.join(evaluate.context_scores(evaluate.hit_labels(retriever.graph, hits), want), "query", "left")


def timed_answers(retriever: retrieve.Retriever, questions: DataFrame, limit: int = 10, mode: str = "lexical_structural", model: clients.TextModel | None = None) -> list[dict[str, object]]:
    """Seconds of retrieval, context and answer for each question, asked one after the other as a reader would."""
    spark = questions.sparkSession
    rows = []
    for q in questions.select("query", "question").orderBy("query").collect():
        asked = spark.createDataFrame([(0, q.question)], "query long, question string")
        at = [time.perf_counter()]
        hits = checkpoint(retriever.retrieve(asked, mode, limit))
        at.append(time.perf_counter())
        text = checkpoint(context.context_text(retriever.graph, asked, hits))
        at.append(time.perf_counter())
        answer = context.answers(asked, text).first()["answer"] if model is None else context.tidy_answer(model.complete(context.answer_prompt(q.question, text.first()["context"])).strip(), q.question)
        at.append(time.perf_counter())
        rows.append({"question": q.question, "retrieval_s": at[1] - at[0], "context_format_s": at[2] - at[1], "generation_s": at[3] - at[2], "total_s": at[3] - at[0], "n_entities_retrieved": hits.count(), "answer_length_chars": len(answer)})
    return rows


#: The stages that ``timed_answers`` measures.
STAGES = ("retrieval_s", "context_format_s", "generation_s", "total_s")
ALPHAS, THRESHOLDS = (0.4, 0.5, 0.6, 0.7, 0.8), (0.75, 0.8, 0.85, 0.9, 0.95)


def dedup_ablation(
    graph: Graph, labelled: DataFrame, *, alphas: tuple[float, ...] = ALPHAS, thresholds: tuple[float, ...] = THRESHOLDS, ontology_tables: tuple[DataFrame, DataFrame] | None = None
) -> list[dict[str, object]]:
    """Confusion of labelled (left, right, actual: labels and whether they are one) at every alpha and threshold, best first.

    Labels that the graph doesn't hold are left out. With ``ontology_tables`` (classes, specs) each setting also resolves the whole graph.
    """
    names = labelled.select(F.col("left").alias("label")).union(labelled.select("right")).distinct()
    ids = checkpoint(evaluate.label_lookup(graph, names))
    of = lambda end: ids.select(F.col("label").alias(end), F.col("entity_id").alias(f"{end}_id"))
    pairs = labelled.join(of("left"), "left").join(of("right"), "right").select("left_id", "right_id", "actual")
    scored = resolve.with_similarity(pairs.select("left_id", "right_id").distinct(), graph.entities).drop("hybrid")
    kind = lambda end: graph.entities.select(F.col("entity_id").alias(f"{end}_id"), F.col("entity_type").alias(f"{end}_type"))
    rows = checkpoint(pairs.join(scored, ["left_id", "right_id"]).join(kind("left"), "left_id").join(kind("right"), "right_id"))
    out = [r.asDict() | {"n_pairs": r.tp + r.fp + r.fn + r.tn} for r in evaluate.ablation(rows, list(alphas), list(thresholds)).collect()]
    if ontology_tables is not None:
        for row in out:
            started = time.perf_counter()
            found = resolve.resolve(graph, alpha=row["alpha"], threshold=row["theta"])
            row |= {
                "entity_count_after": found.after, "dedup_rate": (found.before - found.after) / found.before if found.before else 0.0, "merged_count": found.before - found.after,
                "consistency": checked(cut(found.graph), *ontology_tables)["consistency"], "dedup_elapsed_s": time.perf_counter() - started,
            }
    return out


def full_evaluation(
    spark: SparkSession, retriever: retrieve.Retriever, questions: DataFrame, folder: str, *, skip: tuple[str, ...] = (), labelled: DataFrame | None = None, n_latency: int = 20, ontology_tables: tuple[DataFrame, DataFrame] | None = None
) -> dict[str, list[dict]]:
    """Retrieval, baselines, generation, latency (of the first ``n_latency`` questions, asked singly) and, given ``labelled`` pairs, the
    resolution grid, as JSON files, rows by question as Parquet tables, and one Markdown report."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    out: dict[str, list[dict]] = {}
    if "retrieval" not in skip:
        metrics = checkpoint(evaluate_modes(retriever, questions))
        means = checkpoint(evaluate.metric_means(metrics, "mode"))
        metrics.write.mode("overwrite").parquet(f"{folder}/retrieval_per_question")
        out["retrieval_metrics"] = rows(means.orderBy("mode"))
        out["question_types"] = rows(evaluate.metric_means(metrics, "question_type", "mode").orderBy("question_type", "mode"))
        out["baseline_metrics"] = rows(evaluate.baselines(means).orderBy("system"))
    if "generation" not in skip:
        parts = ("faithfulness", "answer_relevance", "context_precision", "context_recall")
        scores = checkpoint(evaluate_answers(retriever, questions))
        scores.write.mode("overwrite").parquet(f"{folder}/generation_per_question")
        out["generation_metrics"] = rows(scores.agg(*[F.bround(F.avg(p), 4).alias(p) for p in parts]))
    if "latency" not in skip:
        singly = timed_answers(retriever, questions.orderBy("query").limit(n_latency))
        stores.save_json(singly, f"{folder}/latency_per_question.json")
        timings = [(s, r[s]) for r in singly for s in STAGES]
        out["latency_results"] = rows(evaluate.latency(spark.createDataFrame(timings, "stage string, seconds double")).orderBy("stage"))
    if "dedup" not in skip and labelled is not None:
        out["dedup_ablation"] = dedup_ablation(retriever.graph, labelled, ontology_tables=ontology_tables)
    for name, payload in out.items():
        stores.save_json(payload, f"{folder}/{name}.json")
    with open(f"{folder}/evaluation_report.md", "w", encoding="utf-8") as f:
        f.write(evaluate.report(out))
    return out


def dashboard(graph: Graph, ranks: DataFrame, classes: DataFrame, specs: DataFrame) -> dict[str, object]:
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "types": rows(evaluate.type_counts(graph).orderBy(F.desc("entities"), "entity_type")), "predicates": rows(evaluate.predicate_counts(graph)), "metrics": graphs.graph_metrics(graph).first().asDict(),
        "chunks": evaluate.chunk_counts(graph).first().asDict(), "top_degree": rows(graphs.top_by(graph, graphs.degrees(graph), "degree")), "top_pagerank": rows(graphs.top_by(graph, ranks, "pagerank")),
        "validation": ontology.validation(graph, classes, specs).first().asDict(),
    }
