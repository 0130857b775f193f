"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import statistics
import time

from pyspark.sql import functions as F

from kestrel_kg.operators import graphs, retrieve
from kestrel_kg.plans import fixture, queries
from kestrel_kg.session import get_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "4"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
NAMES = ("chunk_documents", "search_tokens", "bm25_topk", "violations", "repair_relations", "reason_shared", "degrees", "components", "khop2", "lexical_structural_topk", "rrf_topk", "entity_search", "eval_relevance", "latency_stats")
ONCE = ("lexical_pairs", "dedup_lexical", "eval_systems")


def drain(df) -> int:
    """Run a whole plan without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()
    return 0


def run(spark, name: str) -> None:
    """A query with the indexes that it makes for itself; the graph and its retriever are made before."""
    for made in (queries.document_scores, queries.vector_matches, queries.eval_rows):
        made.cache_clear()
    drain(queries.REGISTRY[name](spark, FOLDER))


def timed(work, runs: int = RUNS) -> float:
    seconds = []
    for _ in range(runs):
        t = time.perf_counter()
        work()
        seconds.append(time.perf_counter() - t)
    return round(statistics.median(seconds), 4)


def main() -> None:
    spark = get_session(CPUS, **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(2 * CPUS)})
    found: dict[str, float] = {}
    t = time.perf_counter()
    g = fixture.graph(spark, FOLDER)
    found["graph_build"] = round(time.perf_counter() - t, 4)
    found["pagerank"] = timed(lambda: graphs.pagerank(graphs.nodes_of(g), g.edges()).count(), 1)
    t = time.perf_counter()
    retriever = queries.retriever(spark, FOLDER)
    retriever.vectors.count()
    found["retrieval_index_build"] = round(time.perf_counter() - t, 4)
    asked = queries.benchmark_questions(spark, FOLDER).cache()
    n = asked.count()
    for mode in retrieve.MODES:
        found[f"batch_{mode}"] = timed(lambda: drain(retriever.retrieve(asked, mode)))
    for name in NAMES:
        run(spark, name)
        found[name] = timed(lambda: run(spark, name))
    for name in ONCE:
        found[name] = timed(lambda: run(spark, name), 1)
    each = found["batch_lexical_structural"] / max(n, 1)
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    print(json.dumps({"metric": "seconds a question, batch of lexical_structural", "value": round(each, 5), "unit": "sec", "queries": found, "sf": float(scale[1]) if scale else None, "questions": n, "entities": g.entities.select(F.count("*")).first()[0]}))
    spark.stop()


if __name__ == "__main__":
    main()
