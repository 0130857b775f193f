"""Command line: run-demo, ask, graph-stats, repair-graph, export, export-neo4j, payload, evaluate, web. Handled errors end with status 2."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException

from . import clients, settings
from .operators import graphs, ontology, retrieve
from .plans import web, workflow
from .session import get_session
from .sources import files, stores


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kestrel-kg")
    top.add_argument("--cores", type=int)
    sub = top.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("run-demo", help="build a graph from Markdown files")
    demo.add_argument("--input", required=True)
    demo.add_argument("--out", required=True)
    demo.add_argument("--answers", required=True, help="JSON of rules: prompt, part of a prompt or schema to answer")
    demo.add_argument("--cache", help="folder that keeps the model's answers")
    demo.add_argument("--chunk-size", type=int, default=800)
    demo.add_argument("--overlap", type=int, default=100)
    ask = sub.add_parser("ask", help="answer a question from a graph")
    ask.add_argument("--query", required=True)
    ask.add_argument("--mode", choices=retrieve.MODES, default="lexical_structural")
    ask.add_argument("--top-k", type=int, default=10)
    fix = sub.add_parser("repair-graph", help="repair a graph against the ontology")
    fix.add_argument("--out", required=True)
    fix.add_argument("--report")
    fix.add_argument("--infer-types", action="store_true")
    fix.add_argument("--keep-duplicates", action="store_true")
    out = sub.add_parser("export", help="write Parquet tables and rows for a property-graph store")
    out.add_argument("--out", required=True)
    store = sub.add_parser("export-neo4j", help="merge a graph into the graph store of the settings")
    store.add_argument("--clear", action="store_true")
    serve = sub.add_parser("web", help="serve the JSON endpoints")
    serve.add_argument("--root", default=".")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--answers", help="JSON of rules for a model")
    payload = sub.add_parser("payload", help="JSON for a view")
    payload.add_argument("--view", choices=("dashboard", "entities", "subgraph", "compare"), required=True)
    payload.add_argument("--query", default="")
    payload.add_argument("--entity", default="")
    payload.add_argument("--depth", type=int, default=1)
    payload.add_argument("--limit", type=int, default=20)
    payload.add_argument("--offset", type=int, default=0)
    score = sub.add_parser("evaluate", help="measure retrieval and answers")
    score.add_argument("--gt", required=True)
    score.add_argument("--out", required=True)
    score.add_argument("--skip", nargs="*", default=[])
    score.add_argument("--pairs", help="JSON list of [left label, right label, whether they are one] for the resolution grid")
    score.add_argument("--apply-dedup", action="store_true", help="resolve the whole graph at each setting; needs --ontology")
    score.add_argument("--latency-questions", type=int, default=20)
    score.add_argument("--ontology")
    stats = sub.add_parser("graph-stats", help="figures of a graph")
    for p in (ask, stats, fix, out, payload, score, store, serve):
        p.add_argument("--graph", required=True)
    for p in (demo, fix, payload, serve):
        p.add_argument("--ontology", required=True)
    return top


def show(value: object) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def run(args: argparse.Namespace) -> None:
    spark = get_session(args.cores)
    if args.command == "run-demo":
        with open(args.answers, encoding="utf-8") as f:
            rules = json.load(f)
        built = workflow.build_graph(spark, args.input, files.load_ontology(args.ontology), lambda: clients.RuleModel(rules), size=args.chunk_size, overlap=args.overlap, cache=args.cache, path=args.out)
        stores.write_json(built.graph, args.out, built.ranks)
        stores.save_json(built.summary, built.summary["summary_path"])
        show(built.summary)
        return
    if args.command == "web":
        model = None
        if args.answers:
            with open(args.answers, encoding="utf-8") as f:
                rules = json.load(f)
            model = lambda: clients.RuleModel(rules)
        web.server(web.Service(spark, args.root, args.graph, files.load_ontology(args.ontology), model), args.host, args.port).serve_forever()
        return
    graph, ranks = files.read_graph(spark, args.graph)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    if args.command == "graph-stats":
        show(graphs.graph_metrics(graph).first().asDict())
    elif args.command == "ask":
        found = workflow.ask(spark, retrieve.Retriever.of(graph, ranks), args.query, mode=args.mode, limit=args.top_k)
        print(found["answer"])
    elif args.command == "repair-graph":
        onto = files.load_ontology(args.ontology)
        classes, specs = onto.class_table(spark), onto.relation_table(spark)
        fixed, actions = ontology.repair(graph, specs, infer_types=args.infer_types, deduplicate=not args.keep_duplicates)
        report = workflow.repair_report(graph, fixed, actions, classes, specs, ontology.inferred_types(graph, specs) if args.infer_types else None)
        path = args.report or args.out.removesuffix(".json") + ".repair_report.json"
        report |= {"input_graph": args.graph, "output_graph": args.out, "report_path": path}
        stores.write_json(fixed, args.out, graphs.pagerank(graphs.nodes_of(fixed), fixed.edges()).withColumnRenamed("node", "entity_id"))
        stores.save_json(report, path)
        show(report)
    elif args.command == "export":
        stores.write_tables(graph, args.out, ranks)
        nodes, edges = stores.store_rows(graph)
        nodes.write.mode("overwrite").parquet(f"{args.out}/store_nodes")
        edges.write.mode("overwrite").parquet(f"{args.out}/store_edges")
    elif args.command == "export-neo4j":
        found = settings.store()
        stores.upsert(graph, lambda: stores.CypherTarget.connect(found.uri, found.user, found.password, found.database), clear=args.clear)
    elif args.command == "evaluate":
        questions = files.read_benchmark(spark, args.gt).withColumnRenamed("id", "query")
        labelled = tables = None
        if args.pairs:
            with open(args.pairs, encoding="utf-8") as f:
                labelled = spark.createDataFrame([(a, b, bool(c)) for a, b, c in json.load(f)], "left string, right string, actual boolean")
        if args.apply_dedup:
            if not args.ontology:
                raise ValueError("--apply-dedup needs --ontology")
            onto = files.load_ontology(args.ontology)
            tables = onto.class_table(spark), onto.relation_table(spark)
        found = workflow.full_evaluation(spark, retrieve.Retriever.of(graph, ranks), questions, args.out, skip=tuple(args.skip), labelled=labelled, n_latency=args.latency_questions, ontology_tables=tables)
        print(stores.fixed_width(found.get("retrieval_metrics", [])))
    elif args.view == "dashboard":
        onto = files.load_ontology(args.ontology)
        show(workflow.dashboard(graph, ranks, onto.class_table(spark), onto.relation_table(spark)))
    elif args.view == "entities":
        page, total = retrieve.search(graph, args.query, limit=args.limit, offset=args.offset)
        show({"entities": rows(page), "total": total})
    elif args.view == "subgraph":
        page = graphs.subgraph(graph, args.entity, args.depth, args.limit, args.offset)
        show(page | {"relations": rows(page["relations"]), "nodes": rows(page["nodes"])})
    else:
        show(retrieve.timed_comparison(retrieve.Retriever.of(graph, ranks), args.query, args.limit))


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except (FileNotFoundError, NotADirectoryError, ValueError, KeyError, AnalysisException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
