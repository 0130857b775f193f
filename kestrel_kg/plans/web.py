"""JSON endpoints over the operators. A graph is read and indexed once for each state of its file; requests share the Spark session."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clients, settings
from ..operators import graphs, retrieve
from ..operators.model import Graph
from ..sources import files, stores
from . import workflow

#: The largest request body that is read.
MAX_BODY = 32 << 20


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def drawn(graph: Graph, found: dict[str, list]) -> dict[str, list]:
    """A chosen subgraph with its entities (at most 200) and relations as objects."""
    nodes = graph.entities.where(F.col("entity_id").isin(found["nodes"])).select("entity_id", "label", "entity_type", "description").orderBy("entity_id")
    return {"nodes": rows(nodes), "relations": [{k: v for k, v in r.asDict().items() if k != "_at"} for r in found["relations"]]}


def whole(value: object, usual: int) -> int:
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return usual


@dataclass
class Service:
    """What the endpoints serve; paths in requests must lie in ``root``. ``connect`` opens a graph store, ``model`` makes a language model."""

    spark: SparkSession
    root: str
    graph_path: str
    ontology: files.Ontology
    model: Callable[[], clients.TextModel] | None = None
    connect: Callable[[], object] | None = None
    results: str = "results"
    jobs: dict[str, dict] = field(default_factory=dict)
    _held: dict[str, tuple[tuple, retrieve.Retriever]] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def path(self, given: object, usual: str) -> str:
        found = os.path.realpath(os.path.join(self.root, str(given or usual)))
        if os.path.commonpath([found, os.path.realpath(self.root)]) != os.path.realpath(self.root):
            raise ValueError("the path lies outside the served folder")
        return found

    def retriever(self, given: object = None) -> retrieve.Retriever:
        path = self.path(given, self.graph_path)
        state = (os.stat(path).st_mtime_ns, os.stat(path).st_size)
        with self._lock:
            held = self._held.get(path)
            if held is None or held[0] != state:
                graph, ranks = files.read_graph(self.spark, path)
                held = self._held[path] = (state, retrieve.Retriever.of(graph, ranks))
        return held[1]

    def dashboard(self, q: dict) -> dict:
        r = self.retriever(q.get("graph_path"))
        return workflow.dashboard(r.graph, r.ranks, self.ontology.class_table(self.spark), self.ontology.relation_table(self.spark))

    def entities(self, q: dict) -> dict:
        limit, offset = whole(q.get("limit"), 30), max(whole(q.get("offset"), 0), 0)
        page, total = retrieve.search(self.retriever(q.get("graph_path")).graph, q.get("query") or "", kind=q.get("entity_type") or None, limit=limit, offset=offset)
        found = rows(page)
        return {"items": found, "total": total, "offset": offset, "has_more": offset + len(found) < total}

    def subgraph(self, q: dict) -> dict:
        kinds = [q["entity_type"]] if q.get("entity_type") else None
        graph = self.retriever(q.get("graph_path")).graph
        found = graphs.greedy_subgraph(graph, [q.get("entity_id") or ""], depth=whole(q.get("depth"), 1), max_nodes=whole(q.get("limit_nodes"), 60), types=kinds, predicate=q.get("predicate") or None)
        return drawn(graph, found)

    def retrieved_subgraph(self, q: dict) -> dict:
        centres = [str(x) for x in q.get("entity_ids", []) if str(x)]
        graph = self.retriever(q.get("graph_path")).graph
        return drawn(graph, graphs.greedy_subgraph(graph, centres, depth=whole(q.get("depth"), 1), max_nodes=whole(q.get("limit_nodes"), 80)))

    def ask(self, q: dict) -> dict:
        model = self.model() if self.model and q.get("llm") else None
        return workflow.ask(self.spark, self.retriever(q.get("graph_path")), str(q.get("query", "")), mode=str(q.get("retrieval_mode", "lexical_structural")), limit=whole(q.get("top_k"), 5), model=model)

    def compare(self, q: dict) -> dict:
        return retrieve.timed_comparison(self.retriever(q.get("graph_path")), str(q.get("query", "")), whole(q.get("top_k"), 5))

    def start_job(self, q: dict) -> dict:
        """Build a graph from uploaded documents (name, text) beside the requests."""
        documents = q.get("documents") or []
        if not documents or self.model is None:
            raise ValueError("documents and a model are needed")
        job = uuid.uuid4().hex[:12]
        out = self.path(q.get("out_path"), f"{self.results}/web_pipeline_{job}.json")
        folder = self.path(None, f"{self.results}/uploads-{job}")
        os.makedirs(folder)
        for k, d in enumerate(documents):
            with open(f"{folder}/{k:05d}-{os.path.basename(str(d.get('name') or 'upload')).removesuffix('.md')}.md", "w", encoding="utf-8") as f:
                f.write(str(d.get("text", "")))
        told = self.jobs[job] = {"job_id": job, "status": "queued", "out_path": out, "summary": None, "error": None}

        def work() -> None:
            told["status"] = "running"
            try:
                built = workflow.build_graph(self.spark, folder, self.ontology, self.model, path=out)
                stores.write_json(built.graph, out, built.ranks)
                told.update(status="completed", summary=built.summary)
            except Exception as error:  # the job's state tells it
                told.update(status="failed", error=str(error))

        threading.Thread(target=work, daemon=True).start()
        return dict(told)

    def job(self, name: str) -> dict:
        if name not in self.jobs:
            raise KeyError(f"no job {name}")
        return dict(self.jobs[name])

    def store_status(self, q: dict) -> dict:
        found = settings.store()
        told = {"uri": found.uri, "database": found.database, "configured": self.connect is not None or bool(found.password)}
        if self.connect is None:
            return told | {"available": False}
        try:
            self.connect().close()
            return told | {"available": True}
        except Exception as error:
            return told | {"available": False, "error": str(error)}

    def store_export(self, q: dict) -> dict:
        if self.connect is None:
            raise ValueError("no graph store is configured")
        graph = self.retriever(q.get("graph_path")).graph
        stores.upsert(graph, self.connect, clear=bool(q.get("clear", False)))
        return {"entities": graph.entities.count(), "relations": graph.relations.count()}

    def evaluation(self, q: dict) -> dict:
        return files.read_metrics(self.path(None, self.results))

    def answer(self, method: str, target: str, body: dict | None = None) -> tuple[int, object]:
        """(status, payload) of a request."""
        url = urlparse(target)
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        gets = {"/api/dashboard": self.dashboard, "/api/entities": self.entities, "/api/subgraph": self.subgraph, "/api/neo4j/status": self.store_status, "/api/evaluation/summary": self.evaluation}
        posts = {"/api/ask": self.ask, "/api/retrieved-subgraph": self.retrieved_subgraph, "/api/retrieval/compare": self.compare, "/api/pipeline/jobs": self.start_job, "/api/neo4j/export": self.store_export}
        try:
            if method == "GET" and url.path.startswith("/api/pipeline/jobs/"):
                return 200, self.job(url.path.rpartition("/")[2])
            found = (gets if method == "GET" else posts).get(url.path)
            if found is None:
                return 404, {"error": "not found"}
            return 202 if url.path == "/api/pipeline/jobs" else 200, found(query if method == "GET" else body or {})
        except (ValueError, KeyError, FileNotFoundError) as error:
            return 404 if isinstance(error, (KeyError, FileNotFoundError)) else 400, {"error": str(error)}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, payload: object) -> None:
            data = json.dumps(payload, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def serve(self, body: dict | None = None) -> None:
            try:
                self.reply(*service.answer(self.command, self.path, body))
            except Exception as error:  # one request's failure must not end the server
                self.reply(500, {"error": str(error)})

        def do_GET(self) -> None:
            self.serve()

        def do_POST(self) -> None:
            size = whole(self.headers.get("Content-Length"), 0)
            if size > MAX_BODY:
                self.reply(413, {"error": "the request is too large"})
                return
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                body = None
            if isinstance(body, dict):
                self.serve(body)
            else:
                self.reply(400, {"error": "the body must be a JSON object"})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
