"""Caches, the resolution grid, reports, stores and the JSON endpoints on small graphs."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from .helpers import classes, eid, graph, leukemia, specs
from .test_retrieval import ONTOLOGY, rules
from kestrel_kg import clients, settings
from kestrel_kg.operators import ontology, retrieve
from kestrel_kg.plans import web, workflow
from kestrel_kg.sources import files, stores


class Silent:
    def complete(self, prompt, schema=None):
        raise AssertionError("asked again")


def test_answers_are_kept(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("First note on imatinib.", encoding="utf-8")
    (tmp_path / "o.json").write_text(json.dumps(ONTOLOGY), encoding="utf-8")
    onto, cache = files.load_ontology(str(tmp_path / "o.json")), str(tmp_path / "cache")
    first = workflow.build_graph(spark, str(tmp_path / "notes"), onto, lambda: clients.RuleModel(rules()), cache=cache)
    again = workflow.build_graph(spark, str(tmp_path / "notes"), onto, Silent, cache=cache)
    assert first.summary["typing"]["cache_misses"] == again.summary["typing"]["cache_hits"] == 2
    assert first.graph.relations.collect() == again.graph.relations.collect()


def test_only_objects_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([("a", "{}"), ("b", "[1]"), ("c", "{bad"), ("d", None)], "key string, payload string")
    stores.append_cache(rows, str(tmp_path / "c"), "x")
    stores.append_cache(rows, str(tmp_path / "c"), "x")
    assert [tuple(r) for r in stores.read_cache(spark, str(tmp_path / "c"), "x").collect()] == [("a", "{}")]
    assert stores.read_cache(spark, str(tmp_path / "none"), "x").count() == 0


def test_resolution_grid(spark):
    g = graph(spark, [("imatinib", "Drug", "", []), ("imatinibe", "Drug", "", []), ("aspirin", "Drug", "", [])], [("imatinib", "treats", "aspirin")])
    labelled = spark.createDataFrame([("imatinib", "imatinibe", True), ("imatinib", "aspirin", False), ("imatinib", "nowhere", True)], "left string, right string, actual boolean")
    rows = workflow.dedup_ablation(g, labelled)
    assert len(rows) == 25 and rows[0]["f1"] == 1.0 and rows[0]["n_pairs"] == 2 and [r["f1"] for r in rows] == sorted((r["f1"] for r in rows), reverse=True)
    row = workflow.dedup_ablation(g, labelled, alphas=(0.6,), thresholds=(0.85,), ontology_tables=(classes(spark), specs(spark)))[0]
    assert row["merged_count"] >= 0 and row["entity_count_after"] == 3 - row["merged_count"] and row["dedup_rate"] == pytest.approx(row["merged_count"] / 3) and 0 <= row["consistency"] <= 1


def test_repair_report(spark):
    g = graph(spark, [("a", "Drug", "", []), ("b", "Condition", "", [])], [("b", "treats", "a"), ("a", "treats", "b"), ("a", "odd", "b")])
    fixed, actions = ontology.repair(g, specs(spark))
    told = workflow.repair_report(g, fixed, actions, classes(spark), specs(spark))
    assert told["predicate_distribution_before"] == {"odd": 1, "treats": 2} and told["predicate_distribution_after"] == {"related_to": 1, "treats": 1}
    assert told["actions"] == {"deduplicated_relations": 1, "inferred_entity_types": 0, "invalid_predicate_relaxed": 1, "kept": 1, "removed_self_loops": 0, "reversed": 1}
    assert told["validation_before"]["violation_types"] == {"domain_violation": 1, "invalid_predicate": 1, "range_violation": 1} and told["validation_after"]["violation_count"] == 0
    assert ontology.repair(g, specs(spark), deduplicate=False)[0].relations.count() == 3


class Session:
    said: list = []

    def run(self, text, **values):
        self.said.append((text, values))

    def close(self):
        pass


def test_graph_store_statements():
    target = stores.CypherTarget(Session())
    target.prepare(clear=True)
    target.nodes([{"entity_id": "x", "label": "l", "metadata": "{}"}])
    target.edges([{"relation_type": t, "subject_id": "x", "object_id": "y", "predicate": "p", "relation_key": "k", "confidence": 1.0, "source_chunk": None, "metadata": "{}"} for t in ("A", "B", "A")])
    said = Session.said
    assert "IS UNIQUE" in said[0][0] and "DETACH DELETE" in said[1][0] and said[2][1]["rows"] == [{"id": "x", "label": "l", "metadata_json": "{}"}]
    assert [len(v["rows"]) for _, v in said[3:]] == [2, 1] and "[r:`A`" in said[3][0]


def test_table_store_merges_and_clears(spark, tmp_path):
    store = stores.TableStore(spark, str(tmp_path / "t"))
    store.write_graph(leukemia(spark))
    more = graph(spark, [("imatinib", "Drug", "new text", []), ("aspirin", "Drug", "", [])], [("imatinib", "related_to", "aspirin")])
    store.write_graph(more)
    assert store.stats() == {"entities": 5, "relations": 4}
    assert store.read_graph().entities.where(f"entity_id = '{eid('imatinib')}'").first().description == "new text"
    store.write_graph(more)
    assert store.stats() == {"entities": 5, "relations": 4}
    store.write_graph(more, clear=True)
    assert store.stats() == {"entities": 2, "relations": 1}


def test_json_is_indented(spark, tmp_path):
    stores.write_json(leukemia(spark), str(tmp_path / "g.json"))
    text = (tmp_path / "g.json").read_text(encoding="utf-8")
    found = json.loads(text)
    assert text == json.dumps(found, ensure_ascii=False, indent=2) and list(found) == ["entities", "relations", "pagerank"]


def test_embedding_replies(monkeypatch):
    client = clients.HttpModel("http://x", "m")
    monkeypatch.setattr(client, "post", lambda body: {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]})
    assert client.encode(["a", "b"]) == [[1.0], [2.0]]
    single = clients.HttpModel("http://x", "m", single=True)
    monkeypatch.setattr(single, "post", lambda body: {"embedding": [len(body["prompt"])]})
    assert single.encode(["a", "bb"]) == [[1.0], [2.0]]


def test_model_settings():
    chat = settings.chat("OPENAI", None, {"OPENAI_API_KEY": "k", "OPENAI_MAX_RETRIES": "4", "OPENAI_BASE_URL": "http://h/"})
    assert (chat.base_url, chat.max_retries, chat.client().url) == ("http://h", 4, "http://h/chat/completions") and "'k'" not in repr(chat)
    with pytest.raises(ValueError):
        settings.chat("DEEPSEEK", None, {})
    with pytest.raises(ValueError):
        settings.embedding(None, {"EMBEDDING_PROVIDER": "demo", "EMBEDDING_REQUEST_TIMEOUT_SECONDS": "x"})
    assert settings.embedding(None, {"EMBEDDING_PROVIDER": "Ollama"}).client().single
    assert settings.store(None, {"NEO4J_DATABASE": ""}).database is None


def test_endpoints(spark, tmp_path):
    stores.write_json(leukemia(spark), str(tmp_path / "g.json"))
    (tmp_path / "o.json").write_text(json.dumps(ONTOLOGY), encoding="utf-8")
    service = web.Service(spark, str(tmp_path), "g.json", files.load_ontology(str(tmp_path / "o.json")), lambda: clients.RuleModel(rules()))
    server = web.server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    assert call("/api/entities?query=glivec")[1]["total"] == 1
    assert call("/api/dashboard")[1]["metrics"]
    near = call(f"/api/subgraph?entity_id={eid('imatinib')}")[1]
    assert len(near["nodes"]) == 2 and near["relations"][0]["predicate"] == "treats"
    assert call(f"/api/subgraph?entity_id={eid('imatinib')}&predicate=none")[1]["relations"] == []
    assert call("/api/retrieved-subgraph", {"entity_ids": [eid("imatinib"), eid("dasatinib")]})[1]["relations"]
    assert call("/api/ask", {"query": "imatinib", "top_k": 2})[1]["entities"][0]["label"] == "imatinib"
    compared = call("/api/retrieval/compare", {"query": "imatinib", "top_k": 99})[1]
    assert set(compared["modes"]) == set(retrieve.MODES) and compared["top_k"] == 20 and compared["modes"]["lexical_only"]["items"][0]["label"] == "imatinib"
    assert call("/api/evaluation/summary")[0] == 200 and call("/api/neo4j/status")[1]["available"] is False
    assert call("/api/ask", {"query": " "})[0] == 400 and call("/api/none")[0] == 404 and call("/api/neo4j/export", {})[0] == 400
    assert call("/api/entities?graph_path=../../etc/passwd")[0] == 400
    status, job = call("/api/pipeline/jobs", {"documents": [{"name": "a.md", "text": "First note on imatinib."}]})
    assert status == 202
    for _ in range(120):
        told = call(f"/api/pipeline/jobs/{job['job_id']}")[1]
        if told["status"] in ("completed", "failed"):
            break
        time.sleep(1)
    assert told["status"] == "completed" and told["summary"]["entity_count_final"] == 2, told
    server.shutdown()
