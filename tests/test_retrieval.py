import json

import pytest
from pyspark.sql import functions as F

from .helpers import eid, leukemia
from kestrel_kg import cli, clients
from kestrel_kg.operators import context, evaluate, retrieve
from kestrel_kg.plans import workflow
from kestrel_kg.sources import files, stores
from kestrel_kg.streaming import ingest


@pytest.fixture(scope="module")
def retriever(spark):
    return retrieve.Retriever.of(leukemia(spark), embed=lambda text: F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))


def labels(spark, retriever, question, mode, limit):
    q = spark.createDataFrame([(1, question)], "query long, question string")
    rows = retriever.retrieve(q, mode, limit).join(retriever.names(), "doc").orderBy("rank").collect()
    return [r.label for r in rows]


def test_modes(spark, retriever):
    disease = "Ph+ acute lymphoblastic leukemia"
    assert labels(spark, retriever, "leukemia treatment", "semantic_only", 3) == ["imatinib", "dasatinib", disease]
    assert labels(spark, retriever, "Glivec inhibitor", "lexical_only", 2) == ["imatinib", "dasatinib"]
    assert labels(spark, retriever, "anything", "structural_only", 1) == ["RT-PCR"]
    assert labels(spark, retriever, "leukemia treatment", "hybrid_rrf", 3) == [disease, "dasatinib", "imatinib"]
    assert labels(spark, retriever, "x", "lexical_structural", 0) == []
    with pytest.raises(ValueError):
        labels(spark, retriever, "x", "nonsense", 1)


def test_fusion(spark):
    one = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query long, doc string, rank int")
    two = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query long, doc string, rank int")
    rows = {r.doc: (r.rank, r.score) for r in retrieve.rrf([one, two]).collect()}
    assert rows["b"] == (1, pytest.approx(1 / 62 + 1 / 61)) and rows["a"][0] == 2 and rows["c"][0] == 3
    with pytest.raises(ValueError):
        retrieve.rrf([one], 0)


def test_context_and_answers(spark, retriever):
    q = spark.createDataFrame([(1, "How to treat leukemia?"), (2, "Чем лечить?"), (3, "unknown")], "query long, question string")
    hits = spark.createDataFrame([(1, eid("imatinib"), 1), (2, eid("imatinib"), 1)], "query long, doc string, rank int")
    text = context.context_text(retriever.graph, q, hits)
    told = {r.query: r.context for r in text.collect()}
    assert told[1].splitlines()[1] == "- imatinib [Drug]: BCR-ABL tyrosine kinase inhibitor. Aliases: Glivec"
    assert "- imatinib --treats--> Ph+ acute lymphoblastic leukemia (confidence=0.95)" in told[1]
    assert told[3] == "Entities:\n- <none>\n\nRelations:\n- <none>"
    said = {r.query: r.answer for r in context.answers(q, text).collect()}
    assert said[1].startswith("Based only on the graph context") and said[2].startswith("Только по графовому контексту")
    assert said[3].endswith("not supported by the graph context.")
    few = context.context_entities(retriever.graph, q, hits, most=1)
    assert few.where("query = 1").count() == 2


def test_answers_in_json_become_sentences():
    assert "imatinib" in context.tidy_answer('{"entities": [{"name": "imatinib"}, {"name": "Imatinib"}]}', "What treats it?")
    assert context.tidy_answer("Use imatinib. This is not medical advice.", "x") == "Use imatinib."


def test_average_precision_counts_new_labels_once(spark):
    found = spark.createDataFrame([(0, 1, "x"), (0, 2, "a"), (0, 2, "a2"), (0, 3, "b"), (0, 4, "a")], "query long, rank int, label string")
    want = spark.createDataFrame([(0, "a"), (0, "b")], "query long, label string")
    row = evaluate.retrieval_metrics(found, want).first()
    assert row.average_precision == pytest.approx((0.5 + 2 / 3) / 2) and row.reciprocal_rank == 0.5 and row.hit_at_5 == 1.0


def test_answer_scores(spark):
    row = spark.createDataFrame([("imatinib treats leukemia. moon cheese green.", "imatinib treats leukemia", "what treats leukemia")], "a string, c string, q string")
    out = row.select(evaluate.faithfulness(F.col("a"), F.col("c")).alias("f"), evaluate.relevance(F.col("q"), F.col("c")).alias("r")).first()
    assert out.f == 0.5 and out.r == pytest.approx(2 * 2 / 6)


def test_search_and_stores(spark, retriever, tmp_path):
    page, total = retrieve.search(retriever.graph, "glivec")
    assert total == 1 and page.first().label == "imatinib"
    stores.write_json(retriever.graph, str(tmp_path / "g.json"), retriever.ranks)
    again, ranks = files.read_graph(spark, str(tmp_path / "g.json"))
    assert again.entities.count() == 4 and again.relations.count() == 3 and ranks.count() == 4
    store = stores.TableStore(spark, str(tmp_path / "tables"))
    store.write_graph(retriever.graph)
    assert store.stats() == {"entities": 4, "relations": 3} and len(store.search_entities("drug")) == 2
    assert store.get_subgraph(eid("imatinib"))["total_relations"] == 1
    edges = stores.store_rows(retriever.graph)[1]
    assert {r.relation_type for r in edges.collect()} == {"TREATS", "DIAGNOSED_BY"}


ONTOLOGY = {"classes": {c: {"description": c} for c in ("Drug", "Condition", "Other")}, "relations": {"treats": {"domain": "Drug", "range": "Condition"}, "related_to": {"domain": "Other", "range": "Other"}}}


def rules():
    entity = lambda label, kind: {"label": label, "type": kind}
    return {
        "First note": {"entities": [entity("imatinib", "Drug"), entity("ALL", "Condition")], "relations": [{"subject": "imatinib", "predicate": "treats", "object": "ALL"}]},
        "Second note": {"entities": [entity("dasatinib", "Drug")], "relations": [{"subject": "dasatinib", "predicate": "treats", "object": "ALL"}]},
        "Entity: ALL": {"class": "Condition", "confidence": 1.0}, "typing": {"class": "Drug", "confidence": 0.9},
    }


def test_from_markdown_to_answers(spark, tmp_path):
    notes = tmp_path / "notes" / "deep"
    notes.mkdir(parents=True)
    (tmp_path / "notes" / "b.MD").write_text("Second note on dasatinib.", encoding="utf-8")
    (notes / "a.md").write_text("First note on imatinib.", encoding="utf-8")
    (notes / "skip.txt").write_text("no", encoding="utf-8")
    for name, content in (("onto.json", ONTOLOGY), ("rules.json", rules()), ("gt.json", {"questions": [{"question": "imatinib", "relevant_entity_labels": ["Imatinib"]}]})):
        (tmp_path / name).write_text(json.dumps(content), encoding="utf-8")
    built = workflow.build_graph(spark, str(tmp_path / "notes"), files.load_ontology(str(tmp_path / "onto.json")), lambda: clients.RuleModel(rules()))
    s = built.summary
    assert (s["documents_processed"], s["chunks_processed"], s["entity_count_raw"], s["entity_count_final"], s["relation_count_raw"], s["relation_count_final"]) == (2, 2, 3, 3, 2, 3)
    assert s["reasoning"] == {"inferred_relations": 1} and s["consistency_final"] == 1.0 and len(s) == 18
    assert s["typing"]["typed"] == 3 and s["typing"]["cache_misses"] == 3 and s["retrieved_entities"][0]["rank"] == 1
    told = workflow.ask(spark, retrieve.Retriever.of(built.graph, built.ranks), "imatinib", limit=2)
    assert told["entities"][0]["label"] == "imatinib" and told["source_chunks"]
    stores.write_json(built.graph, str(tmp_path / "g.json"), built.ranks)
    questions = files.read_benchmark(spark, str(tmp_path / "gt.json")).withColumnRenamed("id", "query")
    out = workflow.full_evaluation(spark, retrieve.Retriever.of(built.graph, built.ranks), questions, str(tmp_path / "out"))
    assert {r["mode"]: r["mrr"] for r in out["retrieval_metrics"]}["lexical_only"] == 1.0
    assert {r["system"] for r in out["baseline_metrics"]} == set(evaluate.BASELINES)
    assert {r["stage"] for r in out["latency_results"]} == set(workflow.STAGES)
    assert spark.read.parquet(str(tmp_path / "out" / "retrieval_per_question")).count() == 5
    assert (tmp_path / "out" / "evaluation_report.md").exists()


def test_command_line_errors(spark, tmp_path, capsys):
    assert cli.main(["ask", "--graph", str(tmp_path / "none.json"), "--query", "x"]) == 2
    bad = {"classes": {"A": {}}, "relations": {"r": {"domain": "A", "range": "B"}}}
    (tmp_path / "o.json").write_text(json.dumps(bad), encoding="utf-8")
    with pytest.raises(ValueError):
        files.load_ontology(str(tmp_path / "o.json"))
    with pytest.raises(FileNotFoundError):
        files.read_markdown(spark, str(tmp_path / "missing"))


def test_clients():
    assert clients.loose_json("```json\n{\"score\": 2}\n```") == {"score": 2}
    assert clients.judge_score("well, {\"faithfulness\": 1.7, \"comment\": \"c\"}", "faithfulness") == (1.0, "c")
    assert clients.HashEmbedder({"ab": [1.0, 0.0], "abc": [0.0, 1.0]}).encode(["x abc y"]) == [[0.0, 1.0]]
    assert "secret" not in repr(clients.HttpModel("u", "m", "secret"))
    with pytest.raises(KeyError):
        clients.RuleModel({}).complete("p")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nB='two=2'\nbad\n", encoding="utf-8")
    environ = {"A": "kept"}
    assert files.load_dotenv(str(tmp_path / ".env"), environ=environ) == {"A": "1", "B": "two=2"} and environ == {"A": "kept", "B": "two=2"}


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "four")], "document_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest.chunk_stream(stream, str(tmp_path / "chunks"), size=2, overlap=0, checkpoint=str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 3
    ingest.term_stream(stream, str(tmp_path / "terms"), checkpoint=str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "terms")).count() == 4
