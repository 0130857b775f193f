import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from .helpers import classes, eid, graph, leukemia, specs
from kestrel_kg.operators import build, graphs, ontology, resolve


def test_extraction_payloads(spark):
    rows = [
        (0, "c0", '{"entities": [{"label": " Imatinib ", "type": "Drug", "aliases": ["Glivec"]}], "relations": [{"subject": "imatinib", "predicate": "treats", "object": "ALL", "confidence": 0.5}]}'),
        (1, "c1", '{"entities": [{"label": "imatinib", "type": "Condition", "description": "d"}, {"label": "ALL", "type": "Condition"}], "relations": []}'),
        (2, "c2", "{bad"),
        (3, "c3", '{"entities": [{"label": ""}], "relations": []}'),
    ]
    entities, relations, rejected = build.parse_extractions(spark.createDataFrame(rows, "chunk_order long, chunk_id string, payload string"))
    assert {r.chunk_id for r in rejected.collect()} == {"c2", "c3"}
    g = build.build_graph(entities, relations)
    found = {r.label: r for r in g.entities.collect()}
    assert set(found) == {"Imatinib", "ALL"}
    assert (found["Imatinib"].entity_type, found["Imatinib"].description, found["Imatinib"].source_chunks) == ("Drug", "d", ["c0", "c1"])
    assert found["ALL"].entity_type == "Condition"
    edge = g.relations.first()
    assert (edge.subject_id, edge.object_id, edge.confidence, edge.source_chunk) == (eid("imatinib"), eid("all"), 0.5, "c0")


def test_loops_are_refused_or_left_out(spark):
    entities = spark.createDataFrame([], "chunk_order long, chunk_id string, pos long, label string, entity_type string, description string, aliases array<string>")
    relations = spark.createDataFrame([(0, "c", 0, "a", "p", "A", 1.0)], "chunk_order long, chunk_id string, pos long, subject string, predicate string, object string, confidence double")
    with pytest.raises(ValueError):
        build.build_graph(entities, relations)
    assert build.build_graph(entities, relations, strict=False).relations.count() == 0


def test_cached_answers(spark):
    requests = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    cache = spark.createDataFrame([("k", "old")], "key string, payload string").withColumn("key", F.md5(F.lit("y")))
    answered, larger, fresh = build.with_cache(requests, cache, build.chunk_key(F.col("text")), lambda missing: missing.select("key", F.concat("text", F.lit("!")).alias("payload")))
    assert sorted((r.text, r.payload, r.cache_hit) for r in answered.collect()) == [("x", "x!", False), ("x", "x!", False), ("y", "old", True)]
    assert fresh.count() == 1 and larger.count() == 2


def ranks(nodes, edges, steps=100, alpha=0.85):
    index = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for s, d in set(edges):
        m[index[d], index[s]] = 1
    out = m.sum(0)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(steps):
        r = alpha * (m @ np.divide(r, out, out=np.zeros_like(r), where=out > 0) + r[out == 0].sum() / len(nodes)) + (1 - alpha) / len(nodes)
    return dict(zip(nodes, r, strict=True))


def test_pagerank_and_components(spark):
    names = list("abcdefg")
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f")]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    links = spark.createDataFrame(edges, "src string, dst string")
    found = {r.node: r.pagerank for r in graphs.pagerank(nodes, links, fixed_steps=8).collect()}
    assert found == pytest.approx(ranks(names, edges, 8)) and sum(found.values()) == pytest.approx(1)
    assert {r.node: r.component for r in graphs.components(nodes, links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}


def test_empty_graph(spark):
    nodes, links = spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string")
    assert graphs.pagerank(nodes, links).count() == 0 and graphs.components(nodes, links).count() == 0


def test_neighbours_and_pages(spark):
    g = leukemia(spark)
    assert [r.label for r in graphs.neighbours(g, eid("imatinib"), 1).collect()] == ["Ph+ acute lymphoblastic leukemia"]
    assert [r.label for r in graphs.neighbours(g, eid("imatinib"), 2).collect()] == ["Ph+ acute lymphoblastic leukemia", "RT-PCR", "dasatinib"]
    assert graphs.neighbours(g, "unknown", 2).count() == 0 and graphs.neighbours(g, eid("imatinib"), 0).count() == 0
    page = graphs.subgraph(g, eid("RT-PCR"), 2, limit=1)
    assert (page["total_relations"], page["has_more"], page["relations"].count()) == (3, True, 1)
    assert len(graphs.greedy_subgraph(g, [eid("imatinib")], depth=2, max_nodes=2)["relations"]) == 1
    assert {r.label: r.degree for r in graphs.top_by(g, graphs.degrees(g), "degree").collect()}["Ph+ acute lymphoblastic leukemia"] == 3


def test_resolution_merges_spellings(spark):
    g = graph(spark, [("BCR-ABL inhibitor", "Drug", "", ["TKI"], None, ["chunk-1"]), ("BCR ABL inhibitor", "Drug", "", ["tyrosine kinase inhibitor"], None, ["chunk-2"]), ("RT-PCR", "LabTest", "", [])], [("BCR-ABL inhibitor", "p", "RT-PCR"), ("BCR ABL inhibitor", "p", "RT-PCR")])
    found = resolve.resolve(g)
    assert (found.before, found.after) == (3, 2)
    kept = found.graph.entities.where("entity_type = 'Drug'").collect()
    assert [(r.label, r.aliases, r.source_chunks) for r in kept] == [("BCR-ABL inhibitor", ["TKI", "tyrosine kinase inhibitor"], ["chunk-1", "chunk-2"])]
    assert found.graph.relations.count() == 1


def test_resolution_by_vectors(spark):
    g = graph(spark, [("red fever", "Condition", "", [], [1.0, 0.0]), ("scarlet fever", "Condition", "", [], [0.99, 0.01]), ("hay fever", "Condition", "", [], [0.0, 1.0])], [])
    assert resolve.resolve(g, alpha=1.0).after == 2
    with pytest.raises(ValueError):
        resolve.resolve(g, threshold=2)


def test_repairs(spark):
    g = graph(
        spark,
        [("Ph+ ALL", "Condition", "", []), ("FISH", "LabTest", "", []), ("ALL protocol", "Procedure", "", []), ("600 mg daily", "Other", "", []), ("imatinib", "Drug", "", [])],
        [("FISH", "diagnosed_by", "Ph+ ALL"), ("ALL protocol", "treats", "Ph+ ALL"), ("imatinib", "dosage_is", "600 mg daily"), ("imatinib", "unknown_predicate", "Ph+ ALL")],
    )
    assert ontology.validation(g, classes(spark), specs(spark)).first()["violations"] > 0
    fixed, actions = ontology.repair(g, specs(spark))
    assert {r.action: r.relations for r in actions.collect()} == {"reversed": 1, "domain_range_relaxed": 2, "invalid_predicate_relaxed": 1}
    assert ontology.validation(fixed, classes(spark), specs(spark)).first()["violations"] == 0
    rows = {(r.subject_id, r.predicate, r.object_id) for r in fixed.relations.collect()}
    assert (eid("ph+ all"), "diagnosed_by", eid("fish")) in rows and (eid("all protocol"), "related_to", eid("ph+ all")) in rows


def test_types_by_vote(spark):
    g = graph(spark, [("imatinib", "Drug", "", []), ("dasatinib", "Drug", "", []), ("600 mg daily", "Other", "", [])], [("imatinib", "dosage_is", "600 mg daily"), ("dasatinib", "dosage_is", "600 mg daily")])
    assert [(r.entity_id, r.entity_type, r.votes) for r in ontology.inferred_types(g, specs(spark)).collect()] == [(eid("600 mg daily"), "DosageRegimen", 2)]


def test_inference(spark):
    found = ontology.inferred_relations(leukemia(spark)).collect()
    assert [(r.subject_id, r.object_id, r.confidence) for r in found] == [(eid("dasatinib"), eid("imatinib"), 0.7)]
    g = leukemia(spark)
    more = build.add_relations(g, ontology.inferred_relations(g).drop("via"))
    assert ontology.inferred_relations(more).count() == 0


def test_quality(spark):
    g = graph(spark, [("imatinib", "Drug", "", ["Glivec", "BCR-ABL inhibitor"]), ("Ph+ ALL", "Condition", "", []), ("untyped note", "Other", "", [])], [("imatinib", "treats", "Ph+ ALL", 0.5), ("imatinib", "related_to", "Ph+ ALL", 1.0)])
    row = ontology.quality(g, classes(spark), specs(spark)).first()
    assert (row.coverage, row.precision, row.redundancy, row.consistency) == (2 / 8, 0.75, 2 / 5, 1.0)


@pytest.mark.parametrize("batch", [7, 5000])
def test_greedy_subgraph_is_the_same_in_pages(spark, batch):
    r = random.Random(5)
    names = [f"n{i:02d}" for i in range(30)]
    edges = [(a, "treats", b) for a, b in (r.sample(names, 2) for _ in range(60))]
    g = graph(spark, [(n, "Drug", "", []) for n in names], edges)
    label = {eid(n): n for n in names}
    for most in (2, 9):
        found = graphs.greedy_subgraph(g, [eid("n00")], depth=2, max_nodes=most, batch=batch)
        near, ball = {"n00"}, {"n00"}
        for _ in range(2):
            near = {x for a, _, b in edges for x in (a, b) if {a, b} & near} - ball
            ball |= near
        nodes, want = {"n00"}, []
        for s, p, o in sorted((s, p, o) for s, p, o in edges if {s, o} <= ball):
            if len(nodes | {s, o}) <= most:
                nodes |= {s, o}
                want.append((s, p, o))
        assert [(x.subject_label, x.predicate, x.object_label) for x in found["relations"]] == want
        assert not want or {label[n] for n in found["nodes"]} == nodes
