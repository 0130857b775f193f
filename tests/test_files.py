"""The split reader of graph JSON, containment by fingerprints, the graph store as a data source."""

import json
import random

import pytest
from pyspark.sql import functions as F

from .helpers import graph
from kestrel_kg.operators import evaluate
from kestrel_kg.sources import files, stores


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def large(spark):
    r = random.Random(4)
    word = lambda: r.choice(['plain', 'quo"te', "back\\slash", "brace }", "line\nend", '\n    }', '"relations": [', "é 漢", ""])
    entities = [(f"label {i} {word()}", "Drug", word() + " " + word(), [word()], [0.5, float(i)] if i % 3 else None, [f"c{i}"]) for i in range(400)]
    names = [x[0] for x in entities]
    links = [(names[i % 400], word(), names[(7 * i + 1) % 400], 0.25 * (i % 5), word() or None) for i in range(900)]
    links = [x for x in links if x[0] != x[2]]
    return graph(spark, entities, links)


def test_the_indented_form_is_read_in_splits(spark, large, tmp_path):
    g = large
    path, ranks = str(tmp_path / "graph.json"), g.entities.select("entity_id", (F.col("ord") / 7).alias("pagerank"))
    stores.write_json(g, path, ranks)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        doc = files.split_members(spark, path)
        assert doc is not None and doc[0].rdd.getNumPartitions() > 5
        found, found_ranks = files.read_graph(spark, path)
        some = [rows(found.entities), rows(found.relations.orderBy("relation_index")), rows(found_ranks)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    flat = str(tmp_path / "flat.json")
    with open(path, encoding="utf-8") as f, open(flat, "w", encoding="utf-8") as out:
        json.dump(json.load(f), out)
    assert files.split_members(spark, flat) is None
    whole, whole_ranks = files.read_graph(spark, flat)
    assert some == [rows(whole.entities), rows(whole.relations), rows(whole_ranks)]
    assert len(some[0]) == len(some[2]) == g.entities.count() and len(some[1]) == g.relations.count() > 800


@pytest.mark.parametrize("document", [{"entities": {}, "relations": [], "pagerank": {}}, {"entities": {"a": {"label": "x"}}, "relations": [], "pagerank": {"a": 1e-05}}, {"entities": {}, "relations": [{"subject_id": "a", "predicate": "p", "object_id": "b"}], "pagerank": {}}, {"entities": {"a": {}, "b": {"label": "y"}, "c": {}}, "relations": [{"subject_id": "a", "predicate": "p", "object_id": "b"}], "pagerank": {"a": 0.5, "b": -1}}])
def test_small_documents_are_read_alike(spark, tmp_path, document):
    found = []
    for name, indent in (("a", 2), ("b", None)):
        path = str(tmp_path / f"{name}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(document, f, indent=indent)
        g, ranks = files.read_graph(spark, path)
        found.append([rows(g.entities), rows(g.relations), rows(ranks)])
    assert found[0] == found[1] and len(found[0][0]) == len(document["entities"]) and len(found[0][1]) == len(document["relations"])


def test_containment_is_that_of_a_nested_loop(spark):
    r = random.Random(9)
    words = ["ab", "abc", "c", "the", "of", "xx", "é"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "-"]) for _ in range(n))
    docs = [(i, text(r.randrange(0, 60))) for i in range(80)] + [(100, None), (101, "")]
    passages = []
    for q in range(120):
        t = r.choice(docs[:80])[1]
        a = r.randrange(len(t) + 1)
        passages.append((q, t[a : a + r.randrange(0, 40)] if q % 4 else text(3)))
    passages += [(500, None), (501, "")]
    d, p = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(passages, "query long, passage string")
    found = evaluate.containing(d, p)
    want = {(q, i) for q, x in passages for i, t in docs if x is not None and t is not None and x in t}
    assert {(x.query, x.doc) for x in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_store_is_read_by_ranges_and_written_by_key(spark, large, tmp_path):
    from . import store_double
    from kestrel_kg.sources import property_graph as pg

    options = {"session": "tests.store_double:session", "path": str(tmp_path / "store.db"), "partitions": "5", "batch": "64"}
    ranks = large.entities.select("entity_id", (F.col("ord") / 8).alias("pagerank"))
    pg.write_store(large, ranks=ranks, **options)
    found, found_ranks = pg.read_store(spark, **options)
    plain = lambda g: rows(g.entities.drop("ord"))
    assert plain(found) == plain(large) and rows(found_ranks) == rows(ranks)
    key = lambda df: rows(df.select("subject_id", F.coalesce(F.nullif("predicate", F.lit("")), F.lit("related_to")).alias("p"), "object_id", F.when(F.col("confidence") == 0, 1.0).otherwise(F.col("confidence")).alias("c"), "source_chunk"))
    both_ends = large.entities.select(F.col("entity_id").alias("subject_id"))
    kept = large.relations.where("subject_id <> object_id").join(both_ends, "subject_id", "left_semi").join(both_ends.withColumnRenamed("subject_id", "object_id"), "object_id", "left_semi")
    assert key(found.relations) == key(kept.select("subject_id", "predicate", "object_id", "confidence", "source_chunk").distinct()) and found.relations.count() > 300
    base = store_double.Session(options["path"])
    asked = {tuple(r) for r in base.base.execute("SELECT DISTINCT low, high FROM asked")}
    base.close()
    assert len(asked) == 5  # a query for each range of ids
    before = rows(found.relations.drop("relation_index"))
    pg.write_store(large, **options)  # once more: nothing changes
    again, _ = pg.read_store(spark, **options)
    assert rows(again.relations.drop("relation_index")) == before and plain(again) == plain(large)
    few = stores.Graph(large.entities.limit(3), large.relations.limit(0))
    pg.write_store(few, clear=True, **options)
    left, none = pg.read_store(spark, **options)
    assert (left.entities.count(), left.relations.count(), none.count()) == (3, 0, 0)
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("property_graph").options(**options, kind="faces").load()


def test_a_streamed_graph_is_that_of_one_batch(spark, tmp_path):
    from kestrel_kg.operators import build
    from kestrel_kg.streaming import ingest

    r = random.Random(7)
    name = lambda: f"Thing {r.randrange(12)}"
    payload = lambda: json.dumps({"entities": [{"label": name(), "type": r.choice(["Drug", "Other"]), "aliases": [name()]} for _ in range(2)], "relations": [{"subject": name(), "predicate": "p", "object": name()}]})
    rows = [(i, f"c{i}", payload() if i % 7 else "{bad") for i in range(40)]
    shuffled = r.sample(rows, 40)  # late chunks
    folder, given = str(tmp_path / "graph"), str(tmp_path / "in")
    schema = "chunk_order long, chunk_id string, payload string"
    stream = lambda: spark.readStream.schema(schema).parquet(given)
    for k in range(4):
        again = shuffled[:5] if k == 2 else []  # sent a second time
        spark.createDataFrame(shuffled[10 * k : 10 * k + 10] + again, schema).coalesce(1).write.mode("append").parquet(given)
        ingest.graph_stream(stream(), folder, checkpoint=str(tmp_path / "seen")).awaitTermination(120)
    graph = lambda g: [rows_of(g.entities), rows_of(g.relations)]
    found = graph(ingest.streamed_graph(spark, folder))
    entities, relations, rejected = build.parse_extractions(spark.createDataFrame(rows, schema))
    assert found == graph(build.build_graph(entities, relations, strict=False)) and len(found[1]) > 20
    ingest.graph_stream(stream(), folder, checkpoint=str(tmp_path / "seen")).awaitTermination(120)  # nothing new
    assert spark.read.parquet(f"{folder}/rejected").select("chunk_id").distinct().count() == rejected.count()
    assert graph(ingest.streamed_graph(spark, folder)) == found


def rows_of(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())
