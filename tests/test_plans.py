"""The forms that are meant for large tables: results against plain versions, and what their plans read, pair or shuffle."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrel_kg.functions import similarity as sim
from kestrel_kg.functions import text as tx
from kestrel_kg.operators import evaluate, graphs, resolve, retrieve
from kestrel_kg.plans import queries

from .helpers import leukemia

ENTITY = "entity_id string, ord long, label string, entity_type string, description string, aliases array<string>, source_chunks array<string>, embedding array<double>, metadata string"


def plain_ranks(names, edges, steps, alpha):
    index = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for s, d in set(edges):
        m[index[d], index[s]] = 1
    out, r, moved = m.sum(0), np.full(len(names), 1 / len(names)), math.inf
    for _ in range(steps):
        new = alpha * (m @ np.divide(r, out, out=np.zeros_like(r), where=out > 0) + r[out == 0].sum() / len(names)) + (1 - alpha) / len(names)
        r, moved = new, np.abs(new - r).sum()
    return dict(zip(names, r, strict=True)), moved


def some_graph(spark, n=40):
    r = random.Random(8)
    names = [f"n{i:02}" for i in range(n)]
    edges = sorted({(r.choice(names[: n // 2]), r.choice(names)) for _ in range(2 * n)})
    return names, edges, spark.createDataFrame([(x,) for x in names], "node string"), spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize(("steps", "alpha"), [(1, 0.85), (4, 0.5), (7, 0.85)])
def test_pagerank_after_so_many_steps(spark, steps, alpha):
    names, edges, nodes, links = some_graph(spark)
    found = {r.node: r.pagerank for r in graphs.pagerank(nodes, links, fixed_steps=steps, alpha=alpha).collect()}
    assert found == pytest.approx(plain_ranks(names, edges, steps, alpha)[0], abs=1e-12)


def test_pagerank_stops_at_the_first_step_under_the_tolerance(spark):
    names, edges, nodes, links = some_graph(spark)
    tolerance = 3e-4
    step = next(k for k in range(1, 100) if plain_ranks(names, edges, k, 0.85)[1] < len(names) * tolerance)
    found = {r.node: r.pagerank for r in graphs.pagerank(nodes, links, tolerance=tolerance).collect()}
    assert found == pytest.approx(plain_ranks(names, edges, step, 0.85)[0], abs=1e-12)
    with pytest.raises(RuntimeError):
        graphs.pagerank(nodes, links, tolerance=1e-30, max_steps=3)


def test_pagerank_reads_links_without_a_shuffle(spark):
    *_, nodes, links = some_graph(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ranks = graphs.Ranks(nodes, links, 40, 0.85)
        plan = graphs.spread(ranks.links, nodes.select("node", F.lit(1.0).alias("value")), 0.85)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan[plan.index("== Physical Plan ==") :]
    # one shuffle for the values, one for what nodes get, none between the links' scan and the join
    assert physical.count("Exchange hashpartitioning") == 2
    assert "Bucketed: true" in physical and "Exchange hashpartitioning(src" in physical and physical.index("Bucketed: true") < physical.rindex("Exchange hashpartitioning(src")


def test_components_in_logarithmic_rounds(spark):
    n = 5000
    order = random.Random(3).sample(range(n), n)
    path = spark.createDataFrame([(f"n{a:05}", f"n{b:05}") for a, b in zip(order, order[1:], strict=False)], "a string, b string")
    found, rounds = graphs.contracted(path)
    assert found.agg(F.count("*"), F.countDistinct("node"), F.min("component"), F.max("component")).first() == (n, n, "n00000", "n00000")
    assert 0 < rounds <= 2 * math.log2(n)
    assert graphs.contracted(path.where("a > b"))[0].count() > 0 and graphs.contracted(path.limit(0))[1] == 0


def part_entities(spark, labels, kinds=("Part",), vectors=None):
    rows = [(f"e{i:04}", i, x, kinds[i % len(kinds)], "", [], [], vectors(i) if vectors else None, "{}") for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, ENTITY)


def made_labels(seed, n):
    r = random.Random(seed)
    parts = (["brand"], [str(i) for i in range(1, 26)], ["hot", "cold", "red", "old", "small"], ["plate", "ring", "rod", "gear", "widget", "Ringe", "gears"])
    return sorted({" ".join(r.sample([r.choice(p) for p in parts], 4)) + r.choice(["", "", " (mk 2)", " ё", " 😀x"]) for _ in range(n)})


@pytest.mark.parametrize(("floor", "cell"), [(0.85, 2000), (0.7, 40)])
def test_similar_pairs_are_all_found(spark, floor, cell):
    entities = part_entities(spark, made_labels(4, 160))
    every = resolve.with_similarity(resolve.blocking_pairs(entities), entities).where(F.col("lexical") >= floor)
    want = {(r.left_id, r.right_id): r.lexical for r in every.collect()}
    rows = resolve.similar_variants(entities, floor, cell)
    found = {(r.left_id, r.right_id): r.lexical for r in rows.withColumn("lexical", sim.ratio_of_sorted("left_text", "right_text")).groupBy("left_id", "right_id").agg(F.max("lexical").alias("lexical")).collect() if r.lexical >= floor}
    assert found == pytest.approx(want) and len(want) > 100
    assert rows.count() == rows.distinct().count()


def test_similar_pairs_compare_few_candidates(spark):
    labels = [f"brand {i} {a} {b}" for i in range(1, 26) for a in ("cold", "hot", "old", "red", "small", "large", "blue", "new") for b in ("bolt", "gear", "plate", "ring", "rod", "widget", "gizmo", "pipe")]
    entities = part_entities(spark, labels)
    assert resolve.blocking_pairs(entities).count() == len(labels) * (len(labels) - 1) // 2
    assert resolve.similar_variants(entities, 0.85).count() < 0.05 * len(labels) * (len(labels) - 1) / 2


def test_matching_pairs_with_vectors_and_types(spark):
    vectors = lambda i: [float(i % 3 + 1), float(i % 5)] if i % 4 else None
    entities = part_entities(spark, made_labels(9, 70), ("Part", "Other", "Widget"), vectors)
    for alpha, threshold in ((0.6, 0.85), (0.1, 0.85), (0.9, 0.95), (1.0, 0.9)):
        every = resolve.with_similarity(resolve.blocking_pairs(entities), entities, alpha).where(F.col("hybrid") >= threshold)
        want, found = ({(r.left_id, r.right_id): (r.lexical, r.semantic, r.hybrid) for r in x.collect()} for x in (every, resolve.matching_pairs(entities, alpha, threshold)))
        assert set(found) == set(want) and all(found[k] == pytest.approx(want[k]) for k in want)


def test_dealt_pairs_are_all_pairs_once(spark):
    rows = spark.range(90).select(F.col("id").alias("i"), F.lit("hot").alias("k"))
    found = resolve.dealt_pairs(rows, ["k"], "i", F.lit(True), 7).select("l.i", "r.i").collect()
    assert len(found) == 90 * 89 // 2 == len(set(found))


WORDS = ["alpha", "beta", "gamma", "delta", "rare", "rarer", "x1", "x2"]


def test_pruned_bm25_is_exact_and_reads_less(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choices(WORDS, [40, 30, 20, 10, 1, 0.3, 0.1, 0.1], k=r.randrange(1, 40)))) for i in range(900)]
    docs += [(1000 + i, "rarer rare x1 x2") for i in range(12)]
    index = retrieve.build_index(spark.createDataFrame(docs, "doc long, text string"))
    asked = spark.createDataFrame([(0, "rarer rare alpha"), (1, "alpha"), (2, "x1 x1 beta x2"), (3, "unknown"), (4, "gamma delta rare")], "query long, question string")
    scores, read = retrieve.bm25_top(asked, retrieve.impact_index(index, width=16), 10)
    best = lambda df: {q: sorted(((-x.score, x.doc) for x in rows))[:10] for q, rows in group(df.collect()).items()}
    assert best(scores) == best(retrieve.bm25(asked, index))
    told = {x.query: (x.read, x.postings) for x in read.collect()}
    assert told[0][0] < 0.5 * told[0][1] and set(told) == {0, 1, 2, 4}


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query, []).append(r)
    return out


def test_nearest_and_places_by_cosine(spark, monkeypatch):
    monkeypatch.setattr(retrieve.question_blocks, "__defaults__", (3,))
    r = random.Random(6)
    vectors = [(i, [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(200)] + [(200, None), (201, [1.0, None, 2.0]), (202, [1.0]), (203, [0.0, 0.0, 0.0])]
    asked = [(q, [float(r.randrange(-2, 3)) for _ in range(3)]) for q in range(7)] + [(7, None), (8, [2.0])]
    v, a = spark.createDataFrame(vectors, "at long, embedding array<double>"), spark.createDataFrame(asked, "query long, vector array<double>")
    table = {(r.query, r.at): r.score for r in a.crossJoin(v).select("query", "at", sim.cosine(F.col("vector"), F.col("embedding")).alias("score")).collect()}
    order = {q: sorted(range(204), key=lambda i: (-table[q, i], i)) for q in range(9)}
    found = group(retrieve.nearest(v.repartition(3), a, 11).collect())
    for q in range(9):
        assert [x.at for x in sorted(found[q], key=lambda x: (-x.score, x.at))] == order[q][:11]
        assert all(x.score == table[q, x.at] for x in found[q])
    some = [(q, i) for q in range(9) for i in r.sample(range(204), 20)]
    got = retrieve.places_by_cosine(v.repartition(3), a, spark.createDataFrame(some, "query long, at long")).collect()
    assert {(x.query, x.at): x["rank"] for x in got} == {(q, i): order[q].index(i) + 1 for q, i in some}


def test_fusion_pairs_no_question_with_all_entities(spark):
    labels = made_labels(5, 90)
    g = resolve.Graph(part_entities(spark, labels), spark.createDataFrame([(0, "e0001", "p", "e0002", 1.0, None, "{}")], "relation_index long, subject_id string, predicate string, object_id string, confidence double, source_chunk string, metadata string"))
    retriever = retrieve.Retriever.of(g)
    asked = spark.createDataFrame([(0, "cold ring"), (1, "nothing of this"), (2, "red widget 7")], "query long, question string")
    names = {r.doc: r.at for r in retriever.order.collect()}
    found = retriever.retrieve(asked, "hybrid_rrf", 6)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    table = {(r.query, r.at): r.score for r in retriever.question_vectors(asked).crossJoin(retriever.vectors).select("query", "at", sim.cosine(F.col("vector"), F.col("embedding")).alias("score")).collect()}
    words = {(r.query, r.doc): r.score for r in retriever.matches(asked).collect()}
    ranks = {r.doc: r.place for r in retriever.places.collect()}
    for q in range(3):
        by = lambda score: {d: i + 1 for i, d in enumerate(sorted(names, key=lambda d: (-score(d), names[d])))}  # noqa: B023, E731
        lists = by(lambda d: table[q, names[d]]), by(lambda d: words.get((q, d), 0.0)), ranks  # noqa: B023
        want = sorted(names, key=lambda d: (-sum(1 / (60 + x[d]) for x in lists), min(x[d] for x in lists), lists[0][d], d))[:6]  # noqa: B023
        rows = sorted((r for r in found.collect() if r.query == q), key=lambda r: r["rank"])
        assert [r.doc for r in rows] == want


def vector_entities(spark, vectors):
    rows = [(f"e{i:04}", i, f"e{i}", kind, "", [], [], v, "{}") for i, (kind, v) in enumerate(vectors)]
    return spark.createDataFrame(rows, ENTITY)


def test_similar_vectors_are_those_of_all_pairs_of_a_type(spark):
    r = np.random.default_rng(3)
    vectors = [("ABC"[i % 3], [float(x) for x in r.normal(size=4)]) for i in range(90)] + [("A", [1.0, 0.0, 0.0, 0.0])] * 20
    vectors += [("A", None), ("A", []), ("A", [0.0] * 4), ("A", [1.0, None, 0.0, 0.0]), ("A", [1.0, 0.0]), ("A", [2.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), ("B", [float("nan")] * 4)]
    entities = vector_entities(spark, vectors)
    every = resolve.with_similarity(resolve.label_pairs(entities), entities, 1.0, lexical=False).where("hybrid >= 0.6")
    want = {(x.left_id, x.right_id): x.semantic for x in every.collect()}
    for block in (7, 4096):
        found = resolve.similar_vectors(entities, 0.6, block=block).collect()
        assert len(found) == len(want) and {(x.left_id, x.right_id): x.semantic for x in found} == want
        links = resolve.similar_vectors(entities, 0.6, joining=True, block=block)
        assert {(x.left_id, x.right_id): x.semantic for x in links.collect()}.items() <= want.items()
        nodes = entities.select(F.col("entity_id").alias("node"))
        ends = lambda rows: rows.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))
        assert graphs.components(nodes, ends(links)).exceptAll(graphs.components(nodes, ends(every))).count() == 0
    with pytest.raises(ValueError):
        resolve.similar_vectors(entities, 0.0)


def test_similar_vectors_shuffle_vectors_and_no_pairs(spark):
    entities = vector_entities(spark, [("A", [1.0, i / 10]) for i in range(60)])
    plan = resolve.similar_vectors(entities, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FlatMapGroupsInArrow" in plan
    # copies are joined by as many links as it takes, not by all their pairs
    same = vector_entities(spark, [("A", [1.0, 2.0])] * 60)
    assert resolve.similar_vectors(same, 0.9, joining=True).count() == 59


def test_scanned_documents_score_like_indexed_ones(spark):
    r = random.Random(4)
    word = lambda: r.choice("abcdefghijklmnop") * r.randint(1, 2)
    texts = [(i, f"L{i % 9}", " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(1200)] + [(1200, "x", None), (1201, "y", "")]
    texts += [(1300 + i, f"l{i % 3}", "aa b c zz") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc long, label string, text string")
    asked = spark.createDataFrame([(1, "aa b b c"), (2, "ZZ pp"), (3, "unknown"), (4, ""), (5, None), (6, "a d g kk a")], "query long, question string")
    scores = retrieve.bm25(asked, retrieve.build_index(docs)).withColumn("score", F.round("score", 3))
    want = {(x.query, x["rank"], x.doc, x.score) for x in retrieve.ranked(scores, docs, 7).collect()}
    found = retrieve.bm25_scan(asked, docs.repartition(3), 7, digits=3)
    assert {(x.query, x["rank"], x.doc, x.score) for x in retrieve.ranked(found, docs, 7).collect()} == want
    assert found.count() <= 3 * 3 * 7  # a task passes on its best alone
    assert retrieve.bm25_scan(asked.limit(0), docs, 7).count() == 0


def test_half_up_rounds_as_spark_does(spark):
    values = [0.1234565, 2.5000005, 1.0000015, 7.1234565000001, 12.3456784999999, 0.0, 3e-7, 5e-7]
    spark_ = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert retrieve.half_up(np.array([values]), 6)[0].tolist() == spark_


def test_counted_pairs_are_those_of_a_join(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(i % 3) if i % 11 else None, [float(x) for x in r.normal(size=4)]) for i in range(120)]
    rows += [(200, 1, None), (201, 1, []), (202, 1, [0.0] * 4), (203, 1, [1.0, None, 0.0, 0.0]), (204, 2, [1.0, 0.0]), (205, 2, [3.0, 4.0]), (206, 2, [0.6, 0.0]), (None, 2, [1.0, 0.0])]
    rows += [(300, 0, [1.0, 0.0, 0.0, 0.0]), (301, 0, [0.2, math.sqrt(0.96), 0.0, 0.0]), (302, 1, [0.5, math.sqrt(0.75), 0.0, 0.0]), (303, 0, [float("nan")] * 4)]
    table = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    asked = table.where("id % 4 = 0")
    left, right = (table_.select(*[F.col(c).alias(f"{end}_{c}") for c in table.columns]) for end, table_ in (("l", asked), ("r", table)))
    semantic = F.round(sim.semantic_similarity(F.col("l_embedding"), F.col("r_embedding"), F.lit(0.0)), 9)
    pairs = right.join(left, F.col("l_id") != F.col("r_id")).select(semantic.alias("semantic"), (F.col("l_label") == F.col("r_label")).alias("actual"))
    cuts = [0.2, 0.5, 0.6, 1.0]
    found = evaluate.scored_pairs(table.repartition(3), asked, cuts)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for cut in cuts:
        test = F.col("semantic") >= cut
        assert evaluate.confusion(found.withColumn("predicted", test)).collect() == evaluate.confusion(pairs.withColumn("predicted", test)).collect()
    assert evaluate.confusion(evaluate.scored_pairs(table, asked.limit(0), cuts).withColumn("predicted", F.lit(True))).first().tp == 0


def test_a_large_group_is_merged_in_proportion_to_its_members(spark):
    n = 3000
    rows = [(f"e{i:05}", i, f"Name {i // 2}", "A", "", [f"alias {i % 7}", ""], ["c1", f"c{i % 3}"], None, "{}") for i in range(n)]
    entities = spark.createDataFrame(rows, ENTITY)
    mapping = entities.select("entity_id", F.lit("e00000").alias("component"), F.lit("e00000").alias("canonical_id"))
    found = resolve.merged_entities(resolve.Graph(entities, None), mapping)
    row = found.first()
    assert row.aliases[:4] == ["alias 0", "alias 1", "Name 1", "alias 2"] and len(row.aliases) == n // 2 - 1 + 7
    assert row.source_chunks == ["c1", "c0", "c2"]


@pytest.mark.parametrize("digits", [{}, {"lexical": 6}])
def test_places_by_words_keep_matches_in_their_tasks(spark, monkeypatch, digits):
    """Questions of one common word match most entities; no row is made for a match, and places are those of a full ranking."""
    monkeypatch.setattr(retrieve, "CELLS", 64)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], rng.integers(1, 6))) for _ in range(300)]
    documents = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc long, label string, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta gamma beta"), (3, "omega"), (4, "...")], "query long, question string")
    scores = retrieve.bm25(asked, retrieve.build_index(documents.select("doc", "text")))
    scores = scores.withColumn("score", F.round("score", digits["lexical"])) if digits else scores
    known = {(r.query, r.doc): r.score for r in scores.collect()}
    order = {q: sorted(range(300), key=lambda d: (-known.get((q, d), 0.0), d)) for q in range(1, 5)}
    tokens = asked.select("query", tx.search_tokens(F.col("question")).alias("tokens")).where("size(tokens) > 0")
    blocks = list(retrieve.asked_blocks(tokens, documents, digits.get("lexical")))
    heads = {(r.query, r.at) for r in retrieve.heads_by_words(blocks, asked, 7).collect()}
    assert heads == {(q, d) for q in (1, 2) for d in order[q][:7]}
    candidates = spark.createDataFrame([(q, d) for q in range(1, 5) for d in (0, 3, 150, 299, order[1][0])], "query long, at long").distinct()
    found = {(r.query, r.at): r["rank"] for r in retrieve.places_by_words(blocks, candidates).collect()}
    assert found == {(q, d): order[q].index(d) + 1 for q, d in found} and len(found) == candidates.count()


def test_fusion_makes_no_table_of_matches(spark, monkeypatch):
    monkeypatch.setattr(retrieve.Retriever, "matches", lambda *_: pytest.fail("a row for each match"))
    found = retrieve.Retriever.of(leukemia(spark), embed=lambda text: F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    asked = spark.createDataFrame([(1, "leukemia treatment"), (2, "")], "query long, question string")
    assert found.retrieve(asked, "hybrid_rrf", 3).groupBy("query").count().count() == 2


def test_nearest_scores_few_pairs_at_a_time(spark, monkeypatch):
    """Batches of 10,000 entities aren't scored at once for a block of questions."""
    sizes = []
    plain = retrieve.Heads.add
    monkeypatch.setattr(retrieve.Heads, "add", lambda self, new, own: (sizes.append(new.size), plain(self, new, own))[1])
    monkeypatch.setattr(retrieve, "question_blocks", lambda asked: iter([asked.toArrow().combine_chunks()]))

    class Vectors:
        """Runs a task's function here."""

        select = lambda self, *_: self

        def mapInArrow(self, run, schema):
            at = pa.array(range(5000), pa.int64())
            batch = pa.RecordBatch.from_arrays([at, pa.array([[1.0, float(i)] for i in range(5000)])], names=["at", "embedding"])
            return spark.createDataFrame([r for out in run(iter([batch])) for r in out.to_pylist()], schema)

    asked = spark.range(500).select(F.col("id").alias("query"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    found = retrieve.nearest(Vectors(), asked, 2)
    assert {r.at for r in found.collect()} == {0, 1} and sum(sizes) == 500 * 5000 and max(sizes) <= retrieve.CELLS


def test_many_questions_are_fixed(spark):
    """Rules that rewrite constraints over the union of passages and names failed with "key not found: p_name"."""
    asked = queries.many_questions(spark, "/root/testdata/sf0.001")
    assert "Union" not in asked._jdf.queryExecution().optimizedPlan().toString() and asked.count() > 0
