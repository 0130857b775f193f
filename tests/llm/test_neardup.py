import random
import re

import pytest

import numpy as np

from kestrel_kg.llm import components, neardup

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def results(spark, rows, **options):
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()}


def family(r, size, words, edits, first=0):
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(size):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append((first + i, " ".join(copy)))
    return out


@pytest.mark.parametrize("block", [4, 200])
def test_families_agree_with_brute_force(spark, block):
    r = random.Random(3)
    rows = family(r, 60, 80, 6) + family(r, 25, 300, 25, 100) + family(r, 15, 12, 2, 200)
    rows += [(300 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(60)) + " " + rows[0][1][:150]) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "One two"), (404, "one TWO"), (405, "one two three"), (406, rows[3][1].upper())]
    assert results(spark, rows, block=block) == expected(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_very_long_text(spark):
    long = " ".join(str(i) for i in range(60_000))
    assert results(spark, [(5, long), (3, long + " end")])[5] == (59_996, 3, False)


def test_hot_keys_are_dealt(spark):
    from pyspark.sql import functions as F

    from kestrel_kg.llm.common import dealt_join

    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("s"))
    unique = rows.select("k").distinct().where("k <> 2500").withColumn("v", F.col("k") * 2)
    found = dealt_join(rows, unique, ["k"])
    assert sorted((r.id, r.v) for r in found.collect()) == [(i, 14 if i < 2000 else 2 * i) for i in range(3000) if i != 2500]
    assert dealt_join(rows.limit(0), unique, ["k"]).count() == 0


def test_joining_links_join_what_all_pairs_join():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64))
        for drop in (0, 10, 40, 60, 90):
            keep = np.sort(r.permutation(base)[: len(base) - drop])
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 1 << 60, drop // 4).astype(np.uint64)])))
    component = [i // 2 for i in range(len(sets))]
    for cut in (None, 25):
        top = list(range(len(sets)))

        def find(c):
            return c if top[c] == c else find(top[c])

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if component[i] == component[j] or ((cut is None or j < cut <= i) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)):
                    top[find(i)] = find(j)
        want = [find(i) for i in range(len(sets))]
        links = neardup.joining_links(sets, component, cut, 75)
        top = list(range(len(sets)))
        for i, j in [*links, *((i, j) for i in range(len(sets)) for j in range(i) if component[i] == component[j])]:
            top[find(i)] = find(j)
        got = [find(i) for i in range(len(sets))]
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def components_of(links):
    top = {x: x for link in links for x in link if link[0] != link[1]}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    return {x: find(x) for x in top}


def test_components_agree_with_union_find(spark):
    r = random.Random(5)
    path = [(i, i + 1) for i in range(60)]
    r.shuffle(path)
    links = [(1000 + r.randrange(150), 1000 + r.randrange(150)) for _ in range(110)] + [(2000, x) for x in range(2001, 2040)] + [(3000, 3000)]
    for case in (path + links, [], [(7, 7)]):
        found = components.connected_components(spark.createDataFrame(case, "a long, b long")).collect()
        assert {x.node: x.component for x in found} == components_of(case) and len(found) == len(components_of(case))


def test_few_links_make_few_tasks_with_many_partitions(spark):
    """Links that are stars, then a chain, with 100 partitions that aren't put together: a step of twelve stages of 100 tasks is too much."""
    many = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    context = spark.sparkContext
    try:
        for case, most in (([(1, x) for x in range(2, 30)], 400), ([(1, 2), (2, 3)], 1200)):
            context.setJobGroup(f"components-{most}", "")
            found = components.connected_components(spark.createDataFrame(case, "a long, b long")).collect()
            assert {x.node: x.component for x in found} == components_of(case)
            tracker = context.statusTracker()
            stages = {s for j in tracker.getJobIdsForGroup(f"components-{most}") for s in tracker.getJobInfo(j).stageIds}
            assert sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s))) <= most
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
