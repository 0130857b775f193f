import re

import pytest
from pyspark.sql import functions as F

from kestrel_kg.functions import text as tx
from kestrel_kg.functions.similarity import best_ratio, sorted_ratio
from kestrel_kg.operators.chunking import chunk


def values(spark, rows, make):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_labels(spark):
    rows = ["  Acute   LEUKEMIA ,type:B ", "BCR::ABL1", "1.5 mg", "a ;b"]
    assert values(spark, rows, tx.normalize_label) == ["acute leukemia, type: b", "bcr: : abl1", "1. 5 mg", "a; b"]


def test_canonical_text_and_variants(spark):
    assert values(spark, ["BCR-ABL1 fusion", "Ph+ ALL", "ph-positive", "Лёгкое"], tx.canonical_text) == ["bcr abl fusion", "ph+ all", "ph negativepositive", "легкое"]
    assert values(spark, ["tyrosine kinase (TKI) inhibitor"], tx.label_variants) == [["tyrosine kinase tki inhibitor", "tki", "tyrosine kinase inhibitor"]]
    assert values(spark, ["für a_b ё9"], tx.label_tokens) == [["f", "r", "a", "b", "ё9"]]


def test_search_tokens_and_synonyms(spark):
    assert values(spark, ["Straße BCR-ABL"], tx.search_tokens)[0][:4] == ["strasse", "bcr", "abl", "bcrabl"]
    assert values(spark, ["лечение ОЛЛ"], tx.expand)[0].startswith("лечение ОЛЛ олл острый лимфобластный лейкоз")
    assert values(spark, ["nothing here"], tx.expand) == ["nothing here"]


def test_relationship_types_and_ids(spark):
    assert values(spark, ["treats", "is part-of!", "123 x", " ++ "], tx.relationship_type) == ["TREATS", "IS_PART_OF", "REL_123_X", "RELATED_TO"]
    assert values(spark, ["a.md", "nested/c.md", "Clinical Docs/All guideline.md", "!.md"], tx.document_id) == ["a", "nested__c", "clinical_docs__all_guideline", "document"]


def test_words_split_like_python(spark):
    rows = ["a b\x1cc  d e\n", "", "   "]
    assert values(spark, rows, tx.words) == [r.split() for r in rows]


def test_answers_lose_disclaimers(spark):
    assert values(spark, ["Take it. This is not medical advice.\n\n\n\nEnd"], tx.without_disclaimers) == ["Take it.\n\nEnd"]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (5, 5), (5, -1)])
def test_chunk_sizes_are_checked(spark, size, overlap):
    with pytest.raises(ValueError):
        chunk(spark.createDataFrame([("a", "b")], "document_id string, text string"), size, overlap)


def test_windows(spark):
    docs = spark.createDataFrame([("g", " ".join(f"w{i}" for i in range(9))), ("e", " "), ("s", "one two")], "document_id string, text string")
    found = [(r.chunk_id, r.text, r.start_word, r.end_word) for r in chunk(docs, 4, 1).orderBy("chunk_id").collect()]
    assert found == [("g::chunk-0000", "w0 w1 w2 w3", 0, 4), ("g::chunk-0001", "w3 w4 w5 w6", 3, 7), ("g::chunk-0002", "w6 w7 w8", 6, 9), ("s::chunk-0000", "one two", 0, 2)]


def test_windows_cover_every_word(spark):
    text = " ".join(map(str, range(1003)))
    rows = chunk(spark.createDataFrame([("d", text)], "document_id string, text string"), 100, 20).orderBy("chunk_index").collect()
    seen = []
    for r in rows:
        seen += r.text.split()[max(0, len(seen) - r.start_word) :]
    assert seen == text.split()


def test_ratios():
    assert sorted_ratio("acute lymphoblastic leukemia", "lymphoblastic acute leukemia") == 1.0
    assert best_ratio([], ["a"]) == 0.0
    assert 0 < best_ratio(["glioma grade two"], ["glioma grade three"]) < 1
    assert re.match("0.[0-9]", str(round(sorted_ratio("tide", "diet"), 2)))
