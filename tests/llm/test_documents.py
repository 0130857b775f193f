"""Quality rules, decontamination, line dedup, packing: each against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel_kg.llm import decontaminate, linededup, packing, quality, tokens

DOCS, ITEMS, LABELS = "doc_id long, text string", "item_id long, text string", "doc_id long, quality int, toxic int"
ODD = [(900, None), (901, ""), (902, " \n\t\n "), (903, "one"), (904, "é" * 70_000 + " end"), (None, "no id at all"), (905, "same same"), (905, "same same")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- decontamination


def hits(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        if item is None or not own:
            continue
        k = min(window, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("shard_words", [40, 10_000])
def test_windows_of_items(spark, shard_words):
    r = random.Random(1)
    items = [(i, prose(r, r.choice([3, 9, 13, 20, 40]), 30)) for i in range(12)] + [(50, None), (51, "!?"), (None, "lost item"), (52, "X-ray"), (0, "again the same id but other words entirely")]
    rows = list(ODD)
    for i in range(60):
        text = prose(r, r.randrange(1, 200), 30)
        if i % 2:
            text += " " + (items[r.randrange(12)][1]).upper() + " " + prose(r, r.randrange(1, 400), 30)
        rows.append((i, text))
    found = decontaminate.scan(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("old")), spark.createDataFrame(items, ITEMS), shard_words=shard_words, keep=["doc_id"]).collect()
    want = Counter((i, *map(str, hits(t, items))) for i, t in rows)
    assert Counter((x.doc_id, str(x.n_words), str(x.n_hit), str(x.item_ids), str(x.contaminated)) for x in found) == want


def test_removal(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(0, f"Before, {passage.upper()}! after"), (1, "clean text"), (2, prose(random.Random(2), 900) + " " + " ".join(passage.split()[:13]))], DOCS)
    scanned = decontaminate.scan(docs, spark.createDataFrame([(7, passage)], ITEMS))
    assert {r.doc_id: r.text for r in decontaminate.remove(scanned).collect()}[0] == "Before, ! after"
    assert sorted(r.doc_id for r in decontaminate.remove(scanned, action="documents").collect()) == [1, 2]
    empty = spark.createDataFrame([], ITEMS)
    assert decontaminate.scan(docs, empty).where("n_hit > 0 or contaminated").count() == 0


def test_stated_digest():
    assert decontaminate.digest([10, 9]) == hashlib.sha256(b"10,9").hexdigest()


# --- quality


def base(text):
    words = split(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_counts_and_verdicts(spark):
    r = random.Random(4)
    rows, labels = list(ODD), []
    for i in range(120):
        junk = i % 4 == 0
        text = " | ".join(f"J{r.randrange(400)}#" for _ in range(80)) if junk else prose(r, r.randrange(55, 150)) + "\nline\nline\n" + prose(r, 10)
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 0 if junk else 1, 0))
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.fit(docs, spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], LABELS), bits=12)
    found = quality.score(docs.withColumn("kept", F.lit("clash")), model).collect()
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in found) == Counter((i, *base(t)) for i, t in rows)
    assert all(x.kept == (x.doc_id % 4 != 0) for x in found if x.doc_id is not None and x.doc_id < 120)
    none = quality.fit(docs, spark.createDataFrame([], LABELS), bits=12)
    assert none.threshold == -math.inf
    assert quality.score(spark.createDataFrame([], DOCS), none).count() == 0


def test_threshold_parts_the_labels():
    assert quality.best_threshold([(0.1, False), (0.2, False), (0.6, True), (0.8, True)]) == pytest.approx(0.4)
    assert quality.best_threshold([(0.1, True)]) == -math.inf


# --- line runs


def deleted(rows, least):
    docs = {}
    for i, t in rows:
        if t is not None:
            docs.setdefault((-(1 << 63) if i is None else i, t), [x for x in t.split("\n") if split(x)])
    first, gone = {}, {}
    for place, lines in sorted(docs.items(), key=lambda x: x[0][0]):
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += len(split(lines[e]))
                if words >= least:
                    run = tuple(lines[s : e + 1])
                    if run in first and first[run] != (place, s):
                        gone.setdefault(place, set()).update(range(s, e + 1))
                    first.setdefault(run, (place, s))
    return docs, gone


def test_line_runs(spark):
    r = random.Random(5)
    pool = [prose(r, r.randrange(1, 12)) for _ in range(12)] + [prose(r, 30), prose(r, 31)]
    rows = [(i, "\n".join(r.choice(pool + ["", "  ", prose(r, 8)]) for _ in range(r.randrange(1, 25)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [x for x in ODD if x[0] != 905]
    found = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)), min_words=25).collect()}
    docs, gone = deleted(rows, 25)
    for i, text in rows:
        if text is None:
            assert found[i].text is None and found[i].n_lines == 0
            continue
        place = (-(1 << 63) if i is None else i, text)
        lost = gone.get(place, set())
        assert found[i].n_lines == len(docs[place]) and found[i].n_deleted_lines == len(lost), i
        assert [x for x in found[i].text.split("\n") if split(x)] == [x for k, x in enumerate(docs[place]) if k not in lost]
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


# --- packing


@pytest.mark.parametrize("length", [64, 2048])
def test_pieces_hold_every_token_once(spark, length):
    r = random.Random(6)
    rows = [x for x in ODD if x[0] not in (905, None)] + [(i, prose(r, r.randrange(0, 300))) for i in range(80)] + [(200 + i, "the same words again") for i in range(30)]
    tokenizer = tokens.load(tokens.default_path())
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), length=length, with_ids=True).collect()
    sequences = {}
    parts = {i: [] for i in ids}
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert own == list(p.ids) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        parts[p.doc_id].append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for rows_of, whole in [(x, len(ids[i])) for i, x in parts.items()] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, n in sorted(rows_of):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= length and (at & (at - 1)) == 0
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_hilbert_neighbours():
    side = 8
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    path = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_fast_tokens_are_the_file_s_tokens():
    slow, fast = tokens.load(tokens.default_path()), tokens.encoder(tokens.default_path())
    r = random.Random(7)
    alphabet = list("abcXYZ  \n\t'’\"<|>012éßñçЖ漢字  ̀\U0001f600\r,.;:!") + ["'ll", "<|endoftext|>", "   "]
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 60)))
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids, text
