"""The score of a text against a version that goes unit by unit, and the parts of it."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kestrel_kg.llm import lm

from .test_documents import DOCS, ODD, lower, prose, split


def code(unit):
    return int(lm.hashed(unit + b" ")[2][0]) >> (64 - lm.NEXT_BITS)


def parts(text):
    return (text or "").encode().replace(b"\n", b" \n ").split(b" ") + [lm.END]


class Slow:
    """The model with dictionaries of exact contexts, one decision at a time."""

    def __init__(self, rows):
        self.after, self.units, tri = defaultdict(Counter), Counter(), Counter()
        for i, text in rows:
            if lm.remainder(i) != 2:
                found = parts(text)
                for k, unit in enumerate(found):
                    u1, u2 = (found[k - 1] if k else lm.END), (found[k - 2] if k > 1 else lm.END)
                    self.after[u1,][code(unit)] += 1
                    self.after[u1, u2][code(unit)] += 1
                    self.units[unit] += 1
                x = [256, 256, *(256 if c in b" \t\n\r\x0b\x0c" else c for c in (text or "").encode()), 256, 256]
                tri.update(zip(x, x[1:], x[2:], strict=False))
        self.tri = tri
        self.classes = Counter()
        for unit, n in self.units.items():
            self.classes[code(unit)] += n
        self.n = sum(self.units.values())

    def top(self, key):
        seen = sorted(self.after.get(key, Counter()).items(), key=lambda x: (-x[1], x[0]))
        (a, n), (b, m) = (*seen, (0, 0), (0, 0))[:2]
        return sum(c for _, c in seen), a, n, b, m

    def spell(self, word):
        x = [256, 256, *word, 256]
        total = 0.0
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            two, one = np.zeros(257), np.zeros(257)
            for (p, q, s), n in self.tri.items():
                if q == b:
                    one[s] += n
                    if p == a:
                        two[s] += n
            low, high, first = 0, 257, True
            while high - low > 1:
                middle = 256 if first else (low + high) // 2
                first = False
                z, sure = 0.0, None
                for t in (two, one):
                    ones, both = t[middle:high].sum(), t[low:high].sum()
                    weight = min(both, 20) / 20 * 0.8 if sure is None else 1 - sure
                    sure = weight if sure is None else sure
                    z += weight * max(-lm.LIMIT, min(lm.LIMIT, math.log((ones + 0.05) / (both - ones + 0.05))))
                total -= math.log1p(math.exp(-z if c >= middle else z))
                low, high = (middle, high) if c >= middle else (low, middle)
        return total

    def score(self, text):
        found, total, seen = parts(text), 0.0, {}
        w = np.repeat(lm.START[:, None, :], lm.GATES, 1).copy()
        bend = np.full_like(w, lm.CURVATURE)
        middle = 1 / (1 + np.exp(-np.linspace(-lm.LIMIT, lm.LIMIT, lm.CELLS)))
        hits, tries = np.tile(lm.CELL_WEIGHT * middle, (lm.QUESTIONS, 1)), np.full((lm.QUESTIONS, lm.CELLS), lm.CELL_WEIGHT)
        for a, span in lm.spans(len(found)):
            learnt = []
            for k in range(a, min(a + span, len(found))):
                unit = found[k]
                u1, u2 = (found[k - 1] if k else lm.END), (found[k - 2] if k > 1 else lm.END)
                before = u1 if k else None
                t2, t1 = self.top((u1, u2)), self.top((u1,))
                text_says = seen.get(before, -1)
                level = [(t[0] > 0) + (t[0] >= 3) + (t[0] >= 20) for t in (t2, t1)]
                refused, left, hit = [], [t2[0], t1[0]], False
                for q, (x, there) in enumerate(((t2[1], t2[2]), (text_says, text_says >= 0), (t1[1], t1[2]), (t1[3], t1[4]), (None, True))):
                    if hit or not there or x in refused:
                        continue
                    s = np.zeros(lm.INPUTS)
                    s[-1] = 1
                    y = self.units[unit] > 0
                    if x is not None:
                        refused.append(x)
                        y = x == code(unit)
                        for i, t in enumerate((t2, t1)):
                            n = (t[1] == x) * t[2] + (i == 1 and t[3] == x) * t[4]
                            s[i] = math.log((n + 0.4) / (max(left[i] - n, 0) + 0.4)) if t[0] else 0
                            left[i] -= n
                        s[2] = 0 if text_says < 0 else 1 if text_says == x else -1
                    g = level[0] * 4 + level[1]
                    z = max(-lm.LIMIT, min(lm.LIMIT, float(w[q, g] @ s)))
                    p = 1 / (1 + math.exp(-z))
                    c = int(np.rint((z + lm.LIMIT) * (lm.CELLS - 1) / (2 * lm.LIMIT)))
                    refined = (p + hits[q, c] / tries[q, c]) / 2
                    total += math.log(refined if y else 1 - refined)
                    learnt.append((q, g, s, y - p, p * (1 - p), c, y))
                    hit = x is not None and y
                if hit:
                    rest = self.classes[code(unit)] + 1
                    total += math.log(self.units[unit] / rest) if self.units[unit] else self.spell(unit) - math.log(rest)
                else:
                    total += math.log(self.units[unit] / self.n) if self.units[unit] else self.spell(unit)
                seen[before] = code(unit)
            slope = np.zeros_like(w)
            for q, g, s, miss, bent, c, y in learnt:
                slope[q, g] += s * miss
                bend[q, g] += 2 * s * s * bent
                hits[q, c] += y
                tries[q, c] += 1
            w += slope / bend
        return total / math.log(10)


def fixture():
    r = random.Random(8)
    rows = [(i, prose(r, r.randrange(0, 120), 60).capitalize() + "\n" + prose(r, 5, 60)) for i in range(120)]
    rows += [(300 + i, prose(r, 400, 90) + "\t tab\r\n\n  Two  spaces") for i in range(4)] + [(310 + i, rows[0][1]) for i in range(5)]
    return rows + [(400, "x" * 3000 + " never seen"), (401, "ÉÀ unseen? " * 3)] + [x for x in ODD if x[0] != 904]


def test_scores_are_those_of_the_slow_model(spark):
    rows = fixture()
    slow = Slow(rows)
    words = [[*split(lower(t)), None] for _, t in rows]
    counts = Counter(w for (i, _), own in zip(rows, words, strict=True) for w in own if lm.remainder(i) != 2)
    n, v = sum(counts.values()), len(counts)
    for block, span in ((4 << 20, 16 << 20), (3000, 500)):
        found = sorted(lm.score(spark.createDataFrame(rows, DOCS), block_bytes=block, range_bytes=span).collect(), key=lambda x: (str(x.doc_id), x.n_bytes))
        for x, (i, t), own in zip(found, *zip(*sorted(zip(rows, words, strict=True), key=lambda x: (str(x[0][0]), len((x[0][1] or "").encode()))), strict=True), strict=True):
            assert (x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i, lm.remainder(i) == 2, len(own), sum(counts[w] > 0 for w in own), n)
            assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
            assert x.score == pytest.approx(slow.score(t), rel=1e-9), i
            assert x.bits_per_byte == pytest.approx(-x.score / math.log10(2) / max(len((t or "").encode()), 1))
    assert np.mean([x.bits_per_byte for x in found if x.held_out and x.n_tokens > 40]) < 3
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0


def test_no_training_documents_and_clashing_columns(spark):
    held = [i for i in range(200) if lm.remainder(i) == 2][:5]
    docs = spark.createDataFrame([(i, "some words", 1.0, "x") for i in held], "doc_id long, text string, score double, place string")
    found = lm.score(docs).collect()
    assert len(found) == 5 and all(x.held_out and x.n_known == x.train_tokens == 0 and -300 < x.score < 0 for x in found) and len({x.score for x in found}) == 1


def test_units_are_the_text():
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice(" \n\tab é") for _ in range(r.randrange(0, 12))).encode()
        data = lm.laid([t])
        begins, size, _ = lm.hashed(data)
        assert lm.text([data[a : a + n] for a, n in zip(begins, size, strict=True)]) == t


def test_hot_contexts_are_dealt_and_met_again():
    """Dealing a context by what follows it changes neither counts nor answers."""
    r = random.Random(4)
    documents = [("the " + " the ".join(f"w{r.randrange(50)}" for _ in range(60))).encode() for _ in range(20)]
    own = lm.Block(list(range(20)), documents)
    before, two = lm.contexts(own.hashes, own.sequence, own.lengths, lm.Plan(7))
    hot = {int(lm.Plan(7).keys(own.hashes)[np.bincount(before).argmax()]): 5, int(two[5]): 3}
    values = []
    for plan in (lm.Plan(7), lm.Plan(7, hot)):
        answers = [lm.answered([data], plan.parts_in(r))[0][0] for r, data in own.asks(plan)]
        values.append(lm.scored(own.script(), answers, lm.Speller(np.array([5]), np.array([1])), plan, lm.class_counts(documents))["value"].tolist())
    assert values[0] == pytest.approx(values[1], rel=1e-12)
    parts = lm.tallies(own.hashes, own.sequence, own.lengths, own.trained, lm.Plan(7, hot))
    assert sum(t.n.sum() for t in parts) == 2 * own.trained.sum() and max(np.diff(t.at).max() for t in parts) <= 25


def test_pairs_beyond_64_bits_are_in_order():
    r = np.random.default_rng(0)
    key, after = r.integers(0, 1 << 20, 3000, np.uint64), r.integers(0, 1 << 16, 3000).astype(np.uint64)
    large = key | np.uint64(1 << 60)
    for a, b in zip(lm.in_order(key, after), lm.in_order(large, after), strict=True):
        assert (a == (b & np.uint64((1 << 60) - 1))).all()


def test_counts_above_a_row_are_whole():
    documents = [b"a b " * 500 + b"a c"]
    own = lm.Block([next(i for i in range(9) if lm.remainder(i) != 2)], documents)
    data = [d for _, d in own.asks(lm.Plan(1))]
    for n in (1, 2):
        for answer in lm.answered(data * n, np.zeros(0, np.uint32))[0]:
            (n_unit, _, total, *_), _ = lm.unpressed(answer, 12)
            assert n_unit.max() == 501 * n and total.max() == 501 * (n - 1)


def alike():
    """Two words of one class."""
    seen, r = {}, random.Random(1)
    while True:
        word = "".join(r.choice("abcdefgh") for _ in range(7))
        other = seen.setdefault(code(word.encode()), word)
        if other != word:
            return other, word


def test_words_of_one_class_have_probabilities_of_their_own(spark):
    a, b = alike()
    held = [i for i in range(3000) if lm.remainder(i) == 2]
    train = [(i, a) for i in range(3000, 3100) if lm.remainder(i) != 2] + [(4000 + i, f"w{i}") for i in range(20) if lm.remainder(4000 + i) != 2]
    words = [a, b, *(f"w{i}" for i in range(20)), *(f"new{i}" for i in range(20))]
    found = {x.doc_id: x.score for x in lm.score(spark.createDataFrame(train + list(zip(held, words, strict=False)), DOCS)).collect()}
    scores = [found[i] for i, _ in zip(held, words, strict=False)]
    assert scores[0] > -0.5 and scores[1] < scores[0] - 3
    assert sum(10**x for x in scores) <= 1


def test_many_tiny_texts_take_little_memory():
    import tracemalloc

    documents = [b"a" if i % 2 else b"" for i in range(80_000)]
    own = lm.Block(list(range(80_000)), documents)
    plan = lm.Plan(2)
    answers = [lm.answered([data], plan.parts_in(r))[0][0] for r, data in own.asks(plan)]
    tracemalloc.start()
    found = lm.scored(own.script(), answers, lm.Speller(np.array([5]), np.array([1])), plan, lm.class_counts(documents))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found["value"]) == 80_000 and peak < 200e6


def test_scores_do_not_depend_on_the_session(spark):
    docs = spark.createDataFrame([x for x in fixture() if x[0] is not None][:60], DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        some = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            some.append(sorted((x.doc_id, x.n_bytes, x.score) for x in lm.score(docs).collect()))
        assert some[0] == some[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
