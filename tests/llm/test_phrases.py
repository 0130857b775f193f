"""Phrase mining against a plain count, with small blocks and slices."""

import random
import re
from collections import Counter

import pytest

from kestrel_kg.llm import phrases

DOCS = "doc_id long, text string, lang string"
ODD = [(900, None, "en"), (901, "", None), (902, " \t\n.,;", "en"), (903, "one", None), (904, "Ä" * 3000 + " b c d " + "x" * 2000, "de"), (None, "a b c a b c", None), (None, "a b c a b c", None)]


def plain(rows, least, top, inside=80):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in cand.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    longer[lang, *w[i:j]] = max(longer[lang, *w[i:j]], a)
    out = {}
    for p, a in cand.items():
        lang, *w = p
        if 100 * longer[p] < inside * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))  # noqa: E741
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def made(seed):
    r = random.Random(seed)
    rows = list(ODD)
    for i in range(120):
        lang = r.choice(["en", "en", "en", "de", None])
        words = [r.choice(["a", "b", "c", "the", "of", "New", "York", "é", "z" + str(r.randrange(300))]) for _ in range(r.randrange(0, 120))]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \x0b", "\x1c", " "]) for w in words)
        rows.append((i, text + r.choice(["", "", " in New York city hall", ". the of a b"]) * r.randrange(4), lang))
    rows += [(500 + i, "in the common passage of all, copies. b c", "en") for i in range(60)]
    return rows


@pytest.mark.parametrize(("block", "piece", "ranges"), [(1_000_000, 1 << 20, 4096), (50, 16, 5), (7, 300, 1)])
def test_same_as_a_plain_count(spark, block, piece, ranges):
    rows = made(block)
    df = spark.createDataFrame([(*x, 1, "mine") for x in rows], DOCS + ", n int, rank string")
    found = sorted(tuple(x) for x in phrases.mine(df.repartition(3), least=4, top=70, block_words=block, slice_bytes=piece, ranges=ranges, dealt=100).collect())
    assert found == plain(rows, 4, 70) and len({x[0] for x in found}) == 3


def test_empty_and_rare(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.mine(spark.createDataFrame(ODD, DOCS)).count() == 0


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT cast(x'61FF2062' AS string) AS text, 'en' AS lang FROM range(30)")
    assert [(x.a, x.l, x.r, x.score) for x in phrases.mine(df).collect()] == [(30, 30, 30, 1_000_000)]


def test_slices_keep_the_text():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab \n") for _ in range(r.randrange(80))).encode()
        parts = list(phrases.slices(text, r.randrange(1, 12)))
        assert b"".join(x for x, _ in parts) == text and text.split() == [w for x, _ in parts for w in x.split()]
        assert all(ended == x.endswith(b"\n") for x, ended in parts[:-1]) and parts[-1][1]


def test_products_beyond_64_bits(spark):
    row = spark.range(1).select(phrases.score(*[phrases.F.lit(x).cast("long") for x in (9_000_000_000_000_000_000, 9_000_000_000_000_000_000, 9_100_000_000_000_000_000)]).alias("s")).first()
    assert row.s == 2_000_000 * 9_000_000_000_000_000_000 // 18_100_000_000_000_000_000


def test_packing_and_radix_order():
    r = phrases.np.random.default_rng(2)
    for n in (0, 1, 500):
        a, b = r.integers(0, 1 << 62, n), r.integers(0, 5, n)
        assert [x.tolist() for x in phrases.unpack(phrases.pack(a, b), 2)] == [a.tolist(), b.tolist()]
        assert phrases.radix_order(b, a).tolist() == phrases.np.lexsort((a, b)).tolist()
