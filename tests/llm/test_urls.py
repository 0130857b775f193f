"""URL rules and vocabulary against a plain version."""

import random
import re

import pytest

from kestrel_kg.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("Twice.net", "/", "allow"), ("twice.net", "/", "block"), ("a.twice.net", "", "allow")]
ODD = [None, "", "no mark casino", "://", "http://", "https://ORG/", "https://xorg/", "http://example.org/es", "http://a.Example.ORG/es/?/en/1", "http://example.org#/en/1", "http://example.org:80/en/1", "http://a://b/c", "http://a.com/de", "http://a.com/de/", "http://b.twice.net/x", "http://a.twice.net/x", "http://épills.com/cheap", "http://x.io/" + "cheap" * 30_000 + "/pills", "http://x.io/" + "a/" * 50_000 + "cheap-pills", "http://x.io/CHEAP_Pills", "http://x.io/cheap.cheap", "http://spam-farm.io", "http://spamfarm.io"]


def plain(url):
    text = url or ""
    rest = re.split(r"[?#]", text.split("://", 1)[1], maxsplit=1)[0] if "://" in text else ""
    host, slash, path = rest.partition("/")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host, path = low(host), slash + path
    fits = [(len(h) + len(p), v, low(h) + p) for h, p, v in RULES if (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    found = set(re.split(r"[^a-z0-9\u0080-\U0010ffff]+", low(text)))
    weight = sum(w for t, w in urls.weights().items() if t in found)
    return (host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "block" if weight >= 2 else "allow", weight)


def test_rules_and_terms(spark):
    r = random.Random(5)
    part = lambda: r.choice(["cheap", "pills", "casino", "org", "example", "com", "fr", "de", "es", "en", "1", "x", "Spam", "farm", "é"])
    rows = [*ODD, *ODD[:5]] + ["http://" + "".join(part() + r.choice([".", "-", "/", "/", "", "?", "#", "_"]) for _ in range(r.randrange(1, 9))) for _ in range(600)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(rows)], "page_id long, url string, host string")
    found = {x.page_id: (x.host, x.path, x.rule, x.verdict, x.weight) for x in urls.judge(pages, RULES).collect()}
    assert found == {i: plain(u) for i, u in enumerate(rows)}
    assert len({v[3] for v in found.values()}) == 2


def test_empty_table_columns_and_bad_rules(spark):
    none = spark.createDataFrame([], "url string, verdict string, other int")
    assert urls.judge(none).columns == ["url", "other", "host", "path", "rule", "verdict", "weight", "terms"]
    assert urls.judge(none).count() == 0
    for bad in ({"rules": [("a", "/", "maybe")]}, {"terms": {}}, {"terms": {"": 1}}):
        with pytest.raises(ValueError):
            urls.judge(none, **bad)


def test_invalid_utf8(spark):
    pages = spark.sql("SELECT cast(x'687474703A2F2F66F2612F6368656170F22D70696C6C73' AS string) AS url")
    row = urls.judge(pages).first()
    assert row.path == "/cheap\ufffd-pills" and row.terms == ["pills"]
