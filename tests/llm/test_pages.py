"""Page text, chat formatting, archives, pseudonyms, the pipeline."""

import base64
import datetime
import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel_kg.llm import chat, html, pii, tokens, warc
from kestrel_kg.llm.html_pages import labelled_pages

PAGES = "page_id long, url string, html string"

# --- page text


def test_held_out_pages():
    model = html.default_model()
    good = wrong = missed = 0
    for parts in labelled_pages(150, seed=99):
        page = html.Page("".join(before + text for before, text, _ in parts))
        want = html.labels_of(page, {" ".join(t.split()) for _, t, c in parts if c and t})
        up, down, _ = model.messages(page, model.own(html.features(page)))
        for i, text in enumerate(page.text):
            if text is not None:
                kept = up[i] + down[i] >= 0
                good, wrong, missed = good + (kept and want[i]), wrong + (kept and not want[i]), missed + (not kept and want[i])
    assert good / (good + wrong) > 0.95 and good / (good + missed) > 0.95


def test_marginals_are_exact():
    """Against the sum over all labellings of a small tree."""
    model = html.default_model()
    page = html.Page("<body><nav><a>x</a></nav><article><p>Some words here.</p><div class='ad'>buy</div></article></body>")
    own = model.own(html.features(page))
    up, down, _ = model.messages(page, own)
    n = len(own)
    weight = np.zeros((n, 2))
    for code in range(1 << n):
        states = [code >> i & 1 for i in range(n)]
        log = sum(o * s for o, s in zip(own, states, strict=True)) + sum(model.edges[0 if page.text[i] is None else 1][states[page.parent[i]]][states[i]] for i in range(1, n))
        for i, s in enumerate(states):
            weight[i, s] += np.exp(log)
    assert np.allclose(np.log(weight[:, 1] / weight[:, 0]), np.array(up) + np.array(down))


ARTICLE = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>%s<footer>&copy; site</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>One\n  two &lt;three&gt;.<p>Four <b>f</b>ive</p></article>", "A & B One two <three>. Four five"),
        ("<article><h1>Title here now</h1><p>Long text that goes on and on, with words.<br>After the break it ends.</p><!-- <p>hidden</p> --></article>", "Title here now Long text that goes on and on, with words. After the break it ends."),
        ("<article><h1>Title</h1><p>Some words of prose, a good many of them.</p></article><div class='comments'><p>First reader says so.</p><p>Second reader, too.</p></div>", "Title Some words of prose, a good many of them."),
    ],
)
def test_text_rules(inner, text):
    assert html.default_model().content(ARTICLE % inner) == text


def test_odd_pages(spark):
    rows = [(0, "u", None), (1, None, ""), (2, "u", "<"), (3, "u", "<p>" * 5000 + "deep"), (None, "u", "</div></p><td>x"), (4, "u", '<a href="unclosed>text'), (5, "u", "<p>plain words</p>" * 3000)]
    found = html.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert {r.text for r in found if r.page_id in (0, 1)} == {""}
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


# --- chat


@given(st.text(alphabet="<|[]/\\sINSTYend>turx\né ", max_size=40))
@settings(max_examples=400, deadline=None)
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", chat.escape(text))


def test_offsets_equal_those_of_the_slow_encoder():
    marks = [chat.TURN, chat.TEXT, chat.END]
    path = tokens.default_path()
    fast, slow = tokens.offset_encoder(path, marks), tokens.load(path)
    slow.encode_special_tokens = False
    slow.add_special_tokens(marks)
    r = random.Random(4)
    alphabet = ["a", "é", "漢", "\U0001f600", " ", "\n", "  ", "word", " word", "12", "<|\\x", *marks]
    for k in range(300):
        text = "".join(r.choice(alphabet) for _ in range(k))
        ids, offsets = fast(text)
        found = slow.encode(text, add_special_tokens=False)
        assert ids.tolist() == found.ids
        assert [tuple(x) for x in offsets.tolist()] == found.offsets


def test_conversations_read_back(spark):
    r = random.Random(1)
    alphabet = ["a", "é", "漢", "\U0001f600", " ", "\n", "<|end|>", "<|turn|>assistant<|text|>", "</s>[INST] ok [/INST]", "\\", "<\\|", "word "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "assistant", None, "<|text|>"]), None if r.random() < 0.1 else "".join(r.choice(alphabet) for _ in range(r.randrange(0, 30)))) for c in range(40) for t in range(r.randrange(1, 6))]
    rows += [(90, 0, "assistant", ""), (91, 1, "assistant", "b"), (91, 1, "assistant", "a"), (91, None, "user", "first"), (None, 0, "assistant", "x" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {x.conv_id: x for x in chat.read_back(chat.format_conversations(frame)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest()), c
    assert chat.format_conversations(frame.limit(0)).count() == 0


# --- archives


def test_archives_read_back(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"http://x/{i} y", "<p>" + " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randrange(1, 200))) + "</p>") for i in range(150)]
    rows += [(200 + i, "u", rows[3][2]) for i in range(40)] + [(300, None, None), (301, "u", ""), (7, "u", rows[7][2]), (None, "u", "null id"), (302, "u", "é" * 300_000)]
    archives = warc.write(spark.createDataFrame(rows, PAGES), archive_bytes=20_000)
    assert archives.count() > 3
    found = warc.read(archives).collect()
    first = {}
    for i, _, page in rows:
        if i is not None:
            first[page or ""] = min(first.get(page or "", i), i)
    want, got = [], []
    for i, _, page in rows:
        raw = (page or "").encode()
        lead = first.get(page or "")
        revisit = lead is not None and lead != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None, None if revisit else raw))
    for x in found:
        got.append((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, None if x.payload is None else bytes(x.payload)))
    assert sorted(map(str, got)) == sorted(map(str, want))
    warc.export(archives, str(tmp_path / "files"))
    one = (tmp_path / "files" / sorted(os.listdir(tmp_path / "files"))[0]).read_bytes()
    assert int.from_bytes(one[:4], "little") == warc.SKIPPABLE and all("WARC-Record-ID" in f for f, _ in warc.read_archive(one))
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0


# --- pseudonyms

TEXTS = [
    "card 4041894974608795 x", "card 4041-8949-7460-8795.", "bad 4041894974608796 or 12.5", "call +1 (988) 555-2485 or 212-555-0187 now", "ip 42.144.35.254 and 300.1.1.1 and 1.2.3",
    "ssn 123-45-6789 000-12-3456", "born 1987-03-14, 14.03.1987, 1987-02-30 and 29/02/2000", "a.b.42@mail8.example.com", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000", "+44 2071838750",
]


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_links_and_can_be_undone(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200, None), (201, ""), (202, "no values"), (203, "x " * 50_000 + TEXTS[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_ip", F.lit("clash"))
    hidden = pii.pseudonymise(frame, "key")
    found = {r.doc_id: r for r in hidden.collect()}
    for i, text in enumerate(TEXTS):
        assert found[i].text == found[100 + i].text and re.sub("[0-9]", "9", found[i].text).count("9") >= 1
        if "@" not in text:
            assert re.sub("[0-9]", "9", found[i].text) == re.sub("[0-9]", "9", text) or "ip" in text
    card = re.search("[0-9]{16}", found[0].text).group()
    assert luhn(card) and card != "4041894974608795" and found[1].text == f"card {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}."
    assert found[2].text == TEXTS[2] and found[200].text is None and found[201].text == "" and found[202].text == "no values"
    assert found[203].text.endswith(card + " x")
    iso, dotted = re.findall(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", found[6].text)[0], re.findall(r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})", found[6].text)[0]
    assert iso == dotted[::-1] and datetime.date(*map(int, iso)) and "1987-02-30" in found[6].text
    assert [found[6].n_date, found[5].n_ssn, found[4].n_ip, found[8].n_iban, found[3].n_phone, found[7].n_email] == [3, 1, 1, 2, 2, 1]
    again = {r.doc_id: r.text for r in pii.pseudonymise(hidden.select("doc_id", "text"), "key", decrypt=True).collect()}
    assert all(again[i] == t for i, t in rows)
    assert pii.pseudonymise(frame.limit(0), "key").count() == 0
    plan = hidden._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_permutations_are_bijections(spark):
    numbers = spark.range(1000).select(F.format_string("%03d", "id").alias("d"))
    assert numbers.select(pii.permuted_digits(F.col("d"), "k", "t", False).alias("p")).distinct().count() == 1000
    days = spark.range(36525).select(F.date_format(F.date_add(F.lit("1901-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    made = days.select(pii.date(F.col("d"), "k", False).alias("p"))
    assert made.distinct().count() == 36525 and made.where("p is null or p < '1901-01-01' or p > '2000-12-31'").count() == 0


def test_values_beside_other_digits_are_found(spark):
    def checked(body):
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    long_card = next(c for c in (checked(f"4111111111111{i:03d}12") for i in range(1000)) if not luhn(c[:16]))
    texts = [
        "4111 1111 1111 1111 12/27",
        "4111111111111111 123",
        "4111-1111-1111-1111 123 12/27",
        "3782 822463 10005 4111 1111 1111 1111",
        "4111 1111 1111 1111 5500 0000 0000 0004",
        "4111 1111 1111 1111 12/05/1990",
        "no 12 4111 1111 1111 1111",
        "4222 222 222 222 12/27",
        "ES9121000418450200051332 EUR",
        "ES91 2100 0418 4502 0005 1332 EUR",
        "GB29 NWBK 6016 1331 9268 19 GBP 20",
        " ".join(long_card[i : i + 4] for i in range(0, 19, 4)),
    ]
    hidden = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key")
    found = {r.doc_id: r for r in hidden.collect()}
    for i, text in enumerate(texts):
        assert re.sub("[0-9]", "9", found[i].text) == re.sub("[0-9]", "9", text)
        assert not any(v in found[i].text for v in ("4111 1111 1111", "4111-1111-1111", "4111111111111111", "3782 822463", "5500 0000", "4222 222", "2100 0418", "21000418450200051332", "6016 1331", "1990", long_card[:4] + " " + long_card[4:8])), (text, found[i].text)
    assert [found[i].n_card for i in range(8)] == [1, 1, 1, 2, 2, 1, 1, 1] and found[5].n_date == 1
    assert found[0].text.endswith(" 12/27") and found[1].text.endswith(" 123") and found[6].text.startswith("no 12 ")
    assert re.sub("[^0-9]", "", found[0].text)[:16] == found[1].text[:16] == re.sub("[^0-9]", "", found[2].text)[:16]
    assert [found[i].n_iban for i in (8, 9, 10)] == [1, 1, 1]
    again = {r.doc_id: r.text for r in pii.pseudonymise(hidden.select("doc_id", "text"), "key", decrypt=True).collect()}
    assert all(again[i] == t for i, t in enumerate(texts))


def test_long_local_parts_are_permuted_whole(spark):
    local = "firstnamefirst.middlenamemiddle.lastnamelastname99.x"
    texts = [f"{local}@mail.example.com", f"{local[:-1]}y@mail.example.com", f"b{local[1:]}@mail.example.com", "ab@example.com"]
    hidden = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key")
    found = {r.doc_id: r.text for r in hidden.collect()}
    for i in range(3):
        new = found[i].split("@")[0]
        assert re.sub("[a-z0-9]", "x", found[i]) == re.sub("[a-z0-9]", "x", texts[i]) and "lastname" not in new and not new.endswith("name99.x")
    assert found[0].split("@")[0][-22:] != found[2].split("@")[0][-22:] and len(set(found.values())) == 4
    again = {r.doc_id: r.text for r in pii.pseudonymise(hidden.select("doc_id", "text"), "key", decrypt=True).collect()}
    assert all(again[i] == t for i, t in enumerate(texts))


def test_phones_of_other_plans_are_found(spark):
    texts = ["call +1 (017) 555-7713 now", "+44 20 7946 0958", "+33 1 23 45 67 89, +49 171 1234567", "+44 20 7946 0958 12/05/1990", "+1 415 555 2671", "sum +1 2 3"]
    hidden = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key")
    found = {r.doc_id: r for r in hidden.collect()}
    assert [found[i].n_phone for i in range(6)] == [1, 1, 2, 1, 1, 0] and found[3].n_date == 1
    for i, text in enumerate(texts):
        assert re.sub("[0-9]", "9", found[i].text) == re.sub("[0-9]", "9", text) and (found[i].text == text) == (i == 5)
    assert found[0].text.startswith("call +1 (0") and found[1].text.startswith("+44 ")
    again = {r.doc_id: r.text for r in pii.pseudonymise(hidden.select("doc_id", "text"), "key", decrypt=True).collect()}
    assert all(again[i] == t for i, t in enumerate(texts))


def test_deep_and_broken_pages_take_linear_time():
    import time

    model = html.default_model()
    for page in ("<main>" * 150_000, "<div>" * 90_000 + "</ul>" * 100_000, "<div>" * 90_000 + "<body>" * 90_000, "<ul>" * 80_000 + "<li>a" * 90_000, "<p>x" * 200_000):
        started = time.process_time()
        model.content(page + "the end of the article")
        assert time.process_time() - started < 30  # a walk through the stack for each tag takes many minutes


# --- pseudonyms against an independent computation


def rounds(left, right, a, b, key, kind, sign=1):
    def f(i, value):
        return int(hashlib.sha256(f"{key}|{kind}|{i}|{value}".encode()).hexdigest()[:15], 16)

    for i in range(1, 11):
        if i % 2:
            left = (left + sign * (f(i, right) % a)) % a
        else:
            right = (right + sign * (f(i, left) % b)) % b
    return left, right


def same_century(day, key):
    first = (day.year - 1) // 100 * 100 + 1
    a, b = (51, 709) if first == 9901 else (75, 487) if (first + 99) % 400 == 0 else (92, 397)
    start = datetime.date(first, 1, 1)
    x, y = rounds(*divmod((day - start).days, b), a, b, key, f"date{first}")
    return start + datetime.timedelta(x * b + y)


def other_date(text, key):
    """The pseudonym of a dotted or slashed date, or itself."""
    mark = "/" if "/" in text else "."
    p, q, y = text.split(mark)
    for d, m, american in ((p, q, False), (q, p, True)):
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        if american and (mark == "." or int(q) <= 12):
            return text
        while True:
            day = same_century(day, key)
            if (len(d) > 1 or day.day < 10) and (len(m) > 1 or day.month < 10) and (not american or day.day > 12):
                out = (f"{day.day:0{len(d)}d}", f"{day.month:0{len(m)}d}")
                return mark.join([*(out[::-1] if american else out), f"{day.year:04d}"])
    return text


def test_dates_and_addresses_are_those_of_the_rule(spark):
    r = random.Random(21)
    days = [f"{r.randrange(1, 33):0{r.randrange(1, 3)}d}{mark}{r.randrange(1, 14):0{r.randrange(1, 3)}d}{mark}{r.randrange(0, 10000):04d}" for _ in range(120) for mark in "./"]
    days += [f"{m:02d}/{d:02d}/1987" for m in (1, 5, 12) for d in (13, 28, 31)] + ["1.3.1987", "05/31/1987", "29.02.2000", "29.02.1900", "31.12.9999", "01.01.0001"]
    names = ["John.Smith", "a", "7", "x9.Y8_Z7", "abcdefghijklmnopqrstuvwxyz" * 2, "1" * 40 + "b", "._%"]
    texts = [*days, *(f"{n}@Mail.example.com" for n in names)]
    hidden = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key")
    found = {r.doc_id: r.text for r in hidden.collect()}
    for i, day in enumerate(days):
        assert found[i] == other_date(day, "key"), day
    for i, name in enumerate(names, len(days)):
        new, _, domain = found[i].partition("@")
        shape = lambda x: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)))
        assert shape(new) == shape(name) and domain == "Mail.example.com"
    place = lambda word: sum((ord(c) - 97) * 26 ** (len(word) - 1 - k) for k, c in enumerate(word))
    left, right = rounds(place("john"), place("smith"), 26**4, 26**5, "key", "email")
    letters = "".join(chr(97 + left // 26 ** (3 - k) % 26) for k in range(4)) + "".join(chr(97 + right // 26 ** (4 - k) % 26) for k in range(5))
    assert found[len(days)].split("@")[0].replace(".", "").lower() == letters
    again = {r.doc_id: r.text for r in pii.pseudonymise(hidden.select("doc_id", "text"), "key", decrypt=True).collect()}
    assert [again[i] for i in range(len(texts))] == texts


def test_long_chains_of_labels_and_repeated_rows(spark):
    long = "see x@" + "a." * 200_000
    rows = [(1, long), (2, "mail a.b@" + "c." * 40 + "de"), (3, "12.05.1899"), (3, "12.05.1899"), (None, "12.05.1899")]
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    assert {r.text for r in found if r.doc_id == 1} == {long} and [r.n_email for r in found if r.doc_id == 2] == [1]
    assert len({r.text for r in found if r.doc_id in (3, None)}) == 1 and len(found) == 5


def test_addresses_of_any_length_and_alphabet(spark):
    texts = ["jürgen.müller@x.de", "JÜRGEN.Müller@x.de", "иван.петров@почта.example.com иван.петров@x.example.com", "x" * 70 + "@mail.example.com", "ab.cd@" + "a." * 300 + "com", "é@x.de", "山田@x.de", "first.last@example.com. Next", "see a@b.c, d@e", "łukasz_9@a.b-c.pl"]
    hidden = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key")
    found = {r.doc_id: r for r in hidden.collect()}
    for i in (0, 1, 3, 4, 5, 7, 9):
        new, old = found[i].text.split("@")[0], texts[i].split("@")[0]
        assert found[i].n_email == 1 and len(new) == len(old) and found[i].text.split("@")[1] == texts[i].split("@")[1]
        assert [c.isalpha() for c in new] == [c.isalpha() for c in old] and not any(w in new.lower() for w in re.split(r"[._]", old.lower()) if len(w) > 1)
    assert "иван" not in found[2].text.split(" ")[1] and found[2].n_email == 1
    assert found[7].text.endswith("@example.com. Next") and found[8].text == texts[8]
    assert found[6].text == texts[6]  # of a script whose letters stay
    again = {r.doc_id: r.text for r in pii.pseudonymise(hidden.select("doc_id", "text"), "key", decrypt=True).collect()}
    assert [again[i] for i in range(len(texts))] == texts


def digits(text, key, kind):
    half = len(text) // 2
    left, right = rounds(int(text[:half]), int(text[half:]), 10**half, 10 ** (len(text) - half), key, kind)
    return f"{left:0{half}d}{right:0{len(text) - half}d}"


def test_numbers_are_those_of_the_rule(spark):
    r = random.Random(5)
    check = lambda body: next(str(d) for d in range(10) if luhn(body + str(d)))
    cards = [b + check(b) for b in ("".join(r.choice("0123456789") for _ in range(15)) for _ in range(20))]
    ips = [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(20)]
    ssns = [f"{r.choice([1, 123, 665, 667, 899]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}" for _ in range(20)]
    phones = [f"{r.randrange(200, 1000)}-{r.randrange(1000):03d}-{r.randrange(10000):04d}" for _ in range(20)]
    texts = [*cards, *ips, *ssns, *phones, "DE89370400440532013000"]
    found = {x.doc_id: x.text for x in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    want = []
    for c in cards:
        body = digits(c[:15], "key", "card")
        want.append(body + check(body))
    for x in ips:
        a, b, c, d = map(int, x.split("."))
        left, right = rounds(a * 256 + b, c * 256 + d, 65536, 65536, "key", "ip")
        want.append(f"{left // 256}.{left % 256}.{right // 256}.{right % 256}")
    for x in ssns:
        area, group, serial = map(int, x.split("-"))
        left, right = rounds((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "key", "ssn")
        at = left // 99
        want.append(f"{at + (2 if at >= 665 else 1):03d}-{left % 99 + 1:02d}-{right + 1:04d}")
    for x in phones:
        d = x.replace("-", "")
        n = digits(d[1:3] + d[4:], "key", "phone")
        want.append(f"{d[0]}{n[:2]}-{d[3]}{n[2:4]}-{n[4:]}")
    body = digits("370400440532013000", "key", "iban")
    number = int("".join(str(int(c, 36)) for c in body + "DE00"))
    want.append(f"DE{98 - number % 97:02d}{body}")
    assert [found[i] for i in range(len(texts))] == want
