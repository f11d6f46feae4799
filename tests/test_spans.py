"""Places of details, numbered tags and the way back, against a plain walk over each text."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import overlap, privacy, spans

TEXTS = [
    None,
    "",
    "see http://a.b/c<d> and www.x.org/?q=me@site.org, me@site.org.",
    "Call (415) 555-0100, id 123-45-6789, card 4111 1111 1111 1111, 10.0.0.1, DE44 5001 0517 5407 3249 31",
    "born 3.9.2004, 12 March 2010, 2004-05-06, since 1998; file 77/1234-5",
    "é🎉 ٠٥٤ 212-555-٠١٩٩ and 1​23​456​7​",
    "already [email_1] and [tag_2] [email] [phone_3] me@site.org",
    "private   12345 ",
    "me@site.org" * 3,
]


def brute(text, rules):
    text = text or ""
    kept = [i for i, c in enumerate(text) if c not in privacy.INVISIBLE]
    fold = str.maketrans(privacy.DIGITS, "0123456789" * 4)
    now = "".join(text[i] for i in kept).translate(fold)
    now = "".join(spans.TAKEN if c == spans.FILL or 0xE100 <= ord(c) <= 0xE1FF else c for c in now)
    out = []
    for kind, rule in rules.items():
        rule = spans._own(rule)
        out += [(kept[m.start()], kept[m.end() - 1] + 1, kind) for m in re.finditer(rule, now)]
        now = re.sub(rule, lambda m: chr(spans.MARK) + spans.FILL * (len(m[0]) - 1), now)
    return [(s, e, k, text[s:e]) for s, e, k in sorted(out)]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", [1]) for i, t in texts], "doc_id long, text string, kind string, spans array<int>")


def test_spans_are_those_of_a_plain_walk_and_never_meet(spark):
    for rules in (privacy.RULES, spans.MASKED):
        got = {r.doc_id: [(s.start, s.end, s.kind, s.value) for s in r.spans] for r in spans.found(docs_of(spark, enumerate(TEXTS)), rules).collect()}
        assert got == {i: brute(t, rules) for i, t in enumerate(TEXTS)}
        assert all(a[1] <= b[0] for found in got.values() for a, b in zip(found, found[1:], strict=False))


def test_every_kind_is_masked_and_comes_back(spark):
    rows = [*enumerate(TEXTS), (None, "me@site.org"), (3, "other version, www.x.org/?q="), (3, "other version, www.x.org/?q=")]
    texts, book = spans.masked(docs_of(spark, rows))
    known = {(r.kind, r.value): r.tag for r in book.collect()}
    want = {(k, v) for _, t in rows for _, _, k, v in brute(t, spans.MASKED)}
    assert set(known) == want and {k for k, _ in want} == set(spans.MASKED) and len(set(known.values())) == len(known)
    for kind in spans.MASKED:
        numbers = sorted(int(tag[len(kind) + 2 : -1]) for (k, _), tag in known.items() if k == kind)
        assert numbers == list(range(1, len(numbers) + 1))
    out = sorted((str(r.doc_id), r.text) for r in texts.collect())
    assert not [1 for _, t in out for _, _, k, v in brute(t, privacy.RULES)]
    back = sorted((str(r.doc_id), r.text) for r in privacy.restored(texts, book).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)


def test_a_detail_without_a_tag_is_an_error(spark, monkeypatch):
    book = spans.book
    monkeypatch.setattr(spans, "book", lambda rows: book(rows).where("kind <> 'url'"))
    with pytest.raises(Exception, match="no tag"):
        spans.masked(docs_of(spark, [(1, "http://a.b/c 10.0.0.1")]))[0].collect()


def test_hidden_keeps_what_is_no_detail_as_it_was(spark):
    got = {r.doc_id: r.text for r in spans.hidden(docs_of(spark, enumerate(TEXTS))).collect()}
    for i, t in enumerate(TEXTS):
        out, at = "", 0
        for s, e, k, _ in brute(t, privacy.RULES):
            out, at = out + (t or "")[at:s] + f"[{k}]", e
        assert got[i] == out + (t or "")[at:]
    assert spans.hidden(docs_of(spark, [(1, "x")]).where("false")).count() == 0
    assert [t.count() for t in spans.masked(docs_of(spark, [(1, "x")]).where("false"))] == [0, 0]


def test_numbers_in_brackets_and_editions_stay(spark):
    cases = {"12 [a 3 [b 4] 5] 6": "# [a 3 [b 4] 5] #", "WISC-5.2 x2 3:4/5, 1,000.": "WISC-5.2 x2 #, #.", "a-b 7 [open 8": "a-b # [open 8", None: "", "é5 - 6": "é# - #"}
    rows = spark.createDataFrame([(t, w) for t, w in cases.items()], "text string, want string")
    assert all(r.got == r.want for r in rows.select("want", overlap.numbers_masked(F.col("text")).alias("got")).collect())


def test_only_lines_that_may_have_a_detail_are_looked_at(spark):
    every = privacy.DIGITS + privacy.INVISIBLE + "0123456789@[" + "".join(map(chr, (0xE000, 0xE001, 0xE100, 0xE1FF)))
    assert all(re.search(privacy.HINT, c) for c in every) and not re.search(privacy.HINT, "abc é ß – “ ש 中 .:/-_\\]")
    finds = [m[0] for t in TEXTS if t for r in spans.MASKED.values() for m in re.finditer(r, t)]
    assert finds and all(re.search(privacy.HINT, x) or "://" in x or "www." in x for x in finds)
    text = "plain line\n\nsee 10.0.0.1​, 123​45\nmore\n" + "w www.x.org\n[email_1]\n"
    rows = spark.createDataFrame([(1, text), (2, "none\nat all"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in rows.select("doc_id", privacy.suspects(F.col("text")).alias("s")).collect()}
    assert got == {1: "\n\nsee 10.0.0.1​, 123​45\n\nw www.x.org\n[email_1]\n", 2: "", 3: ""}
    found = [(s.start, s.end, s.kind, s.value) for s in spans.found(rows, spans.MASKED).where("doc_id = 1").first().spans]
    assert found == brute(text, spans.MASKED) and len(found) == 4


def test_batches_to_python_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    spans.found(docs_of(spark, [(1, "x")]))
    now = int(spark.conf.get(key))
    spark.conf.set(key, before)
    assert now == 2000
