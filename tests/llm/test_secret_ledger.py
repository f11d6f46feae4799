"""The ledger against Python's regular expressions, and what it scans again."""

import hashlib
import re
import tempfile

import pytest

from quillspark.llm import secret_ledger as sl

KEY = "AKIA" + "Z9" * 8
TEXTS = [
    None,
    "",
    "password=token: abcdefgh12, secret == abc; api_key='x' token=abcdefgh",  # a dropped match uses up its text
    f"é🎉 {KEY} {KEY}x AKIAAKIA{'B' * 8} AKIA{'B' * 11}",
    "f" * 31 + "g" + "0" * 32 + "é" + "a1" * 40,
    f'PassWD" : "{KEY}" Secret:{"ab" * 20} APIKEY=Aa+/_.=-9',
    "-----BEGIN RSA PRIVATE KEY----- https://me:pw@host Bearer abcdefghijklmnop1 eyJa.eyJb.c-_",
    "token=abcdefgh " * 3000,
    KEY,
]


def brute(text):
    text, found = text or "", []
    for rank, r in enumerate(sl.RULES):
        found += [(m.start(), rank, f"{r.kind}:{m.start()}:{m.end()}") for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least]
    found.sort()
    base = [x[2] for x in found if x[1] < len(sl.BASE)]
    n = [sum(x.startswith(r.kind + ":") for x in base) for r in sl.BASE]
    return (*n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(x[2] for x in found))


@pytest.fixture
def ledger(spark):
    return sl.Ledger(spark, f"file://{tempfile.mkdtemp(prefix='spark-')}")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "b", [1], 2) for i, t in rows], "doc_id long, text string, blob string, rules array<int>, start int")


def test_spans_are_those_of_plain_matching(spark, ledger):
    rows = [*enumerate(TEXTS), (None, KEY), (None, None), (8, KEY), (8, "another version " + KEY)]
    docs = docs_of(spark, rows)
    ledger.scan(docs)
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in sl.report(ledger.by_path(docs)).collect())
    assert got == sorted((str(i), *brute(t)) for i, t in rows)


def test_only_what_is_unseen_is_scanned(spark, ledger):
    docs = docs_of(spark, [(1, KEY), (2, KEY), (3, "x")])
    first = {r.blob: sorted(r.todo) for r in ledger.scan(docs, sl.BASE).collect()}
    assert len(first) == 2 and all(v == sorted(r.key for r in sl.BASE) for v in first.values())
    assert ledger.scan(docs, sl.BASE).count() == 0
    # a later version of a path brings one blob; a rule's new version runs over old blobs, alone
    docs = docs.unionByName(docs_of(spark, [(1, "token=abcdefgh")]))
    assert [r.blob for r in ledger.scan(docs, sl.BASE).collect()] == [hashlib.sha256(b"token=abcdefgh").hexdigest()]
    newer = (*sl.BASE[:2], sl.Rule("hex", r"[0-9a-f]+", 0, 8, version=2))
    assert [r.todo for r in ledger.scan(docs, newer).collect()] == [["hex@2"]] * 3
    assert {(r.doc_id, len(r.found)) for r in ledger.by_path(docs, newer).collect()} == {(1, 1), (2, 1), (3, 0)}
    seen = {r.blob: sorted(r.rules) for r in ledger.scanned().collect()}
    assert len(seen) == 3 and all("hex@1" in v and "hex@2" in v for v in seen.values())


def test_a_scan_broken_off_before_it_was_noted_changes_nothing(spark, ledger):
    docs = docs_of(spark, [(1, KEY)])
    ledger.scan(docs)
    twice = ledger.spark.read.schema(sl.FINDINGS).parquet(f"{ledger.folder}/findings")
    twice.collect() and twice.write.mode("append").parquet(f"{ledger.folder}/findings")
    assert [len(r.found) for r in ledger.by_path(docs).collect()] == [1]


def test_an_empty_table_has_no_rows(spark, ledger):
    none = docs_of(spark, [(1, "x")]).where("false")
    assert ledger.scan(none).count() == 0
    assert sl.report(ledger.by_path(none)).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob"]
    assert ledger.by_path(none).count() == 0
