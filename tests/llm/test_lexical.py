"""Ranked search against plain scoring."""

import math
import random
import re
from collections import Counter

from quillspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    total = sum(n for _, _, n in held)
    out = []
    for item_id, text in dict.fromkeys((i, t or "") for i, t in items):
        rows = []
        for doc_id, counted, n in held:
            m = 75 + 25 * n * len(held) // total
            score = 0
            for term, times in Counter(words(text)).items():
                if counted[term]:
                    df = sum(term in c for _, c, _ in held)
                    score += times * math.floor(1000 * math.log((2.0 * len(held) + 2) / (2 * df + 1))) * (1_000_000_000 * counted[term] // (1000 * counted[term] + 12 * m))
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k):
    table = spark.createDataFrame([(i, t, 1, [2], "x") for i, t in docs], "doc_id long, text string, rank int, lengths array<int>, term string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(lexical.build(table), asked, k).collect()), key=str)


ODD = [(1, "Alpha beta, beta-GAMMA"), (1, "alpha"), (2, "alpha"), (3, None), (4, ""), (None, "alpha beta"), (None, None), (5, "É é 日本語 x_y"), (6, "... !!"), (7, "beta " * 70_000), (2, "alpha")]
ASKED = [(1, "alpha BETA beta missing"), (1, "alpha BETA beta missing"), (1, "gamma"), (2, None), (3, "?"), (None, "é 日本語 É"), (4, "alpha " * 9)]


def test_odd_rows_are_ranked_as_by_plain_scoring(spark):
    for k in (1, 3, 20):
        assert searched(spark, ODD, ASKED, k) == brute(ODD, ASKED, k)


def test_many_windows_with_ties(spark):
    rnd = random.Random(3)
    docs = [(rnd.randrange(9_000), " ".join(rnd.choice("a b c d e f g h".split()) for _ in range(rnd.randrange(5)))) for _ in range(9_500)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert lexical.build(table).count() == 2
    items = [(i, " ".join(rnd.choice("a b c d z".split()) for _ in range(3))) for i in range(6)]
    assert searched(spark, docs, items, 20) == brute(docs, items, 20)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 2)
    assert searched(spark, ODD, ASKED, 3) == brute(ODD, ASKED, 3)


def test_windows_end_at_their_postings():
    ids = {b"b": 0, b"a": 1}
    row = lexical._window([7, 9], [3, 1], ids, [0, 1, 1], [2, 1, 1], [2, 1]).to_pylist()[0]
    assert row["terms"] == "a b" and row["held"] == [2, 1]
    assert list(memoryview(row["slots"]).cast("H")) == [0, 1, 0] and list(memoryview(row["freqs"]).cast("i")) == [1, 1, 2]


def test_empty_tables(spark):
    assert searched(spark, [], ASKED, 3) == [] and searched(spark, ODD, [], 3) == []
