"""Runs of words that recur: counted by hash first, then exactly."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import mining, text


def _texts():
    rng = random.Random(9)
    rows = [(i, rng.choice("xyz"), " ".join(rng.choice("ab cd É ef gh-7".split()) for _ in range(rng.randrange(0, 14)))) for i in range(120)]
    # rows that share an id, rows without an id, section, text or words
    return rows + [(3, "x", "ab cd ef ab cd ef"), (3, "x", "ab, CD ef"), (3, "y", "ab cd ef"), (None, "x", "ab cd ef"), (500, None, "ab cd ef"), (501, None, "AB cd ef"), (502, "x", None), (503, "x", "--")]


def _runs(row, n):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (row[2] or "").lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_runs_are_counted_exactly_whatever_the_filter_lets_through(spark, monkeypatch, bits):
    monkeypatch.setattr(text, "FILTER_BITS", bits)
    monkeypatch.setattr(text, "PACKED", 100)
    rows = [r for r in _texts() if r[0] is not None]
    table = spark.createDataFrame(_texts(), "id long, section string, text string").repartition(3)
    for n, least in ((3, 5), (2, 2), (1, 40)):
        met = {}
        for r in rows:
            for p in _runs(r, n):
                met.setdefault((r[1], p), set()).add(r[0])
        assert {(x["section"], x["phrase"]): x["reports"] for x in text.phrases(table, n, least).collect()} == {k: len(v) for k, v in met.items() if len(v) >= least}
    met = {}
    for r in rows:
        for p in _runs(r, 2) | _runs(r, 3):
            met.setdefault(p, set()).add(r[0])
    often = {p: len(v) for p, v in met.items() if len(v) >= 6}
    want = {p: k for p, k in often.items() if not any(q != p and f" {p} " in f" {q} " and m >= 0.8 * k for q, m in often.items())}
    assert {x["phrase"]: x["reports"] for x in mining.widest_phrases(table, (2, 3), 6, 0.8).collect()} == want


def test_only_phrases_that_recur_move_as_words(spark):
    rare = [(i, "x", " ".join(f"w{i}n{k}" for k in range(50))) for i in range(40)]
    table = spark.createDataFrame([*rare, (90, "x", "one two three"), (91, "x", "one two three")], "id long, section string, text string")
    out = text.phrases(table, 3, 2)
    assert [tuple(r) for r in out.collect()] == [("x", "one two three", 2)]
    # every phrase met the frequent ones by a join before
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
    bits = text.filter_of(table.select(F.explode(F.array(text.words("text"))).alias("w")), text.run_hashes(3, ()), 2, 4)
    assert np.unpackbits(bits).sum() == 1


def test_changes_are_aligned_once_and_their_words_found_by_hash(spark):
    from quillspark.operators import edits

    rows = [(i, f"the Old house w{i} stood here", f"the new house w{i} stood here") for i in range(6)] + [(50, "old OLD [an old tag]", "old"), (51, None, "x"), (52, "house", "Old house")]
    pairs = spark.createDataFrame(rows, "id long, before string, after string")
    runs = spark.sparkContext.accumulator(0)

    def aligned(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    found = edits.changes(edits.aligned(pairs)).mapInArrow(aligned, "id long, at int, `from` string, `to` string")
    got = {(r["from"], r["to"]): (r["count"], r["exposed"]) for r in edits.learned(found, pairs, text.small).collect()}
    assert got[("old", "new")] == (6, 7) and len(found.collect()) * 2 == runs.value
