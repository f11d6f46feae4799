"""Requests made to fit, against the loop."""

import random

import pytest

from quillspark.operators import requests

NOTE = "\n(more)"


def loop(blocks, most, rest, floor, margin):
    """blocks: block to text."""
    texts, cuts = dict(blocks), {}
    size = lambda: rest + sum(len(t.encode()) for t in texts.values())
    while size() > most:
        left = [b for b in texts if b not in cuts and len(texts[b].encode()) > floor]
        if not left:
            return "refused", dict(blocks), {}
        b = max(left, key=lambda b: (len(texts[b].encode()), b))
        cuts[b] = requests.cut(texts[b], max(len(texts[b].encode()) - (size() - most + margin), floor))
        texts[b] = cuts[b] + NOTE
    return "shrunk" if cuts else "fits", texts, {b: len(c.encode()) for b, c in cuts.items()}


def test_cuts_are_those_of_the_loop_and_sizes_are_within_the_limit(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["ab", "é", "日本", "[name_1]", "\n", "longer words here"])
    asked = {r: {b: "".join(word() + rnd.choice(["", " "]) for _ in range(rnd.choice([0, 3, 20, 90]))) for b in range(rnd.randrange(1, 7))} for r in range(60)}
    asked[60] = {0: "x" * 500, 1: "x" * 500, 2: "y"}
    rows = spark.createDataFrame([(r, b, t, "z") for r, bs in asked.items() for b, t in bs.items()] + [(61, 0, None, "z")], "request long, block long, text string, size string")
    asked[61] = {0: ""}
    outcomes = set()
    for most in (150, 400, 900):
        got = requests.shrunk(rows, most, rest=20, floor=50, margin=30, note=NOTE).collect()
        for r, blocks in asked.items():
            outcome, texts, cuts = loop(blocks, most, 20, 50, 30)
            mine = {x.block: x for x in got if x.request == r}
            assert {x.outcome for x in mine.values()} == {outcome}, (r, most)
            assert {b: x.text for b, x in mine.items()} == texts and {b: x.kept for b, x in mine.items() if x.text.endswith(NOTE)} == cuts
            assert outcome == "refused" or 20 + sum(len(x.text.encode()) for x in mine.values()) <= most
            outcomes.add(outcome)
    assert outcomes == {"fits", "shrunk", "refused"}
    assert requests.shrunk(rows.where("false"), 100).count() == 0


def test_a_cut_goes_through_no_tag_and_no_character():
    assert requests.cut("one two three", 9) == "one two" and requests.cut("line one\nand two", 13) == "line one"
    assert requests.cut("abcdef[name", 20) == "abcdef" and requests.cut("ééé", 5) == "éé" and requests.cut("a b" + "c" * 20, 20) == "a b" + "c" * 17
    with pytest.raises(ValueError, match="no room"):
        requests.shrunk(None, 10, margin=3)
