"""Lines of lists as items, wordings that are alike together."""

import random
import re
import statistics

from quillspark.operators import mining, records


def brute(reports, least, similarity):
    lines = []
    for i, text in reports:
        for place, raw in enumerate((text or "").split("\n")):
            line = re.sub("[.,;]+$", "", re.sub(r"^([-–•*]|[0-9]{1,2}[.)]) *", "", raw.strip()).strip()).strip()
            words = frozenset(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()))
            if i is not None and words and len(line.split()) >= 2 and len(line) <= 160 and not re.search(r"[\[\]0-9]", line):
                lines.append((i, place, line, words))
    sets = list({x[3] for x in lines})
    root = {s: n for n, s in enumerate(sets)}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(a & b) >= similarity * len(a | b) - 1e-9:
                    root[a] = root[b] = min(root[a], root[b])
    out = []
    for g in set(root.values()):
        own = [x for x in lines if root[x[3]] == g]
        who = {x[0] for x in own}
        if len(who) >= least:
            item = min({x[2] for x in own}, key=lambda t: (-len({x[0] for x in own if x[2] == t}), t))
            out.append((statistics.median(min(x[1] for x in own if x[0] == i) for i in who), item, len(who), len(who) / len({x[0] for x in lines})))
    return [(item, n, round(share, 9), place, nth) for nth, (place, item, n, share) in enumerate(sorted(out), 1)]


def mined(spark, reports, least, similarity):
    rows = mining.list_items(spark.createDataFrame([(*r, 1) for r in reports], "id long, text string, place int"), least, similarity).collect()
    return [(r.item, r.reports, round(r.share, 9), r.place, r.nth) for r in sorted(rows, key=lambda r: r.nth)]


def test_items_groups_order_and_share_are_those_of_plain_loops(spark):
    reports = [
        (1, "Intro line\n- Advise on play at home.\n- Guidance for parents."),
        (2, "1. Advise on more play at home.\n2. Guidance for parents;"),
        (3, "• Advise on play at home\n• Follow up in 6 months\nof [name] here"),
        (4, "Guidance for parents."),
        (5, None),
        (None, "Guidance for parents."),
        (6, ""),
        (2, "1. Advise on more play at home.\n2. Guidance for parents;"),
    ]
    for least, similarity in ((2, 0.8), (1, 0.5), (4, 0.8)):
        assert mined(spark, reports, least, similarity) == brute(reports, least, similarity)
    rnd = random.Random(9)
    reports = [(i, "\n".join(" ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 6))) for _ in range(3))) for i in range(25)]
    assert mined(spark, reports, 2, 0.7) == brute(reports, 2, 0.7)
    assert mined(spark, [], 1, 0.8) == []


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in records.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert records.components(spark.createDataFrame([], "a long, b long")).count() == 0
