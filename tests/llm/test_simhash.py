import random

import numpy as np
import xxhash

from quillspark.llm import simhash


def brute_fp(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if (text or "").isascii() else (text or "").encode().lower().decode().split()
    if not words:
        return 0
    sh = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_is_that_of_the_definition():
    for t in (None, "", "  ", "One", "one two", "a b c d e f", "The cat sat on the mat; THE CAT SAT.", "Æble æble x\ty\n z"):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == brute_fp(t)


def test_components_match_all_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = {}
    for i in range(700):
        x = rnd.choice(base)
        for _ in range(rnd.choice((0, 0, 1, 2, 3, 5))):
            x ^= 1 << rnd.randrange(64)
        fps[i] = x
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = brute_components(fps)
    for shard, leaf in ((simhash.SHARD_ROWS, simhash.LOCAL_LEAF), (20, 8)):
        monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
        monkeypatch.setattr(simhash, "LOCAL_LEAF", leaf)
        rows = spark.createDataFrame([(i, signed(v)) for i, v in fps.items()], "doc_id long, fp long")
        links = {(r.a, r.b) for r in simhash.links(rows.select("fp").distinct()).collect()}
        by = {}
        for i, v in fps.items():
            by.setdefault(signed(v), i)
        root = {i: i for i in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in [*links, *((signed(v), signed(v)) for v in fps.values())]:
            x, y = find(by[a]), find(by[b])
            root[max(x, y)] = min(x, y)
        got = {i: find(by[signed(fps[i])]) for i in fps}
        assert got == want


def test_tree_leaves_out_branches_and_loses_no_pair():
    rnd = np.random.default_rng(4)
    base = rnd.integers(-(1 << 63), (1 << 63) - 1, 400, dtype=np.int64)
    fps = np.unique(np.concatenate([base, base[:200] ^ np.int64(1 << 7), base[100:300] ^ np.int64(5 << 40), base[:50] ^ np.int64(7 << 11)]))
    want = {(int(a), int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= 2 or ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 2}
    nodes = simhash.plan(fps[::3], 4)
    got, seen = set(), 0
    for _, at, home in simhash.leaves_of(fps, nodes, 2):
        seen += len(at)
        for q, h in simhash.search(fps[at[home]], fps[at], 2):
            got |= {(int(fps[at[a]]), int(fps[at[home][b]])) for a, b in zip(q, h, strict=True)}
    assert got == want and seen < 9 * len(fps)
    same = np.full(600, 5, np.int64)
    assert simhash.split(same) is None and sum(len(q) for q, _ in simhash.search(same, same[:3], 2)) == 1800


def test_documents(spark):
    texts = [None, "", "one two three four", "One  Two three four", "x", "y" * 5000, "x", "long " * 3000 + "end"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(None, "x", "en")], "doc_id long, text string, fp string")
    got = {(r.doc_id): (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    assert {i: v for i, v in got.items() if i is not None} == {i: (fps[i], want[i]) for i in fps}
    assert got[None] == (fps[4], 4)
    assert simhash.near_duplicates(docs.where("false")).count() == 0
