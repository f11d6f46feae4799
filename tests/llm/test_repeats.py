import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import repeats


def brute(rows, length):
    seen, out = set(), {}
    for i, raw in sorted(rows.items()):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_expansion_finds_the_boundaries_of_a_sorted_list(seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 200))) for _ in range(6)]
    data = "".join(rnd.choice(parts) for _ in range(30)).encode() + bytes([0, 255, 0])
    for length in (20, 25, 60, 100, 130):
        order, cut = repeats.expand(np.frombuffer(data, np.uint8), length)
        ring = data * (2 + length // len(data))
        windows = [ring[p : p + length] for p in order.tolist()]
        assert windows == sorted(windows)
        assert cut.tolist() == [k == 0 or windows[k] != windows[k - 1] for k in range(len(windows))]


def text_rows(rnd):
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [say(30), say(60), say(25), "na " * 200, say(18)]
    rows = {0: None, 1: "", 2: "short"}
    for i in range(3, 60):
        rows[i] = " ".join(rnd.choice(shared) if rnd.random() < 0.4 else say(rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 6)))
    rows[60], rows[61] = rows[10], rows[10][5:-7] + " end"
    rows[62] = say(4000) + shared[1] + say(10)
    return rows


@pytest.mark.parametrize("most", [20_000, 3])
def test_digests_match_brute_force(spark, monkeypatch, most):
    rows = text_rows(random.Random(5))
    monkeypatch.setattr(repeats, "REGIONS_MOST", most)
    monkeypatch.setattr(repeats, "HELD_OFTEN", most)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows.items()], "doc_id long, text string, spans int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(docs).collect()}
    assert got == brute({i: (t or "").encode() for i, t in rows.items()}, 100)


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SCAN", 1 << 9)
    rnd = random.Random(9)
    a = bytes(rnd.randrange(97, 123) for _ in range(5000))
    texts = [a, a[300:2500] + b"x" * 30, b"short", a[:120], a[100:700]]
    seen = []
    for data, place, owner, first, more, _ in repeats.regions(texts):
        for p, o, f, m in zip(place.tolist(), owner.tolist(), first.tolist(), more.tolist(), strict=True):
            assert texts[o][f : f + m + 100] == data[p : p + m + 100]
            seen += [(o, f + k) for k in range(m + 1)]
    assert sorted(seen) == [(o, k) for o, t in enumerate(texts) for k in range(len(t) - 99)]


def test_repeated_ids_nulls_and_empty_tables(spark):
    t = "".join(chr(97 + k * k % 23) + str(k) for k in range(80))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "z" + t), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 99, r.n_bytes, r.n_removed) for r in repeats.digests(docs).collect()))
    assert got == [(1, len(t), 0), (1, len(t), 0), (2, 0, 0), (2, len(t) + 1, len(t)), (99, len(t), len(t))]
    assert repeats.digests(docs.where("false")).count() == 0


def test_texts_stay_whole_characters(spark):
    t = "é" * 120
    docs = spark.createDataFrame([(1, "a" + t), (2, "b" + t + "ü")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert got[2].startswith("b") and got[2].endswith("ü") and len(got[2]) < 6
