import hashlib
import itertools
import math
import random
import struct

import numpy as np
import pytest

from quillspark.llm import bpe, decontam, langid, licenses, media, quality, toxicity, warc

TEXTS = [None, "", " ", "Hello  world's\n\n end <|endoftext|> x", "é" * 300, "ab " * 4000, "don't 12 345\t\ttabs 　 日本語 🎉", "\r\n \n x"]


def docs_of(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", 9) for i, t in enumerate(texts)] + [(None, "Hello", "en", 9)], "doc_id long, text string, lang string, ids int")


def test_bpe_is_that_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in bpe.round_trip(docs_of(spark)).collect()}
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    ids = bpe.encode(docs_of(spark))
    assert {r.doc_id: r.text for r in bpe.decode(ids).collect()} == {i: x or "" for i, x in enumerate(TEXTS)} | {None: "Hello"}
    assert bpe.encode(docs_of(spark).where("false")).count() == 0


def test_media_round_trip(spark):
    rnd = np.random.default_rng(1)
    p = rnd.integers(0, 256, (13, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(p)) == p).all() and (media.decode(media.encode_bmp(p)) == p).all()
    small = media.area_resize(p, 1, 1)
    assert np.allclose(small[0, 0], p.reshape(-1, 3).mean(axis=0))
    assert np.allclose(media.area_resize(p, 13, 7), p)
    for form in ("ppm", "bmp"):
        got = {r.doc_id: r for r in media.text_media(docs_of(spark), form).collect()}
        for i, x in enumerate(TEXTS):
            raw = (x or "").encode()
            assert got[i].n_bytes == len(raw) and got[i].payload == raw + b" " * (len(got[i].payload) - len(raw)) and len(got[i].payload) % 192 == 0
    bad = spark.createDataFrame([(1, b"P9"), (2, None), (3, media.encode_ppm(p))], "media_id long, media binary")
    assert [r.error is None for r in media.tiles(bad).orderBy("media_id").collect()] == [False, False, True]


def test_languages(spark):
    rnd = random.Random(2)
    say = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(40))
    rows = [(i, say(["the", "ing", "th", "er"]) if i % 2 else say(["que", "ción", "ado", "es"]), "en" if i % 2 else "es") for i in range(120)]
    docs = spark.createDataFrame(rows + [(500, None, "en"), (501, "12 34", None), (502, "", "es")], "doc_id long, text string, lang string")
    model = langid.fit_documents(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and {got[i].lang_pred for i in (500, 501, 502)} == {"und"}
    assert {r.doc_id for r in langid.recognised(docs, model).collect()} == set(range(120))
    assert langid.predict(docs, langid.fit(docs.where("false"))).first().lang_pred == "und"


def test_segments_match_the_definition():
    def slow(scores, a=0):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return slow(scores[:i], a) + [(a + i, a + j, best[0])] + slow(scores[j:], a + j)

    rnd = random.Random(4)
    for _ in range(200):
        s = [rnd.choice((-3, -2, -1, 1, 2, 5)) + rnd.random() / 1000 for _ in range(rnd.randrange(0, 14))]
        got, want = toxicity.segments(s), slow(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxicity_and_quality_learn(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(300):
        w, bad = [word() for _ in range(60)], i % 4 == 0
        if bad:
            w[20:20] = ["vile", "awful"]
        rows.append((i, " ".join(w) if i % 3 else " ".join(w).upper() + "!!"))
        labels.append((i, int(i % 3 != 0), int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit_documents(docs, table)).collect()}
    assert all((got[i].score >= 0.5) == bool(t) for i, _, t in labels) and got[900].score == got[901].score < 0.5
    assert [(p.first, p.last) for p in got[4].passages] == [(20, 21)]
    good = {r.doc_id: r.score for r in quality.score(docs, quality.fit_documents(docs, table)).collect()}
    assert sum((good[i] >= 0.5) == bool(q) for i, q, _ in labels) >= 295 and good[900] == good[901]
    none = table.where("false")
    assert {r.score for r in toxicity.score(docs, toxicity.fit_documents(docs, none)).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.fit_documents(docs, none)).collect()} == {0.5}


def test_licenses(spark):
    texts = ["x\nReleased under the MIT License.\ny under the MIT license", None, "licensed under the GNU General\nPublic License, version 3 work this is", "version 3 of the public", "CC-BY-NC cc by nc"]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels, got[0].n_words) == (2, 2, 7, "mit", 11)
    assert (got[1].n_words, got[1].labels, got[1].first_word, got[1].score) == (0, "", None, 0.0)
    assert got[2].labels == "gpl-3" and got[3].labels == "" and (got[4].n_base, got[4].base_labels) == (2, "cc-by-nc")
    known = licenses.templates()
    order = sorted({w for _, t, _ in known for w in t})
    m, rnd = licenses.Matcher(order, 0.7, known), random.Random(1)
    for _ in range(300):
        block = set(rnd.sample(order, rnd.randrange(len(order)))) | {b"other"}
        assert {t for t, _ in m.matches(block)} == {k for k, (_, t, _) in enumerate(known) if len(t & block) >= math.ceil(0.7 * len(t) - 1e-9)}
    # blocks, by all windows of a paragraph
    for _ in range(60):
        words = [rnd.choice([*order[:40], b"other", b"more"]) for _ in range(rnd.randrange(1, 120))]
        want = {}
        for k, (_, t, n) in enumerate(known):
            most = max(len(t & set(words[i : i + 2 * n])) for i in range(len(words)))
            if most >= math.ceil(0.7 * len(t) - 1e-9):
                want[k] = most / len(t)
        assert dict(m.found(words)) == want
    far = licenses.scan(docs_of(spark, ["under released mit " + "alpha " * 400 + "license the"])).orderBy("doc_id").collect()
    assert {r.labels for r in far} == {""}


def test_the_mask_meets_every_window():
    at = [i for i, c in enumerate(decontam.MASKS[0]) if c == "1"]
    for width, changed in ((13, 2), (12, 1), (11, 1), (10, 1)):
        for spoiled in itertools.combinations(range(width), changed):
            assert any(not {o + i for i in at} & set(spoiled) for o in range(width - decontam.SPAN + 1))


def test_decontamination(spark):
    item = [f"w{i}" for i in range(30)]
    twice, thrice = list(item[5:18]), list(item[5:18])
    twice[3] = twice[9] = thrice[0] = thrice[5] = thrice[10] = "zz"
    docs = spark.createDataFrame([(1, "A b " + " ".join(item)), (2, "q " + " ".join(twice)), (3, " ".join(thrice)), (4, None), (5, ""), (None, " ".join(item).upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.best_equal, r.n_places) for r in decontam.overlaps(docs, items).collect()}
    assert got == {(1, 7): (13, 1), (2, 7): (11, 1), (None, 7): (13, 1)}
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {3, 4, 5}
    assert decontam.clean(docs, items.where("false")).count() == 6
    short = spark.createDataFrame([(8, "W4 w5"), (9, None), (10, "zz")], "item_id long, text string")
    few = {(r.doc_id, r.item_id): (r.best_equal, r.n_places) for r in decontam.short_overlaps(docs, short).collect()}
    assert few == {(1, 8): (2, 1), (None, 8): (2, 1), (2, 10): (1, 2), (3, 10): (1, 3)}
    assert {r.doc_id for r in decontam.clean(docs, short).collect()} == {4, 5}


def test_short_items_count_once_for_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (1, "other a b"), (2, "b a c")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "A b"), (6, "c"), (7, "b a c d e f g")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.best_equal, r.n_places) for r in decontam.all_overlaps(docs, items).collect())
    assert got == [(1, 5, 2, 1), (1, 5, 2, 2), (2, 6, 1, 1)] and decontam.clean(docs, items).count() == 0


def test_every_token_with_evidence_is_kept():
    # 60,000 tokens, each in one toxic text of a hundred and in none of the many others
    odds = toxicity.log_odds({f"t{i}": (1, 0) for i in range(60_000)} | {"common": (50, 15_000)}, 100, 19_900)
    assert len(odds) == 60_000 and "common" not in odds and len(set(odds.values())) == 1


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x\r\n\r\ny"), (2, None, None), (3, "http://c", "é"), (None, "u", "n"), (1, "http://a", "x\r\n\r\ny")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    back = warc.read_warc(spark, path).collect()
    assert sorted((r.record_id, r.url, bytes(r.body)) for r in back) == sorted((f"<urn:page:{'' if p.page_id is None else p.page_id}>", p.url or "", (p.html or "").encode()) for p in pages.collect())
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab"))
    rows = spark.createDataFrame([(i, 10, hashlib.sha256(bytes([i % 250, i // 250])).hexdigest()) for i in range(700)] + [(5, 10, hashlib.sha256(b"more").hexdigest())], "page_id long, length long, digest string")
    left = warc.catalog(rows)
    assert warc.audit(left, left).count() == 0
    right = left.where("seq <> 300").selectExpr("block", "part", "page_id", "seq", "offset", "length", "copies", "if(seq in (0, 17, 699), 'bad', digest) digest")
    assert {(r.seq, r.status) for r in warc.audit(left, right).collect()} == {(0, "differs"), (17, "differs"), (699, "differs"), (300, "missing")}
    assert {r.status for r in warc.audit(right.where("seq > 100"), right).collect()} == {"extra"} and warc.audit(left.where("false"), left.where("false")).count() == 0
