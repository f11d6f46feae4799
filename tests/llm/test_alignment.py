"""Alignment against both libraries over whole texts."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm import alignment, bpe

TEXTS = [
    None,
    "",
    " ",
    "Hello  world's\n\n end <|endoftext|> <s> </s> x",
    "é" * 300,
    "ab " * 4000,
    "don't 12 345\t\ttabs 　 日本語 🎉  x   y",
    "\r\n \n x",
    "  two in front and behind  ",
    "holds ▁ itself",
    "<0x41> <0x0A>\n<unk>",
    "a\x00b \x85 \x1c c",
    "x \u00a0y z\u2003 w",
    " lead",
    "trail ",
    "ééé" * 700 + " " + "long" * 600,
    "unbelievable internationalisation ciónñ ÉCHMENTTRE!! 555-7405 was.\nerwhatst",
]


def brute(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    spm, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    b = spm.SentencePieceProcessor(model_file=alignment.default_path())
    out_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, range(b.vocab_size()))]
    a = tokenizers.Tokenizer.from_file(bpe.default_path())
    a.encode_special_tokens = True
    letters = bpe.byte_letters()
    out_a = {i: bytes(letters[c] for c in s) for s, i in a.get_vocab().items() if all(c in letters for c in s)}
    each, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(out_a.get, ids_a)) != whole or b"".join(out_b[i] for i in ids_b) != whole:
            each.append(None)
            continue
        by_end = defaultdict(lambda: [None, None])
        for side, (ids, out) in enumerate(((ids_a, out_a), (ids_b, out_b))):
            end = 0
            for i in ids:
                end += len(out[i])
                by_end[end][side] = i
        groups, links, now = [], [], ([], [])
        for end in sorted(by_end):
            for side in (0, 1):
                now[side].extend([by_end[end][side]] if by_end[end][side] is not None else [])
            if None not in by_end[end]:
                groups.append("|".join(",".join(map(str, x)) for x in now))
                links.append(tuple(by_end[end]))
                now = ([], [])
        counts.update(links)
        each.append((len(ids_a), len(ids_b), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if e is None else (e[0], e[1], len(e[2]), len(e[2]), sum(counts[x] == most[x[1]] for x in e[2]), sum(counts[x] for x in e[2]), e[3]) for e in each]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, [2]) for i, t in rows], "doc_id long, text string, kind string, bundle int, groups array<int>")


def numbers(r):
    return tuple(r[c] for c in alignment.NUMBERS)


def test_whole_texts_align_as_by_the_libraries(spark, monkeypatch):
    rnd = random.Random(5)
    parts = [" ", " ", "  ", "\n", "a", "the", "ción", "é", "12", "'s", "!", "日", " ", "x"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(40)) for _ in range(60)]
    rows = [*enumerate(texts), (None, "Hello world"), (None, None), (3, texts[3]), (3, "Hello again")]
    monkeypatch.setattr(alignment, "BUNDLE_BYTES", 4_000)
    got = sorted((str(r.doc_id), numbers(r), r.groups) for r in alignment.align(docs_of(spark, rows)).collect())
    assert got == sorted((str(i), x[:-1], x[-1]) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    some = rows[:8]
    want = [hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for x in brute([t for _, t in some])]
    assert [r.groups_sha256 for r in sorted(alignment.align(docs_of(spark, some), digest=True).collect(), key=lambda r: r.doc_id)] == want


def test_groups_and_links_of_two_sides(spark):
    tokens = spark.createDataFrame([(1, [10, 11, 12], [1, 2, 1], [20, 21], [3, 1]), (2, [10], [2], [20, 21], [1, 1])], "id long, a array<int>, a_sizes array<int>, b array<int>, b_sizes array<int>")
    rows = {r.id: r for r in alignment.grouped(tokens).collect()}
    assert rows[1].groups == "10,11|20;12|21" and {tuple(x) for x in rows[1].links} == {(11, 20), (12, 21)}
    assert rows[2].groups == "10|20,21" and [tuple(x) for x in rows[2].links] == [(10, 21)]
    counts = alignment.pair_counts(spark.createDataFrame([(1, 5, 2), (2, 5, 2), (3, 5, 1), (1, 6, 1)], "a int, b int, n long"))
    assert {(r.a, r.b): (r.n, r.best) for r in counts.collect()} == {(1, 5): (2, True), (2, 5): (2, True), (3, 5): (1, False), (1, 6): (1, True)}


def test_an_empty_table_has_no_rows(spark):
    none = alignment.align(docs_of(spark, [(1, "x")]).where("false"), digest=True)
    assert none.count() == 0 and none.columns == ["doc_id", *alignment.NUMBERS, "groups_sha256"]


def test_a_tokenizer_that_loses_bytes_is_refused(spark):
    with pytest.raises(Exception, match="don't give back"):
        alignment.encoded(spark.createDataFrame([(1, "x ▁ y")], "id long, text string")).collect()
