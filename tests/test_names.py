"""Declared names and edits against plain loops."""

import random
import re

import pytest

from quillspark.operators import edits, names

LETTERS = "משהוכלב"


def tokens(text):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\[[^\[\]\n]{1,60}\]|[^\W_]+(?:['’-][^\W_]+)*", text or "")]


def splits(word):
    out = [(0, word)]
    for n in (1, 2, 3):
        if len(word) >= n + 2 and re.fullmatch(names.PREFIXES, word[:n]):
            out.append((n, word[n:]))
    return out


def brute(docs, declared):
    known = {}
    for name, payload, rank in declared:
        words = tuple(w for w, _, _ in tokens(name))
        if words and (words not in known or (rank, payload) < known[words]):
            known[words] = (rank, payload)
    bare = lambda w: re.sub("['’][sס]$", "", w)
    out = []
    for doc_id, text in dict.fromkeys((i, t or "") for i, t in docs):
        said, i = tokens(text), 0
        while i < len(said):
            best = None
            for prefix, head in splits(said[i][0]):
                for name, (_, payload) in known.items():
                    n = len(name)
                    here = [w for w, _, _ in said[i : i + n]]
                    if len(here) < n or any(a != b for a, b in zip(here[1:-1], name[1:-1], strict=True)):
                        continue
                    if n == 1:
                        if name[0] not in (head, bare(head)):
                            continue
                        tail = len(head) - len(name[0])
                    else:
                        if head != name[0] or name[-1] not in (here[-1], bare(here[-1])):
                            continue
                        tail = len(here[-1]) - len(name[-1])
                    rank = (-n, prefix, tail, payload)
                    if best is None or rank < best:
                        best = rank
            if best:
                n, prefix, tail, payload = -best[0], *best[1:]
                out.append((doc_id, i, n, prefix, said[i][1] + prefix, said[i + n - 1][2] - tail, payload))
            i += -best[0] if best else 1
    return sorted(out, key=str)


def found(spark, docs, declared):
    a = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, words int")
    b = spark.createDataFrame(declared, "name string, payload string, rank int")
    return sorted((tuple(r) for r in names.declared(a, b).collect()), key=str)


def test_names_of_any_length_are_found_as_by_a_plain_walk(spark):
    declared = [("Noam", "a", 1), ("noam", "b", 0), ("Noam Levi", "c", 0), ("Levi Bar Noam", "d", 0), ("bar", "e", 0), ("one two three four five six seven", "f", 0), ("נועם", "g", 0), ("", "h", 0), (None, "i", 0), ("Noam Levi Bar", "j", 0), ("two three", "k", 0)]
    docs = [
        (1, "Noam's friend (Noam Levi) met Levi Bar Noam's; NOAM-Levi no."),
        (2, "one two three four five six seven; one two three four five six"),
        (3, "לנועם ושלנועם נועם'ס הנועם"),
        (4, None),
        (5, ""),
        (None, "bar bar [bar] noam levi bar noam levi"),
        (1, "another text, Noam"),
        (1, "another text, Noam"),
        (6, "é🎉 Noam\nLevi’s 12"),
    ]
    assert found(spark, docs, declared) == brute(docs, declared)
    rnd = random.Random(4)
    pool = ["a", "b", "c", "b's"]
    docs = [(i, " ".join(rnd.choice(pool) for _ in range(30))) for i in range(25)]
    declared = [(" ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))), f"p{i}", i) for i in range(25)]
    assert found(spark, docs, declared) == brute(docs, declared)


def test_no_names_and_no_texts(spark):
    assert found(spark, [], [("a", "b", 1)]) == [] and found(spark, [(1, "a")], []) == []


def test_a_text_of_one_name_throughout(spark):
    rows = found(spark, [(1, "noam levi " * 4_000)], [("Noam Levi", "c", 0), ("levi", "d", 0)])
    assert len(rows) == 4_000 and {r[2] for r in rows} == {2}


def quadratic(a, b):
    n, m = len(a), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = at = to = 0
    out = []
    while True:
        same = i < n and j < m and a[i] == b[j]
        if (same or (i == n and j == m)) and (i > at or j > to):
            out.append((at, i - at, to, j - to))
        if i == n and j == m:
            return table[0][0], out
        if same:
            i, j = i + 1, j + 1
            at, to = i, j
        elif i == n or (j < m and table[i][j + 1] >= table[i + 1][j]):
            j += 1
        else:
            i += 1


def test_alignments_are_those_of_the_whole_table():
    rnd = random.Random(1)
    for _ in range(1_500):
        k = rnd.choice([1, 2, 3, 6])
        a, b = ([rnd.randrange(k) for _ in range(rnd.randrange(14))] for _ in range(2))
        assert edits.runs_of(a, b) == quadratic(a, b)


def changed(spark, rows):
    pairs = edits.aligned(spark.createDataFrame([(*r, 1) for r in rows], "id long, before string, after string, a int").select("id", "before", "after"))
    shares = {r.id: r.kept for r in edits.kept_shares(pairs).collect()}
    return shares, sorted((r.id, r["from"], r.to) for r in edits.changes(pairs).collect())


def test_replacements_and_deletions_are_learned_but_no_tags_figures_or_small_words(spark):
    rows = [
        (1, "The child displays many gaps, it is important to note", "The child shows gaps"),
        (2, "The boy [name] got 12 of points", "The boy got points"),
        (3, "Same Words here", "same words HERE"),
        (4, None, "x"),
        (5, "a b", None),
        (6, "one two three four five end", "end"),
    ]
    shares, found = changed(spark, rows)
    assert found == [(1, "displays many", "shows"), (5, "a b", "")]  # five words in row 6 are too many
    assert shares[3] == 1.0 and shares[4] is None and shares[5] == 0.0 and shares[6] == pytest.approx(1 / 6)


def test_long_texts_have_no_limit(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(3000)}" for _ in range(12_000)]
    other = [("changed" if i % 400 == 7 else w) for i, w in enumerate(words)]
    shares, found = changed(spark, [(1, " ".join(words), " ".join(other))])
    assert shares[1] == pytest.approx(1 - 30 / 12_000) and found == []  # w and figures


def test_what_is_learned_counts_how_often_it_stood_there(spark):
    texts = [(i, "he displays gaps", "he shows gaps" if i < 4 else "he displays gaps") for i in range(5)]
    pairs = edits.aligned(spark.createDataFrame(texts, "id long, before string, after string"))
    from quillspark.operators.text import small

    got = [tuple(r)[:4] for r in edits.learned(edits.changes(pairs), spark.createDataFrame(texts, "id long, before string, after string"), small).collect()]
    assert got == [("displays", "shows", 4, 5)]


def test_no_text_is_moved_to_look_for_names(spark):
    docs = spark.createDataFrame([(1, "seen Noam Levi Bar's dog"), (1, "seen Noam Levi Bar's dog"), (None, "noam levi"), (2, "Noam Levi")], "doc_id long, text string")
    known = spark.createDataFrame([("Noam Levi Bar", "a", 0), ("Noam Levi", "b", 1)], "name string, payload string, rank int")
    texts = docs.selectExpr("doc_id", "xxhash64(text) as version", "split(lower(text), ' ') as words")
    found = names._candidates(texts, names.index(known))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.doc_id), r["at"], r.n, r.tail, r.payload) for r in found.distinct().collect()) == [("1", 1, 2, 0, "b"), ("1", 1, 3, 2, "a"), ("2", 0, 2, 0, "b"), ("None", 0, 2, 0, "b")]
