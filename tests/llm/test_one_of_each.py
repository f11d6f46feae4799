import random

import numpy as np

import corpus_pipeline
from quillspark.llm import simhash


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, similarity=0.8):
    """The ids that stay, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if find(i) == i)


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def edited(rnd, base, edits):
    out = list(base)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = f"e{rnd.getrandbits(40)}"
    return out


def numbered(rnd, texts):
    texts = [" ".join(x) for x in texts]
    rnd.shuffle(texts)
    return dict(enumerate(texts))


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    return sorted(r.doc_id for r in simhash.one_of_each(docs).collect())


def test_large_groups_of_edited_copies(spark):
    rnd = random.Random(5)
    all_ = []
    for size, n, edits in ((40, 300, 5), (60, 150, 2)):
        base = words(rnd, n)
        all_ += [base, *(edited(rnd, base, edits) for _ in range(size))]
    # two unrelated texts hold a passage first, the pairs that count come after
    passage = words(rnd, 40)
    all_ += [words(rnd, 100) + passage + words(rnd, 100) for _ in range(8)]
    texts = numbered(rnd, all_)
    want = brute(texts)
    assert kept(spark, texts) == want
    before, simhash.SALT_ROWS = simhash.SALT_ROWS, 7
    try:
        assert kept(spark, texts) == want
    finally:
        simhash.SALT_ROWS = before


def test_short_texts_with_few_edits(spark, tmp_path):
    rnd = random.Random(6)
    all_ = [[], [], ["One"], ["one"], ["One", "two"]]
    for n, edits, groups in ((4, 0, 3), (52, 1, 20), (60, 1, 20), (81, 1, 20), (100, 2, 20), (150, 3, 20)):
        for _ in range(groups):
            base = words(rnd, n)
            all_ += [base, edited(rnd, base, edits), edited(rnd, base, edits)]
    texts = numbered(rnd, all_)
    want = brute(texts)
    assert kept(spark, texts) == want


def test_whole_pipeline_keeps_one_of_short_copies(spark, tmp_path):
    rnd = random.Random(7)
    letters = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rst", "lmo", "x")]
    all_ = []
    for n, edits, size in ((52, 1, 1), (60, 1, 1), (100, 2, 1)):
        for _ in range(12):
            base = rnd.choices(letters, k=n)
            for _ in range(size):
                copy = list(base)
                for at in rnd.sample(range(n), edits):
                    copy[at] = "zzy"
                all_.append(copy)
            all_.append(base)
    base = rnd.choices(letters, k=300)
    for _ in range(40):
        copy = list(base)
        for at in rnd.sample(range(300), 5):
            copy[at] = rnd.choice(letters) + rnd.choice(letters)
        all_.append(copy)
    texts = numbered(rnd, [*all_, base])
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this stands in any text " * 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == brute(texts)


def test_repeated_lines_do_not_hide_copies(spark):
    rnd = random.Random(8)
    all_ = []
    for times in (30, 60, 100, 200) * 6:
        base, line = words(rnd, 300), words(rnd, 10)
        all_ += [base, base + line * times]
    texts = numbered(rnd, all_)
    want = brute(texts)
    assert len(want) == 24 and kept(spark, texts) == want


def test_pairs_met_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    met, real = [], simhash._unlinked

    def counted(*a, **k):
        met.append(real(*a, **k).count())
        return real(*a, **k)

    monkeypatch.setattr(simhash, "_unlinked", counted)
    rnd = random.Random(9)
    base = words(rnd, 150)
    # copies with different edits are alike enough only where one of the two has few; the base itself is not there
    texts = numbered(rnd, [edited(rnd, base, 1 + k % 4) for k in range(160)])
    assert kept(spark, texts) == brute(texts)
    assert met[0] <= 4 * len(texts)


def test_parity_bits_never_differ_more_than_shingles():
    rnd = random.Random(10)
    for n in (3, 40, 150, 2000):
        base = words(rnd, n)
        for edits in (0, 1, 3):
            one, other = (simhash.shingles(" ".join(edited(rnd, base, k) * 2), 5) for k in (0, edits))
            apart = len(set(one.tolist()) ^ set(other.tolist()))
            differ = int(np.bitwise_count((simhash._bits(one) ^ simhash._bits(other)).view(np.uint64)).sum())
            assert differ <= apart and (differ - apart) % 2 == 0


def test_keys_that_only_go_on_in_a_run_do_not_move(spark, monkeypatch):
    rnd = random.Random(12)
    all_ = [words(rnd, 200) for _ in range(40)]
    texts = numbered(rnd, all_ + [edited(rnd, x, 1) for x in all_[:20]])
    want = brute(texts)
    for bits in (simhash.KEY_BITS, 0):
        tables, real = {}, simhash.stored
        with monkeypatch.context() as m:
            m.setattr(simhash, "KEY_BITS", bits)
            m.setattr(simhash, "stored", lambda df, name, *a: tables.setdefault(name, real(df, name, *a)) if name in ("prefixes", "shared") else real(df, name, *a))  # noqa: B023
            assert kept(spark, texts) == want and len(want) == 40
        holders = tables["prefixes"].selectExpr("explode(keys) as key").groupBy("key").count().where("count > 1").agg({"count": "sum"}).first()[0]
        assert 40 <= tables["shared"].count() < holders / 3
