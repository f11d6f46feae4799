import math
import random
from collections import Counter

import numpy as np

from quillspark.llm import langid, toxicity


def test_language_model_keeps_all_words_and_grams(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "aeo"][:31_000]
    docs = spark.createDataFrame([(1, " ".join(words), "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model["codes"][0].tolist()) == {langid.code(w) for w in words}
    assert set(model["codes"][5].tolist()) == {langid.code(g) for w in words for g in langid.grams(w, 5)}


def test_scores_are_those_of_the_definition(spark):
    """Brute force over plain dictionaries: known words first, then the longest n-grams of which any is known."""
    rnd = random.Random(3)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7)))
    rows = [(i, " ".join(word("abcde" if i % 2 else "cdefé") for _ in range(30)), "x" if i % 2 else "y") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    count = {lang: [Counter() for _ in range(6)] for lang in "xy"}
    for _, text, lang in rows:
        for w in text.split():
            count[lang][0][w] += 1
            for n in range(1, 6):
                count[lang][n].update(langid.grams(w, n))
    vocabulary = [set(count["x"][n]) | set(count["y"][n]) for n in range(6)]

    def log(lang, n, g):
        return math.log((count[lang][n][g] + 0.5) / (count[lang][n].total() + 0.5 * len(vocabulary[n]) + 1))

    def score(w, lang):
        if w in vocabulary[0]:
            return log(lang, 0, w)
        for n in range(5, 0, -1):
            known = [g for g in langid.grams(w, n) if g in vocabulary[n]]
            if known:
                return sum(log(lang, n, g) for g in known) / len(known)
        return None

    p = langid.Predictor(model)
    words = sorted({word("abcdeéfgh") for _ in range(300)} | {"zzz"})
    got, known = p.scores_of(words)
    for w, row, ok in zip(words, got, known, strict=True):
        want = [score(w, lang) for lang in model["langs"]]
        assert ok == (want[0] is not None)
        assert not ok or all(abs(a - b) < 1e-4 for a, b in zip(row.tolist(), want, strict=True))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))) for _ in range(40)]
    for text, (lang, _) in zip(texts, p.predict_all(texts), strict=True):
        sums = [sum(s for w in text.split() if (s := score(w, x)) is not None) for x in model["langs"]]
        assert any(score(w, "x") is not None for w in text.split()) and (abs(sums[0] - sums[1]) < 1e-2 or lang == model["langs"][sums.index(max(sums))])


def test_toxic_token_of_one_document_counts_by_its_bound(spark):
    rows = [(i, f"plain words number {i}", 0) for i in range(200)] + [(200, "plain vile words", 1), (201, "awful plain words", 1)]
    model = toxicity.fit(spark.createDataFrame([(i, t + " x" * i, y) for i, t, y in rows], "doc_id long, text string, label int"))
    assert set(model["odds"]) == {"vile", "awful"}


def test_chance_of_best_segments_is_found_again():
    rnd = np.random.default_rng(5)
    n, k, decay = rnd.integers(20, 400, 4000), 0.03, 0.8
    best = (np.log(k * n) - np.log(-np.log(rnd.random(4000)))) / decay
    assert abs(toxicity.chance_of(best, n, decay) / k - 1) < 0.06
