"""Toxicity by maximum-scoring segments.

A token's score is the lower confidence bound of its log-odds between toxic and other labelled documents, with Dirichlet
priors in proportion to each class; tokens without evidence get a fixed drift below zero. One linear pass over a text finds
all maximal scoring segments. Extreme-value calibration makes them comparable: with lambda the positive root of
E[exp(lambda * score)] = 1 over the tokens of non-toxic documents, and K fitted to their best segments by maximum
likelihood, a segment's excess is lambda * S - ln(K * n), its nats beyond what the best segment of n such tokens reaches by
chance. A segment with positive excess is a significant passage; the document's score is a logistic function of the sum of
excesses and of the best one. K and the logistic are fitted on texts that the odds they are scored by have not seen:
labelled texts are in FOLDS parts by a hash, and each part is scored by odds from the others.

Documents count once for a token, and equal labelled texts once, so copies don't make their words toxic. Null and empty
texts have no segment and get the score that any text without a segment gets. Without labels of both kinds every score is
the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import crc_of, labelled, map_texts, stored, table, texts_of

#: Labelled rows that are learned from at most.
FIT_ROWS = 20_000
#: Pseudo-counts of a token; standard errors that a log-odds must exceed zero by; what a token without evidence costs.
PRIOR, ERRORS, DRIFT = 1.0, 2.5, -0.4
FOLDS = 4
TOKEN = re.compile(r"[^\W\d_]+")


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; ends are exclusive. Linear time."""
    # one entry for each candidate: start, end, sum before it, sum up to its end, and the last candidate before it with a smaller sum before
    out: list[list] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, left, right = i, total, total + s
        total = right
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([start, i + 1, left, right, j])
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
            j -= 1
    return [(a, b, r - le) for a, b, le, r, _ in out]


def passages(tokens: list[str], odds: dict[str, float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """The maximal segments of a text's tokens. A run of tokens without evidence is one step."""
    at = [i for i, t in enumerate(tokens) if t in odds]
    if not at:
        return []
    scores, place = [], []
    last = 0
    for i in at:
        if i > last:
            scores.append(drift * (i - last))
            place.append(last)
        scores.append(odds[tokens[i]])
        place.append(i)
        last = i + 1
    place.append(last)
    return [(place[a], place[b - 1] + 1, s) for a, b, s in segments(scores)]


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """counts: token to documents of either class that have it. The tokens whose lower bound is above zero."""
    if not toxic or not other:
        return {}
    share = toxic / (toxic + other)
    a, b = PRIOR * share, PRIOR * (1 - share)
    words = list(counts)
    y = np.array([counts[w] for w in words], float).reshape(-1, 2)
    t, c = np.minimum(y[:, 0] + a, toxic + a - 0.5 * a), np.minimum(y[:, 1] + b, other + b - 0.5 * b)
    delta = np.log(t / (toxic + 2 * a - t)) - np.log(c / (other + 2 * b - c))
    low = delta - ERRORS * np.sqrt(1 / t + 1 / c)
    return {words[i]: float(low[i]) for i in np.flatnonzero(low > 0)}


def _lower_bound(t: Column, c: Column, toxic: int, other: int) -> Column:
    """That of log_odds, as an expression over a token's document counts."""
    share = toxic / (toxic + other)
    a, b = PRIOR * share, PRIOR * (1 - share)
    t, c = F.least(t + a, F.lit(toxic + a - 0.5 * a)), F.least(c + b, F.lit(other + b - 0.5 * b))
    return F.log(t / (toxic + 2 * a - t)) - F.log(c / (other + 2 * b - c)) - ERRORS * F.sqrt(1 / t + 1 / c)


def decay(scores: np.ndarray, shares: np.ndarray, drift: float = DRIFT) -> float:
    """lambda: the positive root of the mean of exp(lambda * score) = 1; shares: of the tokens with these scores, the rest has the drift."""
    rest = 1 - shares.sum()
    high = 1.0
    f = lambda x: float((shares * np.exp(x * scores)).sum() + rest * math.exp(x * drift) - 1)
    if not len(scores) or (shares * scores).sum() + rest * drift >= 0:
        return 1.0
    while f(high) < 0:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def features(n: int, found: list[tuple[int, int, float]], model: dict) -> tuple[float, float]:
    """Sum of the significant segments' excesses, and the best segment's excess, in nats."""
    if not found:
        return 0.0, 0.0
    chance = math.log(model["k"] * max(n, 1) + 1)
    over = [max(0.0, model["lambda"] * s - chance) for _, _, s in found]
    return math.log1p(sum(over)), math.log1p(max(over))


def chance_of(best: np.ndarray, sizes: np.ndarray, decay_: float) -> float:
    """K of the extreme-value law P(best > s) = 1 - exp(-K n exp(-lambda s)), by maximum likelihood over non-toxic texts: their number by the sum of n exp(-lambda s)."""
    total = float((np.maximum(sizes, 1) * np.exp(-decay_ * best)).sum())
    return min(1.0, max(1e-4, len(best) / total)) if total else 0.1


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _model(counts: dict[str, tuple[int, int, int]], toxic: int, other: int, tokens: int) -> dict:
    """counts: token to toxic and other documents that have it, and its places in others. Odds and lambda; K and weights follow."""
    odds = log_odds({w: (t, c) for w, (t, c, _) in counts.items()}, toxic, other)
    model = {"odds": odds, "share": toxic / max(1, toxic + other), "k": 0.1, "lambda": 1.0, "weights": None}
    if odds:
        scores = np.array(list(odds.values()))
        shares = np.array([counts[w][2] + 0.5 for w in odds]) / (tokens + 0.5 * len(odds) + 1)
        model["lambda"] = decay(scores, shares)
    return model


def fit(rows: DataFrame) -> dict:
    """rows: doc_id, text, label (1: toxic); bounded by the caller."""
    # equal texts count once
    texts = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    texts = texts.select("text", "label", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold"))

    def words(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: dict[tuple[str, int, int], list[int]] = {}
                for text, label, fold in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns), strict=True):
                    found = Counter(TOKEN.findall((text or "").lower()))
                    found[""] = found.total()
                    for w, n in found.items():
                        seen = out.setdefault((w, label, fold), [0, 0])
                        seen[0] += 1
                        seen[1] += n
                yield pa.RecordBatch.from_pydict({"word": [w for w, _, _ in out], "label": pa.array([x for _, x, _ in out], pa.int32()), "fold": pa.array([x for _, _, x in out], pa.int32()), "docs": pa.array([x for x, _ in out.values()], pa.int64()), "n": pa.array([x for _, x in out.values()], pa.int64())})

    of = lambda label, fold, what: F.sum(F.when((F.col("label") == label) & (F.col("fold") == fold), F.col(what)).otherwise(0)).alias(f"{'ct'[label]}{fold}" if what == "docs" else f"n{fold}")
    sums = [x for k in range(FOLDS) for x in (of(1, k, "docs"), of(0, k, "docs"), of(0, k, "n"))]
    counted = stored(texts.mapInArrow(words, "word string, label int, fold int, docs long, n long").groupBy("word").agg(*sums), "counts")
    whole = counted.where("word = ''").first()
    if not whole:
        return _model({}, 0, 0, 0)
    # of all folds (the model itself), and of all but each
    parts = [range(FOLDS), *([j for j in range(FOLDS) if j != k] for k in range(FOLDS))]
    add = lambda r, kind, part: sum(r[f"{kind}{k}"] for k in part)
    sizes = [tuple(add(whole, kind, part) for kind in "tcn") for part in parts]
    column = lambda kind, part: sum((F.col(f"{kind}{k}") for k in part), F.lit(0))
    above = F.lit(False)
    for part, (toxic, other, _) in zip(parts, sizes, strict=True):
        if toxic and other:
            above = above | (_lower_bound(column("t", part), column("c", part), toxic, other) > -1e-6)
    got = counted.where("word <> ''").where(above).collect()
    models = [_model({r.word: tuple(add(r, kind, part) for kind in "tcn") for r in got}, *size) for part, size in zip(parts, sizes, strict=True)]
    model = models[0]
    if not model["odds"] or not sizes[0][0] or not sizes[0][1]:
        return model
    xs = scored_rows(texts, models[1:]).collect()
    label, best, n = (np.array([r[c] for r in xs], float) for c in ("label", "best", "n"))
    clean = label == 0
    model["k"] = chance_of(best[clean], n[clean], model["lambda"])
    # segments are scored with their fold's lambda by now, so excesses differ by K alone
    total, top = (np.array(x) for x in zip(*(features(int(r.n), [(0, 0, s) for s in r.nats], {"lambda": 1.0, "k": model["k"]}) for r in xs), strict=True))
    model["weights"] = logistic(np.column_stack([total, top]), label).tolist()
    return model


def scored_rows(texts: DataFrame, models: list[dict]) -> DataFrame:
    """text, label, fold to label, n (tokens), best (segment's score), nats (of each segment: lambda times score), by the model that has not seen the fold."""
    sent = texts.sparkSession.sparkContext.broadcast(models)

    def start():
        known = sent.value

        def work(text, label, fold):
            out = {"label": label, "n": [], "best": [], "nats": []}
            for x, k in zip(text, fold, strict=True):
                tokens = TOKEN.findall((x or "").lower())
                found = passages(tokens, known[k]["odds"])
                out["n"].append(len(tokens))
                out["best"].append(max((s for _, _, s in found), default=0.0))
                out["nats"].append([known[k]["lambda"] * s for _, _, s in found])
            return out

        return work

    return map_texts(texts.select("text", "label", "fold"), start, "label int, n int, best double, nats array<double>")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, passages: the significant ones' first and last token and their excess in nats."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value
        odds, w = m["odds"], m["weights"]

        def one(x):
            tokens = TOKEN.findall((x or "").lower())
            found = passages(tokens, odds)
            chance = math.log(m["k"] * max(len(tokens), 1) + 1)
            told = [{"first": a, "last": b - 1, "nats": over} for a, b, s in found if (over := m["lambda"] * s - chance) > 0]
            if not w:
                return m["share"], told
            a, b = features(len(tokens), found, m)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * a + w[2] * b)))), told

        def work(doc_id, text):
            both = [one(x) for x in text]
            return {"doc_id": doc_id, "score": [a for a, _ in both], "passages": [b for _, b in both]}

        return work

    return map_texts(texts_of(docs), start, "doc_id long, score double, passages array<struct<first:int,last:int,nats:double>>")


def fit_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(labelled(docs, labels, "toxic", crc_of(F.col("doc_id")) % 5 != 0, fit_rows))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit_documents(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_of(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
