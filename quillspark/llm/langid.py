"""Language ID by word-first backoff.

A known word counts by its log frequency in each language. An unseen word falls back to its character n-grams: the
longest n of which any n-gram is known, the mean of these n-grams' log frequencies, then shorter ones. The score is the
best language's share after normalisation.

Null text, or text without a letter, is `und` with score 0. A text whose words the model can't place at all is `und` as
well. Null doc_id: never a training row by its remainder (which is null), held_out null. Training rows without lang or
text are left out; without any training row all is `und`. Repeated rows count as often as they stand there.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_ROWS, bounded_sample, crc_of, map_texts, small_batches, table, texts_of

#: The classifier is fitted on this many labelled rows at most.
FIT_ROWS = 20_000
LONGEST = 5
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 200_000


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(rows: DataFrame) -> DataFrame:
    """lang, n (0: word), gram, count of the labelled rows; summed in each task first."""

    def run(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, known in words.items():
            by: list[Counter] = [known, *(Counter() for _ in range(LONGEST))]
            for word, k in known.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        by[n][g] += k
            for n, c in enumerate(by):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "n": pa.array([n] * len(c), pa.int32()), "gram": list(c), "k": pa.array(list(c.values()), pa.int64())})

    return rows.mapInArrow(run, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))


def code(gram: str) -> int:
    """A gram's 64-bit hash, by which the model knows it."""
    return xxhash.xxh64_intdigest(gram.encode("utf-8", "replace"))


def codes(some: list[str]) -> np.ndarray:
    return np.fromiter(map(code, some), np.uint64, len(some))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """labelled: doc_id, text, lang. Returns the languages, and by n (0: words) the grams' codes, sorted, with their log frequencies."""
    known = labelled.where("text is not null and lang is not null")
    picked = bounded_sample(known.select("doc_id").where("doc_id is not null").distinct(), "doc_id", fit_rows)
    rows = known.join(F.broadcast(picked), "doc_id").select("lang", "text")
    # all words and n-grams of the bounded sample: its size bounds what is broadcast
    got = _counts(rows).toArrow()
    order = sorted(got.column("lang").unique().to_pylist())
    column = {x: i for i, x in enumerate(order)}
    codes_of, logs_of = [], []
    for n in range(LONGEST + 1):
        part = got.filter(pc.equal(got.column("n"), n))
        coded = part.column("gram").combine_chunks().dictionary_encode()
        where = np.array([column[x] for x in part.column("lang").to_pylist()], np.int64)
        counts = np.zeros((len(coded.dictionary), len(order)), np.float32)
        counts[coded.indices.to_numpy(zero_copy_only=False), where] = part.column("k").to_numpy()
        base = counts.sum(axis=0, dtype=np.float64)
        logs = np.log((counts + 0.5) / (base + 0.5 * len(counts) + 1)).astype(np.float32)
        at = codes(coded.dictionary.to_pylist())
        by = np.argsort(at)
        codes_of.append(at[by])
        logs_of.append(logs[by])
    return {"langs": order, "codes": codes_of, "logs": logs_of}


class Predictor:
    """The model is searched in sorted arrays, many words at a time; a task keeps the words it has met."""

    def __init__(self, model: dict):
        self.langs, self.codes, self.logs = model["langs"], model["codes"], model["logs"]
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS + 1, len(self.langs)), np.float32)
        self.known = np.zeros(CACHE_WORDS + 1, bool)

    def find(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of codes: which are known at n, and their rows."""
        own = self.codes[n]
        if not len(own):
            return np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        row = np.minimum(np.searchsorted(own, at), len(own) - 1)
        return own[row] == at, row

    def scores_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, and whether it could be placed."""
        rows, known = np.zeros((len(words), len(self.langs)), np.float32), np.zeros(len(words), bool)
        ok, at = self.find(0, codes(words))
        rows[ok], known[ok] = self.logs[0][at[ok]], True
        left = np.flatnonzero(~ok)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            some = [grams(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(x) for x in some])
            ok, at = self.find(n, codes([g for x in some for g in x]))
            owner, at = owner[ok], at[ok]
            hits = np.bincount(owner, minlength=len(left))
            sums = np.stack([np.bincount(owner, self.logs[n][at, k], len(left)) for k in range(len(self.langs))], axis=1)
            found = hits > 0
            rows[left[found]] = sums[found] / hits[found, None]
            known[left[found]] = True
            left = left[~found]
        return rows, known

    def _places(self, words: list[str]) -> list[int]:
        cache = self.cache
        fresh = list({w for w in words if w not in cache})
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
            fresh = list(set(words))
        if fresh:
            first = len(cache)
            self.rows[first : first + len(fresh)], self.known[first : first + len(fresh)] = self.scores_of(fresh)
            cache.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return [cache[w] for w in words]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [WORD.findall(x.lower()) if x and self.langs and any(c.isalpha() for c in x) else [] for x in texts]
        out = []
        for own in words:
            total, n = np.zeros(len(self.langs)), 0
            for at in range(0, len(own), 20_000):
                places = self._places(own[at : at + 20_000])
                total += self.rows[places].sum(axis=0, dtype=np.float64)
                n += int(self.known[places].sum())
            if not n:
                out.append(("und", 0.0))
                continue
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def forget(self) -> None:
        self.cache.clear()
        self.codes = self.logs = self.rows = None


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def start():
        p = Predictor(sent.value)

        def work(doc_id, text):
            both = p.predict_all(text)
            return {"doc_id": doc_id, "lang_pred": [x for x, _ in both], "score": [x for _, x in both]}

        work.done = p.forget
        return work

    return map_texts(texts_of(docs), start, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is told with a score of `least` or more. No row is moved."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        p = Predictor(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                ok = [lang != "und" and score >= least for lang, score in p.predict_all(part.column(at).to_pylist())]
                yield part.filter(pa.array(ok, pa.bool_()))
        p.forget()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def fit_documents(docs: DataFrame) -> dict:
    """Learn from rows whose crc32(doc_id as text) mod 4 is not 2."""
    return fit(texts_of(docs, "lang").withColumn("lang", F.col("lang").cast("string")).where(crc_of(F.col("doc_id")) % 4 != 2))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit_documents(docs)).select("doc_id", (crc_of(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")
