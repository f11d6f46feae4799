"""Quality by votes of the nearest labelled documents in a latent semantic space.

A text's features are its UTF-8 bytes' trigrams, hashed to `FEATURES` columns, weighted by 1 + ln(count) and the inverse
document frequency over all documents, and style columns: the share of words that repeat the word before them and the
share of upper-case letters. The right singular vectors of the labelled rows' matrix (randomised, fixed seed)
span the latent space. The labelled rows' unit vectors (at most `FIT_ROWS`) are broadcast; every document's cosines to all
of them are exact products in blocks, and its `NEIGHBOURS` nearest vote with weights that grow with the cosine.

Null and empty texts, and texts without a direction in the space, get the labelled rows' share of good ones. So does every
text where there is no labelled row. Ties among neighbours go to the smaller doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import crc_of, labelled, map_texts, table, texts_of

FIT_ROWS = 4096
FEATURES, DIMENSIONS = 4096, 48
NEIGHBOURS = 15
#: A neighbour's weight is its cosine, raised to this power.
SHARPNESS = 8
#: Style columns, and what a share of one weighs there; a text's trigrams have a norm of about 100 together.
STYLES, STYLE_WEIGHT = 2, 60.0
COLUMNS = FEATURES + STYLES
SLICE = 1 << 20


def counts_of(text: str | None) -> np.ndarray:
    """How often each column's trigrams stand in the text."""
    b = np.frombuffer(b" " + (text or "").encode("utf-8", "replace") + b" ", np.uint8)
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(b) - 2, SLICE):
        x = b[at : at + SLICE + 2].astype(np.uint32)
        code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
        out += np.bincount(code * np.uint32(2654435769) >> np.uint32(20), minlength=FEATURES)
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    counts = np.stack([counts_of(x) for x in texts]).astype(np.float32)
    terms = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32)
    x = np.hstack([terms, np.array([style_of(x) for x in texts], np.float32) * np.float32(STYLE_WEIGHT)])
    # labelled rows travel in half precision, so all rows are rounded to it
    return x.astype(np.float16).astype(np.float32)


def style_of(text: str | None) -> tuple[float, float]:
    words = (text or "").split()
    again = sum(map(str.__eq__, words, words[1:])) / len(words) if words else 0.0
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    upper, letters = int(((b >= 65) & (b <= 90)).sum()), int(((b | 32) >= 97).sum() - ((b | 32) > 122).sum()) if len(b) else 0
    return again, upper / letters if letters else 0.0


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Over all documents; each task sends one row for each column at most."""

    def run(batches):
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                seen += counts_of(x.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, FEATURES), pa.int32()), "n": pa.array([n, *seen.tolist()], pa.int64())})

    rows = texts_of(docs).select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    by = {r["at"]: r["n"] for r in rows}
    terms = np.log((1 + by.get(-1, 0)) / (1 + np.array([by.get(i, 0) for i in range(FEATURES)], float))).astype(np.float32) + 1
    return np.concatenate([terms, np.ones(STYLES, np.float32)])


def space(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Columns: the leading right singular vectors, by a randomised range finder with two power steps."""
    k = min(dimensions, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        y, _ = np.linalg.qr(x @ q)
        q, _ = np.linalg.qr(x.T @ y)
    u, _, _ = np.linalg.svd(q.T @ (x.T @ (x @ q)))
    return np.ascontiguousarray((q @ u)[:, :k].astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-6)


def fit(docs: DataFrame, rows: DataFrame, dimensions: int = DIMENSIONS) -> dict:
    """rows: doc_id, text, label; bounded by the caller. docs: all documents."""
    weights = inverse_frequencies(docs)

    def start():
        return lambda doc_id, text, label: {"doc_id": doc_id, "label": label, "x": [r.astype(np.float16).tobytes() for r in matrix(text)]}

    known = sorted(map_texts(rows.select("doc_id", "text", "label"), start, "doc_id long, label int, x binary").collect(), key=lambda r: (r.doc_id, r.label, r.x))
    if not known:
        return {"weights": weights, "vectors": None, "share": 0.5}
    x = np.frombuffer(b"".join(r.x for r in known), np.float16).reshape(len(known), COLUMNS).astype(np.float32)
    x = unit(x * weights)
    basis = space(x, dimensions)
    labels = np.array([r.label for r in known], np.float32)
    return {"weights": weights, "basis": weights[:, None] * basis, "vectors": unit(x @ basis).T.copy(), "labels": labels, "share": float(labels.mean())}


def votes(x: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    vectors, labels = model["vectors"], model["labels"]
    k = min(neighbours, len(labels))
    at = unit(x @ model["basis"])
    near = at @ vectors
    # the k nearest; of equal ones those that come first, and labelled rows stand in the order of their ids
    least = np.partition(near, -k, axis=1)[:, [-k]]
    above, equal = near > least, near == least
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    top = np.nonzero(chosen)[1].reshape(len(x), k)
    weight = np.clip(np.take_along_axis(near, top, 1), 0, 1) ** SHARPNESS
    total = weight.sum(axis=1)
    ok = (total > 0) & at.any(axis=1)
    return np.where(ok, (weight * labels[top]).sum(axis=1) / np.where(ok, total, 1), model["share"]).astype(float).clip(0, 1)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value

        def work(doc_id, text):
            if m["vectors"] is None:
                return {"doc_id": doc_id, "score": [m["share"]] * len(text)}
            got = votes(matrix(text), m)
            return {"doc_id": doc_id, "score": [float(s) if x else m["share"] for s, x in zip(got, text, strict=True)]}

        return work

    return map_texts(texts_of(docs), start, "doc_id long, score double")


def fit_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    return fit(docs, labelled(docs, labels, "quality", crc_of(F.col("doc_id")) % 3 != 1, fit_rows))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit_documents(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_of(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
