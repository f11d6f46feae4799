"""Image features and nearest-neighbour votes against plain loops."""

import binascii
import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import media, quality


@pytest.mark.parametrize("shape", [(13, 7, 3), (1, 1, 1), (5, 64, 3), (9, 8, 1), (3, 40, 3)])
def test_area_resize_is_the_mean_of_areas(shape):
    p = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    for height, width in ((8, 9), (16, 16), (2, 3)):
        # every pixel as height x width small ones: target areas then hold whole small pixels
        fine = np.kron(p.astype(float), np.ones((height, width, 1)))
        want = fine.reshape(height, shape[0], width, shape[1], shape[2]).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(p, height, width), want)


def test_difference_hash_tells_where_brightness_rises():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        p = rnd.integers(0, 256, (rnd.integers(1, 40), rnd.integers(1, 40), 3)).astype(np.uint8)
        small = np.kron(p.astype(float).mean(axis=2), np.ones((8, 9))).reshape(8, p.shape[0], 9, p.shape[1]).mean(axis=(1, 3))
        bits = "".join("1" if round(small[y, x + 1], 6) > round(small[y, x], 6) else "0" for y in range(8) for x in range(8))
        assert media.difference_hash(p) == f"{int(bits, 2):016x}"
    assert media.difference_hash(np.full((5, 5, 3), 7, np.uint8)) == "0" * 16


def test_digests_are_those_of_the_payload(spark):
    texts = [None, "", "a" * 192, "é" * 97, "x" * 193]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_digests(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        head = b"P6\n64 %d\n255\n" % (len(payload) // 192)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(head) + len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == binascii.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(head + payload).hexdigest()


def test_votes_are_those_of_the_nearest_with_ties_to_the_first():
    rnd = np.random.default_rng(6)
    n, dims, k = 40, 5, 7
    vectors = quality.unit(rnd.integers(-2, 3, (n, dims)).astype(np.float32))
    labels = rnd.integers(0, 2, n).astype(np.float32)
    model = {"basis": np.eye(dims, dtype=np.float32), "vectors": vectors.T.copy(), "labels": labels, "share": 0.4}
    x = rnd.integers(-2, 3, (60, dims)).astype(np.float32)
    x[0] = 0
    got = quality.votes(x, model, k)
    at = quality.unit(x)
    for row, score in zip(at, got, strict=True):
        near = (row[None] @ model["vectors"])[0]
        best = sorted(range(n), key=lambda i: (-near[i], i))[:k]
        weights = [max(0.0, min(1.0, float(near[i]))) ** quality.SHARPNESS for i in best]
        want = sum(w * labels[i] for w, i in zip(weights, best, strict=True)) / sum(weights) if row.any() and sum(weights) else 0.4
        assert abs(score - want) < 1e-4


def test_trigrams_are_counted_over_the_whole_text(monkeypatch):
    text = "".join(random.Random(1).choice("abcé ") for _ in range(3000))
    whole = quality.counts_of(text)
    monkeypatch.setattr(quality, "SLICE", 100)
    assert (quality.counts_of(text) == whole).all() and whole.sum() == len(text.encode())
