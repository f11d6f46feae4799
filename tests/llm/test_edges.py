"""Nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names, for each operator and stage."""

import random

import corpus_pipeline
import pytest

from quillspark.llm import bpe, decontam, langid, licenses, media, quality, repeats, simhash, toxicity, warc

ITEM = "these fifteen words make up one item of a benchmark that texts must not hold"
LONG = " ".join(random.Random(1).choice(["lorem", "ipsum", "dolor", "sit", "amet", "Released under the MIT License."]) for _ in range(300_000))
TEXTS = [(1, "Under the MIT license, some words"), (1, "Under the MIT license, some words"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, "x " + ITEM), (5, LONG)]
CLASH = "id string, tie int, key double, label string, fold int, n string, word int, score string, fp string, copy int, rest int, spans int, keys string, language int"


def tables(spark):
    extra = ("i", 1, 0.5, "l", 2, "n", 3, "s", "f", 4, 5, 6, "k", 7)
    docs = spark.createDataFrame([(i, t, "en" if i != 3 else None, "web", 9, *extra) for i, t in TEXTS], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (3, None, None, "x"), (None, 1, 1, "x"), (4, 0, 1, "y"), (5, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    items = spark.createDataFrame([(1, ITEM, 1), (None, None, 2), (2, "short", 3)], "item_id long, text string, doc_id long")
    return docs, labels, items


BY_ROW = {
    "op1": lambda d, labels: media.media_digests(d),
    "op2": lambda d, labels: licenses.scan(d),
    "op3": lambda d, labels: langid.predict(d, langid.fit_documents(d)),
    "op4": lambda d, labels: simhash.near_duplicates(d),
    "op5": lambda d, labels: toxicity.score(d, toxicity.fit_documents(d, labels)),
    "op8": lambda d, labels: repeats.digests(d),
    "op9": lambda d, labels: bpe.round_trip(d),
    "op10": lambda d, labels: quality.score(d, quality.fit_documents(d, labels)),
}


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_each_row_has_its_result(spark, name):
    docs, labels, _ = tables(spark)
    got = BY_ROW[name](docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    first, again = (r.asDict() for r in got if r.doc_id == 1)
    assert first == again
    none = BY_ROW[name](docs.where("false"), labels.where("false"))
    assert none.count() == 0 and none.columns == BY_ROW[name](docs, labels).columns


def test_overlaps_of_odd_rows(spark):
    docs, _, items = tables(spark)
    assert [(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()] == [(4, 1)]
    left = decontam.clean(docs, items)
    assert left.count() == len(TEXTS) - 1 and left.columns == docs.columns
    assert decontam.overlaps(docs.where("false"), items).count() == 0 and decontam.clean(docs, items.where("false")).count() == len(TEXTS)


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a", "x" * 2_000_000, "d"), (1, "http://a", "x" * 2_000_000, "d"), (None, None, None, "e"), (2, "u\r\nInjected: 1", "", "f")], "page_id long, url string, html string, digest string")
    rows = warc.records(pages).select("page_id", "length", "digest")
    got = {(r.page_id, r.copies) for r in warc.catalog(rows).collect()}
    assert got == {(1, 2), (None, 1), (2, 1)}
    assert not [r for r in warc.records(pages).collect() if "\nInjected" in r.record]
    assert warc.catalog(rows.where("false")).count() == 0


def test_bad_images_have_a_reason_and_no_failure(spark):
    bad = [b"P2 1 1 255 99999999999999999999999", b"P2 2 1 9 3 10", b"P3 1 1 255 -1 0 0", b"P5 9999999 9999999 255\n", b"P6 2 2 255\nxx", b"BM" + b"\xff" * 60, b"P1 1 1 7", None, b""]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "media_id long, media binary")
    got = media.tiles(rows).collect()
    assert len(got) == len(bad) and all(r.error and r.tile is None for r in got)


def test_every_stage_keeps_other_columns(spark, tmp_path):
    docs, _, items = tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.where("false")):
            assert stage(spark, rows, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    # texts without a letter are not recognised; one row of a group stays, its copies of one id with it; the benchmark's text goes
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "5", "None"]
