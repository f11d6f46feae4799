"""A log of chained hashes: what is done to it is told apart, and a stream appends each batch once."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit

KEY = b"k"
FIELDS = "ts long, id long, event string, case_ref string, meta string, seq string"


def entries_of(spark, n, first=0):
    return spark.createDataFrame([(1_000 + i // 3, i, "saved|x" if i % 2 else "opened", None if i % 4 else f"c{i}", f'{{"n": {i}}}', "x") for i in range(first, first + n)], FIELDS)


@pytest.fixture
def log(spark):
    out = audit.Log(spark, f"file://{tempfile.mkdtemp(prefix='spark-')}", size=4)
    for batch, (n, first) in enumerate(((6, 0), (5, 6), (0, 0), (2, 11))):
        out.append(entries_of(spark, n, first), batch, KEY, ["ts", "id"])
    return out


def found(log, entries=None, anchors=None, key=KEY, head=None):
    return sorted((r.seq, r.fault) for r in audit.faults(log.entries() if entries is None else entries, log.anchors() if anchors is None else anchors, key, head).collect())


def test_a_log_is_as_the_chain_says_and_intact(log):
    rows = sorted(log.entries().collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(1, 14)) and [r.segment for r in rows] == [0] * 4 + [1] * 2 + [2] * 4 + [3] + [4] * 2
    before = None
    for r in rows:
        before = audit.mac(KEY, "segment", r.segment) if r.seq in (1, 5, 7, 11, 12) else before
        assert r.prev_mac == before and r.mac == audit.mac(KEY, r.seq, r.ts, r.event, r.case_ref, r.meta, before)
        before = r.mac
    assert found(log) == [] and audit.status(audit.faults(log.entries(), log.anchors(), KEY)) == "intact"
    assert {f for _, f in found(log, key=b"other")} >= {"altered", "anchor_altered", "unlinked"}


def test_what_was_done_is_told_apart(log):
    rows, anchors, seq = log.entries(), log.anchors(), F.col("seq")
    assert found(log, rows.withColumn("meta", F.when(seq == 3, "{}").otherwise(F.col("meta")))) == [(3, "altered")]
    assert found(log, rows.withColumn("case_ref", F.when(seq == 2, "").otherwise(F.col("case_ref")))) == []  # a null reads as empty
    assert found(log, rows.where("seq <> 2")) == [(2, "gap")]
    assert found(log, rows.where("seq < 12")) == [(12, "truncated"), (13, "truncated")]
    assert found(log, rows.unionByName(rows.where("seq = 8"))) == [(8, "double")]
    # an entry in the place of another, with its own MAC made anew for this place, still doesn't follow the one before it
    moved = rows.withColumn("prev_mac", F.when(seq == 8, audit.GENESIS).otherwise(F.col("prev_mac")))
    assert (8, "unlinked") in found(log, moved) and (8, "altered") in found(log, moved)
    assert found(log, anchors=anchors.where("segment <> 2")) == sorted([*((s, "unanchored") for s in range(7, 11)), (10, "anchor_missing")])
    lagging = audit.faults(rows, anchors.where("segment < 4"), KEY)
    assert sorted(r.seq for r in lagging.collect()) == [12, 13] and audit.status(lagging) == "lagging"
    last = anchors.orderBy(F.desc("segment")).first().asDict()
    cut = (rows.where("segment < 4"), anchors.where("segment < 4"))
    assert found(log, *cut) == [] and found(log, *cut, head=last) == [(13, "rolled_back")] and found(log, head=last) == []
    assert (5, "anchor_altered") in found(log, anchors=anchors.withColumn("last_seq", F.when(F.col("segment") == 1, 7).otherwise(F.col("last_seq"))))


def test_a_batch_that_comes_again_counts_once(spark, log):
    want = sorted(log.entries().collect())
    for batch in (0, 1, 3):
        log.append(entries_of(spark, 9, 50), batch, KEY, ["ts", "id"])
    assert sorted(log.entries().collect()) == want
    # a batch broken off before its anchors is not there, and is written over
    audit.sealed(entries_of(spark, 2, 80).withColumn("seq", F.lit(14) + F.col("id") - 80), KEY, None)[0].write.parquet(f"{log.folder}/entries/batch=9")
    assert log.entries().count() == 13
    log.append(entries_of(spark, 3, 90), 9, KEY, ["ts", "id"])
    assert log.entries().count() == 16 and found(log) == []


def test_a_stream_appends_what_a_batch_would(spark):
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    for part in range(3):
        entries_of(spark, 7, part * 7).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    log = audit.Log(spark, f"{folder}/log", size=4)
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def twice(rows, batch):
        log.append(rows, batch, KEY, ["ts", "id"])
        log.append(rows, batch, KEY, ["ts", "id"])

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    assert log.entries().count() == 21 and found(log) == [] and sorted(r.seq for r in log.entries().collect()) == list(range(1, 22))


def test_an_empty_log_is_intact(spark):
    log = audit.Log(spark, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    assert found(log) == []
