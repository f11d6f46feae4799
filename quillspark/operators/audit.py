"""A log that shows what was done to it: chains of keyed hashes in segments, and a chain of anchors over the segments.

An entry's MAC covers its place, its fields and the MAC before it. Chains run within segments of a bounded number of entries,
each opened by a MAC of its own, so segments are sealed and verified side by side. An anchor for each segment covers its range,
its last MAC and the anchor before it: what was cut off, moved or put back to an earlier state shows there. One task makes a batch's
anchors, a row for each segment.

The key stays inside Python functions: it is neither part of a plan nor of its text.
"""

from __future__ import annotations

import hashlib
import hmac as hmac_lib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.records import numbered, written
from quillspark.streaming.folds import fold

GENESIS = "0" * 64
SEGMENT = 1_000
ENTRY = "segment long, seq long, ts long, event string, case_ref string, meta string, prev_mac string, mac string"
ANCHOR = "segment long, first_seq long, last_seq long, head string, prev_anchor string, anchor string"


def mac(key: bytes, *parts: object) -> str:
    """HMAC-SHA256 of the parts, nulls as empty, in lower-case hex. Bars and backslashes in a part are marked, so that parts can't run into each other."""
    said = "|".join("" if p is None else str(p).replace("\\", "\\\\").replace("|", "\\|") for p in parts)
    return hmac_lib.new(key, said.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()


def _macs(key: bytes, *columns: Column) -> Column:
    """mac of each row's columns."""

    def one(a: pd.Series) -> pd.Series:
        return a.map(lambda row: mac(key, *row))

    # one array of strings: longs stay exact where some are null
    return F.pandas_udf(one, "string")(F.array(*(c.cast("string") for c in columns)))


def _entry_mac(key: bytes) -> Column:
    return _macs(key, *(F.col(c) for c in ("seq", "ts", "event", "case_ref", "meta", "prev_mac")))


def sealed(entries: DataFrame, key: bytes, last: dict | None = None, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """entries: seq (without gaps, going on after `last`), ts, event, case_ref, meta. The entries with segment, prev_mac and mac, and their anchors.

    last: the anchor before them (a dict of its columns); none at the beginning.
    """
    last = last or {"segment": -1, "last_seq": 0, "anchor": GENESIS}
    segment = F.floor((F.col("seq") - 1 - last["last_seq"]) / size) + last["segment"] + 1
    rows = entries.select(segment.cast("long").alias("key"), F.col("seq").cast("long"), F.col("ts").cast("long"), F.col("event").cast("string"), F.col("case_ref").cast("string"), F.col("meta").cast("string"))

    def chain(state: list, row: tuple) -> tuple:
        before = state[0] if state else mac(key, "segment", row[0])
        state[:] = [mac(key, *row[1:], before)]
        return *row, before, state[0]

    out = written(fold(rows, ["seq"], list, chain, ENTRY))
    heads = out.groupBy("segment").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("mac", "seq").alias("head"))

    def link(state: list, row: tuple) -> tuple:
        before = state[0] if state else last["anchor"]
        state[:] = [mac(key, "anchor", *row[1:], before)]
        return *row[1:], before, state[0]

    return out, fold(heads.select(F.lit(0).alias("key"), "segment", "first_seq", "last_seq", "head"), ["segment"], list, link, ANCHOR)


class Log:
    """A log in a folder that driver and executors share: entries and anchors by batch. A batch is there once its anchors are."""

    def __init__(self, spark: SparkSession, folder: str, size: int = SEGMENT):
        self.spark, self.folder, self.size = spark, folder, size
        for name, schema in (("entries", ENTRY), ("anchors", ANCHOR)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}/batch=-1")

    def anchors(self) -> DataFrame:
        return self.spark.read.schema(f"{ANCHOR}, batch long").parquet(f"{self.folder}/anchors")

    def entries(self) -> DataFrame:
        """Those of batches that are there."""
        rows = self.spark.read.schema(f"{ENTRY}, batch long").parquet(f"{self.folder}/entries")
        return rows.join(F.broadcast(self.anchors().select("batch").distinct()), "batch", "left_semi")

    def append(self, entries: DataFrame, batch: int, key: bytes, order: list[str]) -> None:
        """entries: ts, event, case_ref, meta and what else `order` names. A batch that is there already is left as it is; an empty one leaves no trace.

        As a stream's foreachBatch this makes a batch that is run again count once.
        """
        known = self.anchors()
        if known.where(F.col("batch") == batch).limit(1).count():
            return
        tail = known.where(F.col("batch") < batch).orderBy(F.desc("segment")).first()
        last = tail.asDict() if tail else None
        rows = numbered(entries, order).withColumn("seq", F.col("nth") + (last["last_seq"] if last else 0))
        done, anchors = sealed(rows, key, last, self.size)
        done.write.mode("overwrite").parquet(f"{self.folder}/entries/batch={batch}")
        anchors.write.mode("overwrite").parquet(f"{self.folder}/anchors/batch={batch}")


def faults(entries: DataFrame, anchors: DataFrame, key: bytes, head: dict | None = None) -> DataFrame:
    """segment, seq, fault: what is wrong with a log, each place and fault once. Nothing is gathered but the anchors' last row.

    altered: an entry doesn't have its MAC; double: it is there twice; gap, truncated: it is missing, with or without entries after
    it; unlinked: it doesn't follow the entry before it; unanchored: no anchor covers it (the last append was broken off);
    anchor_altered, anchor_unlinked, anchor_missing, head: an anchor's own MAC, its link, a segment without one, and an anchor whose last
    entry has another MAC. head: the last anchor as it was noted elsewhere; a log that ends before it is rolled_back.
    """
    rows = entries.select(*(x.split()[0] for x in ENTRY.split(", ")))
    said = anchors.select("segment", "first_seq", "last_seq", "head", "prev_anchor", "anchor")
    out = [rows.where(_entry_mac(key) != F.col("mac")).select("segment", "seq", F.lit("altered").alias("fault"))]
    out.append(rows.groupBy("segment", "seq").count().where("count > 1").select("segment", "seq", F.lit("double").alias("fault")))
    one = rows.groupBy("segment", "seq").agg(F.min("prev_mac").alias("prev_mac"), F.min("mac").alias("mac"))
    before = one.select("segment", (F.col("seq") + 1).alias("seq"), F.col("mac").alias("before"))
    ranges = said.select("segment", "first_seq", "last_seq")
    linked = one.join(before, ["segment", "seq"], "left").join(ranges, "segment", "left")
    due = F.when(F.col("seq") == F.col("first_seq"), _macs(key, F.lit("segment"), F.col("segment"))).otherwise(F.col("before"))
    out.append(linked.where(F.col("first_seq").isNull()).select("segment", "seq", F.lit("unanchored").alias("fault")))
    out.append(linked.withColumn("due", due).where(F.col("due") != F.col("prev_mac")).select("segment", "seq", F.lit("unlinked").alias("fault")))
    # only segments that lack entries are spelled out, each of a bounded number
    held = one.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    short = ranges.join(held, "segment", "left").where(F.coalesce("n", F.lit(0)) < F.col("last_seq") - F.col("first_seq") + 1)
    missing = short.select("segment", F.explode(F.sequence("first_seq", "last_seq")).alias("seq")).join(one.select("segment", "seq"), ["segment", "seq"], "left_anti")
    most = F.broadcast(one.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("most")))
    out.append(missing.crossJoin(most).select("segment", "seq", F.when(F.col("seq") > F.col("most"), "truncated").otherwise("gap").alias("fault")))
    # the anchors themselves
    own = _macs(key, F.lit("anchor"), *(F.col(c) for c in ("segment", "first_seq", "last_seq", "head", "prev_anchor")))
    place = F.col("first_seq").alias("seq")
    out.append(said.where(own != F.col("anchor")).select("segment", place, F.lit("anchor_altered").alias("fault")))
    previous = said.select((F.col("segment") + 1).alias("segment"), F.col("anchor").alias("due"), (F.col("last_seq") + 1).alias("due_seq"))
    both = said.join(previous, "segment", "left")
    first = F.col("segment") == 0
    wrong = F.when(first, (F.col("prev_anchor") != GENESIS) | (F.col("first_seq") != 1)).otherwise((F.col("prev_anchor") != F.col("due")) | (F.col("first_seq") != F.col("due_seq")))
    out.append(both.where(wrong).select("segment", place, F.lit("anchor_unlinked").alias("fault")))
    out.append(both.where(~first & F.col("due").isNull()).select((F.col("segment") - 1).alias("segment"), (F.col("first_seq") - 1).alias("seq"), F.lit("anchor_missing").alias("fault")))
    ends = said.join(one.select("segment", F.col("seq").alias("last_seq"), "mac"), ["segment", "last_seq"])
    out.append(ends.where("mac <> head").select("segment", F.col("last_seq").alias("seq"), F.lit("head").alias("fault")))
    if head:
        found = said.where((F.col("segment") == head["segment"]) & (F.col("anchor") == head["anchor"])).limit(1).count()
        if not found:
            out.append(entries.sparkSession.range(1).select(F.lit(head["segment"]).cast("long").alias("segment"), F.lit(head["last_seq"]).cast("long").alias("seq"), F.lit("rolled_back").alias("fault")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def status(found: DataFrame) -> str:
    """intact; lagging, where all that is wrong is that the last entries have no anchor yet; or broken."""
    kinds = {r["fault"] for r in found.select("fault").distinct().collect()}
    return "intact" if not kinds else "lagging" if kinds == {"unanchored"} else "broken"
