"""Ranked lexical search by windowed bucket scoring.

`build` turns documents into an index of windows: each window holds the postings of WINDOW consecutive documents at most,
by term, with slots (places in the window) and frequencies. `search` goes through the windows once for each block of items.
For an item the postings of its terms in a window are added up in one array of WINDOW 64-bit sums, small enough for a
processor's first cache; a bitset tells which slots were met; only those are harvested into the item's heap of k, and set
back to zero. A task sends on k rows an item at most, and these meet in two steps.

Scores are 64-bit integers with floor division, so they don't hang on the order of sums or on how rows are dealt. N, L and the
document frequencies are counted over all documents.

Null and empty texts have no terms: they are never found and don't count in N. Rows of one id are documents of their own; equal
scores go by id, null ids last, and rows alike in both are interchangeable. Rows of one item_id and text are one item; null texts
find nothing. Empty tables give no rows. Further columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_ROWS, small_batches, stored, table, texts_of

#: Slots of a window; the sums of one are 32 KB.
WINDOW = 4096
#: A window ends early once it has so many postings; results don't change.
WINDOW_POSTINGS = 4_000_000
#: Rows of items' terms that are searched for at once, as all tasks are sent them.
BLOCK_TERMS = 500_000
#: Fixed values of the score.
B_PERCENT, K1_PERCENT = 25, 12
LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() and c >= 0x30 else 0x20 for c in range(256)).lower()
INDEX = "doc_ids array<long>, lengths array<int>, terms string, held array<int>, slots binary, freqs binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LETTERS).split()


def _window(doc_ids: list, lengths: list[int], ids: dict[bytes, int], codes: list[int], freqs: list[int], distinct: list[int]) -> pa.RecordBatch:
    """One row of the index; terms in byte order, each with its postings by slot."""
    terms = sorted(ids)
    place = np.empty(len(terms), np.int64)
    place[[ids[t] for t in terms]] = np.arange(len(terms))
    of = place[np.array(codes, np.int64)]
    order = np.argsort(of, kind="stable")
    slots = np.repeat(np.arange(len(distinct), dtype=np.uint16), distinct)[order]
    return pa.RecordBatch.from_pydict(
        {
            "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int32())),
            "terms": [b" ".join(terms).decode()],
            "held": pa.array([np.bincount(of, minlength=len(terms)).astype(np.int32)], pa.list_(pa.int32())),
            "slots": [slots.tobytes()],
            "freqs": [np.array(freqs, np.int32)[order].tobytes()],
        }
    )


def build(docs: DataFrame) -> DataFrame:
    """The index: a row for each window. Documents without a term are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            return [], [], defaultdict(count().__next__), [], [], []

        now = fresh()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = terms_of(text)
                    if not words:
                        continue
                    doc_ids, lengths, ids, codes, freqs, distinct = now
                    counted = Counter(words)
                    doc_ids.append(doc_id)
                    lengths.append(len(words))
                    codes.extend(map(ids.__getitem__, counted))
                    freqs.extend(counted.values())
                    distinct.append(len(counted))
                    if len(doc_ids) == WINDOW or len(codes) >= WINDOW_POSTINGS:
                        yield _window(*now)
                        now = fresh()
        if now[0]:
            yield _window(*now)

    return texts_of(docs).mapInArrow(run, INDEX)


def totals(index: DataFrame) -> tuple[int, int]:
    """N, L: documents with a term, and all their terms."""
    row = index.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    return int(row[0] or 0), int(row[1] or 0)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, item (tells apart texts of one id), term, times."""
    text = F.coalesce(items["text"].cast("string"), F.lit(""))
    rows = items.select(items["item_id"].alias("item_id"), F.xxhash64(text).alias("item"), text.alias("text")).distinct()
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.select("item_id", "item", F.explode(F.split(lowered, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("term")).where("term <> ''")
    return words.groupBy("item_id", "item", "term").agg(F.count(F.lit(1)).alias("times"))


def weighted(index: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """The terms that some document holds, with their weight times how often the item has them."""
    asked = terms.select("term").distinct()
    held = index.select(F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("held").alias("df"))).alias("t")).select("t.*")
    df = held.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    return terms.join(df, "term").select("item_id", "item", "term", (weight * F.col("times")).cast("long").alias("weight"))


class _Harvest:
    """The k best of an item so far: a heap with the worst on top."""

    __slots__ = ("k", "heap")

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, scores: np.ndarray, slots: np.ndarray, doc_ids: list) -> None:
        if len(self.heap) == self.k:
            over = scores >= self.heap[0][0]
            scores, slots = scores[over], slots[over]
        if len(scores) > self.k:
            over = scores >= np.partition(scores, -self.k)[-self.k]
            scores, slots = scores[over], slots[over]
        for score, slot in zip(scores.tolist(), slots.tolist(), strict=True):
            doc_id = doc_ids[slot]
            row = (score, doc_id is not None, -(doc_id or 0))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, row)
            elif row > self.heap[0]:
                heapq.heapreplace(self.heap, row)


def _score(window: dict, asked: dict[str, int], items: list[list[tuple[int, int]]], heaps: list[_Harvest], documents: int, length: int) -> None:
    """Add the window's postings up for each item and harvest."""
    n = np.array(window["lengths"], np.int64)
    m = 100 - B_PERCENT + (B_PERCENT * n * documents) // length
    slots = np.frombuffer(window["slots"], np.uint16).astype(np.intp)
    freqs = np.frombuffer(window["freqs"], np.int32).astype(np.int64)
    ends = np.cumsum(window["held"])
    lists = {}
    for i, term in enumerate(window["terms"].split(" ")):
        code = asked.get(term)
        if code is not None:
            begin, end = int(ends[i - 1]) if i else 0, int(ends[i])
            at, tf = slots[begin:end], freqs[begin:end]
            bits = np.zeros(WINDOW, np.bool_)
            bits[at] = True
            lists[code] = at, (1_000_000_000 * tf) // (1000 * tf + K1_PERCENT * m[at]), np.packbits(bits)
    sums = np.zeros(WINDOW, np.int64)
    for terms, heap in zip(items, heaps, strict=True):
        met = np.zeros(WINDOW // 8, np.uint8)
        for code, weight in terms:
            postings = lists.get(code)
            if postings is not None and weight > 0:
                at, part, bits = postings
                sums[at] += weight * part
                met |= bits
        found = np.flatnonzero(np.unpackbits(met))
        if len(found):
            scores = sums[found]
            sums[found] = 0
            above = scores > 0
            heap.add(scores[above], found[above], window["doc_ids"])


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, item, rank, doc_id, score of the k best documents of each item. The index is read several times: store it.

    Items go in blocks of about BLOCK_TERMS terms, so that what tasks are sent is bounded.
    """
    spark = index.sparkSession
    documents, length = totals(index)
    terms = stored(weighted(index, query_terms(items), documents), "asked")
    blocks = -(-max(terms.count(), 1) // BLOCK_TERMS)
    best = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block)
        found = _search_block(spark, index, rows, documents, length, k)
        best = found if best is None else best.unionByName(found)
    part = Window.partitionBy("item_id", "item", "part").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    whole = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    near = best.withColumn("at", F.row_number().over(part)).where(F.col("at") <= k)
    return near.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("item_id", "item", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, index: DataFrame, rows: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """item_id, item, part (tells some tasks from others), doc_id, score: the k best of each task."""
    asked: dict[str, int] = {}
    of: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for r in rows.toLocalIterator():
        of[r["item_id"], r["item"]].append((asked.setdefault(r["term"], len(asked)), r["weight"]))
    sent = spark.sparkContext.broadcast((asked, list(of.values()), list(of)))
    kind = dict(rows.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked, items, names = sent.value
        heaps = [_Harvest(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                _score(batch.slice(i, 1).to_pylist()[0], asked, items, heaps, documents, length)
        context = TaskContext.get()
        part = context.partitionId() % 64 if context else 0
        for (item_id, item), heap in zip(names, heaps, strict=True):
            if heap.heap:
                yield pa.RecordBatch.from_pydict(
                    {"item_id": [item_id] * len(heap.heap), "item": [item] * len(heap.heap), "part": [part] * len(heap.heap), "doc_id": [-x[2] if x[1] else None for x in heap.heap], "score": [x[0] for x in heap.heap]}, schema=arrow
                )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"item_id {kind}, item long, part int, doc_id long, score long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return index.mapInArrow(run, schema)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    index = stored(build(table(spark, sf_dir, "documents")), "index")
    return search(index, table(spark, sf_dir, "benchmark"), 20).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
b AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT item_id, text, term, times * CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), s),
c AS (SELECT p.rid, d.doc_id, p.term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)) AS c FROM p JOIN d USING (rid), s),
r AS (SELECT item_id, text, rid, doc_id, CAST(sum(w * c) AS BIGINT) AS score FROM w JOIN c USING (term) GROUP BY ALL HAVING sum(w * c) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
