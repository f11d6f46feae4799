"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, and nothing else that the table may hold."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(docs[c] for c in more))


def crc_of(doc_id: Column) -> Column:
    """CRC-32 of the id as decimal text; null where the id is null."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def small_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python hold some megabytes, also of very long texts, unless the session has them smaller."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def map_texts(docs: DataFrame, start: Callable[[], Callable[..., dict[str, list]]], schema: str) -> DataFrame:
    """Map rows in Arrow batches. start() runs once in each task and returns a function of the columns' value lists.

    A function of name `done` on it is called at the task's end: Python workers outlive tasks, and so would what they keep.
    """
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = work(*(part.column(c).to_pylist() for c in range(len(names))))
                if out:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        getattr(work, "done", lambda: None)()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return docs.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: later steps neither compute it again nor need this executor.

    What was shuffled to make it can go: the driver collects its garbage, so that Spark's cleaner drops those files now
    and not at some later time.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(table: DataFrame) -> None:
    """Give the disk of a stored table back, once nothing that is still to run reads it: its rows are written over with none."""
    files = table.inputFiles()
    if files:
        table.sparkSession.range(0).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


#: Rows of a few longs or an id that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """A stored table of narrow rows is broadcast if it has BROADCAST_ROWS at most."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows, the first by a hash of the key: the same keys each time; all rows where there are no more."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(bound)


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """doc_id, text, label of at most `bound` labelled documents for which `keep` (over doc_id) holds.

    Only the labels are sampled and sent to the texts, so no text moves but those that are learned from. Null labels and
    null ids are left out; of an id with several labels the largest counts.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(keep)
    return texts_of(docs).join(F.broadcast(bounded_sample(known, "doc_id", bound)), "doc_id")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over edges hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (longs) to node, root: the least node that each node can reach. Nodes without an edge to another are left out.

    Large-star and small-star steps until nothing changes; each step is a table in the shared folder, so no lineage
    grows and a lost executor costs one step. No list of neighbours is gathered: a step is a minimum and a join by node.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = stored(now, "links")
    seen = None
    while True:
        now = stored(_stars(now), "stars")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, id, tie, text and more columns: id is doc_id (null: the largest long), tie tells apart different texts that share an id.

    Rows of one id and one text keep one key: they count as one document.
    """
    rows = texts_of(docs, *more).withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    shared = rows.groupBy("id").count().where("count > 1").select("id")
    if not shared.limit(1).count():
        return rows.select("doc_id", "id", F.lit(0).alias("tie"), "text", *more)
    rows = rows.withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    versions = rows.join(shared, "id", "left_semi").select("id", "version").distinct()
    ties = versions.withColumn("tie", F.dense_rank().over(Window.partitionBy("id").orderBy("version")) - 1)
    return rows.join(ties, ["id", "version"], "left").select("doc_id", "id", F.coalesce("tie", F.lit(0)).alias("tie"), "text", *more)
