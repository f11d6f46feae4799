"""Stored-record operators: keyset pages, chains, versions, soft deletes, trees, usage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame) -> DataFrame:
    """The table, written to the folder that driver and executors share, so that no lineage grows."""
    path = f"{shared(df.sparkSession)}/steps-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python hold some megabytes, also of very long texts, unless the session has them smaller."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with nth, from 1, in this order (which should be total). Rows are sorted in ranges; no task sees them all."""
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").count()
    # one row for each range
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(F.broadcast(counts.select("range", before.alias("before"))), "range").withColumn("nth", nth).drop("range", "before")


def keyset_page(rows: DataFrame, at: str, key: str, before: tuple, size: int) -> DataFrame:
    """The `size` newest rows before the cursor (at, key). Top-k by partition, then merged."""
    older = (F.col(at) < F.lit(before[0])) | ((F.col(at) == F.lit(before[0])) & (F.col(key) < F.lit(before[1])))
    return rows.where(older).orderBy(F.desc(at), F.desc(key)).limit(size)


def find_newest(rows: DataFrame, needle: str, text: str, key: str) -> DataFrame:
    return rows.where(F.contains(text, F.lit(needle))).orderBy(F.desc(key)).limit(1)


def chain_faults(log: DataFrame) -> DataFrame:
    """seq, fault: rows whose predecessor is missing (gap) or whose prev is not its mac (altered). The first row may have none.

    The predecessor is found by seq - 1: a join on a key, where lag() over the whole log would be one task's.
    """
    first = log.agg(F.min("seq").alias("least"))
    rows = log.join(log.select((F.col("seq") + 1).alias("seq"), F.col("mac").alias("before"), F.lit(True).alias("there")), "seq", "left").crossJoin(F.broadcast(first))
    fault = F.when(F.col("there").isNull() & (F.col("seq") > F.col("least")), "gap").when(F.col("there") & ~F.col("prev").eqNullSafe(F.col("before")), "altered")
    return rows.select("seq", fault.alias("fault")).where("fault is not null")


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last n versions of each key, numbered from 1."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("version") <= n)


def ancestors(nodes: DataFrame) -> DataFrame:
    """nodes: id, parent. id, root, depth: pointers are doubled, so a chain of length n takes log n joins.

    A parent that isn't among the nodes counts as a root. In and below a cycle there is none: root and depth are null.
    """
    now = nodes.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("parent").isNull().alias("done"))
    before = None
    while True:
        # each step finishes a node of some depth, or all that are left hang on cycles
        now = written(now)
        left = now.where("not done").count()
        if left in (0, before):
            break
        before = left
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        step = now.join(above, "up", "left")
        now = step.select(
            "id",
            F.when(F.col("done"), F.col("up")).otherwise(F.coalesce("next", "up")).alias("up"),
            F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            (F.col("done") | F.coalesce("ends", F.lit(True))).alias("done"),
        )
    return now.select("id", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def default_until(changed: Column, birth: Column, years: int, age: int) -> Column:
    """Some years after the last change, and not before an age where the birth date is known."""
    return F.greatest(F.add_months(changed, 12 * years), F.coalesce(F.add_months(birth, 12 * age), F.lit("1900-01-01").cast("date")))


def retention_due(rows: DataFrame, changed: str, today: str, years: int, age: int) -> DataFrame:
    """rows: id, birth_date and a date of change. id, until of those that needn't be kept any longer."""
    until = default_until(F.col(changed), F.col("birth_date"), years, age)
    return rows.select("id", until.alias("until")).where(F.col("until") <= F.lit(today).cast("date"))


def usage_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows: month, model, tokens; prices: model, price (for a million). month, model, tokens, cost (rounded up; null without a price)."""
    sums = rows.groupBy("month", "model").agg(F.sum("tokens").alias("tokens"))
    return sums.join(prices, "model", "left").select("month", "model", "tokens", F.ceil(F.col("tokens") * F.col("price") / 1_000_000).cast("long").alias("cost"))


def token_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows: month, model, input, output, cache_write, cache_read; prices: model, p_in, p_out, p_read (for a million). month, model, cost, priced.

    Writing to the cache costs a quarter more than input; the cost is rounded up. Models without a price have none and are told so.
    """
    names = ("input", "output", "cache_write", "cache_read")
    sums = rows.groupBy("month", "model").agg(*(F.sum(c).alias(c) for c in names)).join(prices, "model", "left")
    parts = F.col("input") * F.col("p_in") * 4 + F.col("output") * F.col("p_out") * 4 + F.col("cache_write") * F.col("p_in") * 5 + F.col("cache_read") * F.col("p_read") * 4
    return sums.select("month", "model", F.ceil(parts / 4_000_000).cast("long").alias("cost"), F.col("p_in").isNotNull().alias("priced"))


def over_cap(costs: DataFrame, cap: int) -> DataFrame:
    """costs: month, cost. month, cost, over of each month's sum."""
    return costs.groupBy("month").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost")).withColumn("over", F.col("cost") >= cap)


def any_older(rows: DataFrame, at: str, key: str, before: tuple) -> DataFrame:
    """One row: whether anything is older than the cursor. Stops at the first row found."""
    return keyset_page(rows, at, key, before, 1).agg((F.count(F.lit(1)) > 0).alias("older"))


def found_page(rows: DataFrame, needle: str, text: str, at: str, key: str, before: tuple, size: int) -> DataFrame:
    """A page of the rows that hold the needle, newest first."""
    return keyset_page(rows.where(F.contains(F.lower(text), F.lit(needle.lower()))), at, key, before, size)


def with_labels(page: DataFrame, labels: DataFrame, key: str, default: str = "deleted") -> DataFrame:
    """labels: key, label. A log's page with each row's label; rows whose case is gone get the default, rows without a case none."""
    return page.join(labels.select(key, "label"), key, "left").withColumn("label", F.when(F.col(key).isNotNull(), F.coalesce("label", F.lit(default))))


def summaries(cases: DataFrame, people: DataFrame, sections: DataFrame, trashed: bool = False) -> DataFrame:
    """cases: case_id, trashed; people: case_id, rowid, value; sections: case_id, section, approved. case_id, first_name, sections (sorted, of approved ones), open (the first that isn't)."""
    first = people.groupBy("case_id").agg(F.min(F.struct("rowid", "value")).alias("x")).select("case_id", F.col("x.value").alias("first_name"))
    done = sections.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("approved"), F.col("section")))), ",").alias("sections"), F.min(F.when(~F.col("approved"), F.col("section"))).alias("open"))
    rows = cases.where(F.col("trashed") == trashed).select("case_id").join(first, "case_id", "left").join(done, "case_id", "left")
    return rows.withColumn("sections", F.coalesce("sections", F.lit("")))


def version_chain(drafts: DataFrame) -> DataFrame:
    """drafts: id, replaces. id, version, at: each draft with those it replaced, directly or not; at counts back from 0. Follows any length."""
    from quillspark.operators.stored_rows import closure

    up = closure(drafts.select("id", F.col("replaces").alias("parent")))
    order = Window.partitionBy("id").orderBy(F.desc("depth"), "version")
    depth = up.groupBy(F.col("id").alias("version")).agg(F.count(F.lit(1)).alias("depth"))
    return up.withColumnRenamed("at", "version").join(depth, "version").withColumn("at", F.row_number().over(order) - 1).select("id", "version", "at")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). node, root: the least node that each node can reach. Nodes without an edge to another are left out.

    Each node sends its larger neighbours to its least one, then its smaller ones, until nothing changes; a step is a minimum
    and a join by node, and no list of neighbours is gathered.
    """

    def towards_least(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a" if larger else "b < a").join(least, "a").where("b <> m")
        sent = moved.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        return sent if larger else sent.unionByName(least.where("m < a").select("a", F.col("m").alias("b")))

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = written(towards_least(written(towards_least(now, True).distinct()), False).distinct())
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
