"""Derived tables that are kept up from what changed, key by key, without being made anew.

A derived table is a folder of versions: each refresh computes the keys that changed, from their base rows alone, and writes those
whose rows came out different, and marks for those that are gone. Reading takes each key's last version. What a refresh
costs follows what changed, but for one look through the keys that are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.records import written
from quillspark.operators.text import small


class Derived:
    """compute(base rows) gives rows with the key column; rows of one key hang on base rows of that key alone. Keys aren't null."""

    def __init__(self, spark: SparkSession, folder: str, key: str, compute: Callable[[DataFrame], DataFrame], schema: str):
        self.spark, self.folder, self.key, self.compute = spark, folder, key, compute
        self.columns = [c.strip().split()[0] for c in schema.split(",")]
        self.schema = f"{schema}, version long, gone boolean"
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(folder)

    def versions(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def current(self) -> DataFrame:
        """The derived rows, with the version that each key was last written in."""
        return self._last(self.versions()).where("not gone").drop("gone")

    def _last(self, rows: DataFrame) -> DataFrame:
        last = F.max("version").over(Window.partitionBy(self.key))
        return rows.withColumn("last", last).where("version = last").drop("last")

    def refresh(self, base: DataFrame, changed: DataFrame, version: int) -> DataFrame:
        """changed: the key column, of every key with a base row that is new, gone or different. The keys that were written.

        Run again with the same version it writes nothing that is there: what it would write is then as it stands.
        """
        keys = small(changed.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        now = self.compute(base.join(keys, self.key, "left_semi")).select(*self.columns)
        before = self._last(self.versions().join(keys, self.key, "left_semi"))
        # equal rows are counted, so that a key's rows are compared as a whole, in any order
        rows = F.struct(*(c for c in self.columns if c != self.key))
        digest = lambda df: df.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.xxhash64(rows))).alias("digest"))
        new, old = digest(now), digest(before.where("not gone"))
        differ = new.withColumnsRenamed({"n": "new_n", "digest": "new_digest"}).join(old, self.key, "full").where(~(F.col("new_n").eqNullSafe(F.col("n")) & F.col("new_digest").eqNullSafe(F.col("digest"))))
        differ = written(differ.select(self.key, F.col("new_n").isNull().alias("gone")))
        live = now.join(small(differ.where("not gone").select(self.key)), self.key, "left_semi").select(*self.columns, F.lit(version).cast("long").alias("version"), F.lit(False).alias("gone"))
        kinds = dict(self.versions().dtypes)
        marks = differ.where("gone").select(*(F.col(c) if c == self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns), F.lit(version).cast("long").alias("version"), F.lit(True).alias("gone"))
        written(live.unionByName(marks)).write.mode("append").parquet(self.folder)
        return differ.select(self.key)

    def compact(self, folder: str) -> Derived:
        """The current rows alone, in another folder."""
        self.current().withColumn("gone", F.lit(False)).write.parquet(folder)
        return Derived(self.spark, folder, self.key, self.compute, ", ".join(x for x in self.schema.split(", ") if not x.startswith(("version ", "gone "))))
