"""Changes to stored rows as projections: each returns the table as it is afterwards. Writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.insights import fold_visits
from quillspark.operators.records import ancestors, written


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among those that go."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def trashed(rows: DataFrame, asked: DataFrame, today: str) -> DataFrame:
    """rows: id. With trashed_on: today for those asked for."""
    marks = asked.select("id").distinct().withColumn("trashed_on", F.lit(today).cast("date"))
    return rows.drop("trashed_on").join(marks, "id", "left")


def restored(rows: DataFrame, asked: DataFrame) -> DataFrame:
    marks = asked.select("id").distinct().withColumn("back", F.lit(True))
    return rows.join(marks, "id", "left").withColumn("trashed_on", F.when(F.col("back").isNull(), F.col("trashed_on"))).drop("back")


def trashed_before(rows: DataFrame, cutoff: str) -> DataFrame:
    return rows.where(F.col("trashed_on") < F.lit(cutoff).cast("date"))


def transition(rows: DataFrame, asked: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Rows of the keys asked for whose status is `old` get `new`."""
    marks = asked.select(*keys).distinct().withColumn("asked", F.lit(True))
    out = rows.join(marks, keys, "left")
    return out.withColumn("status", F.when(F.col("asked") & (F.col("status") == old), new).otherwise(F.col("status"))).drop("asked")


def merged(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, new values, action: insert, delete, update or keep. Keys stay as they are."""
    a, b = old.select(*keys, F.struct(*values).alias("a")), new.select(*keys, F.struct(*values).alias("b"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update").otherwise("keep")
    return a.join(b, keys, "full").select(*keys, *(F.col("b")[v].alias(v) for v in values), action.alias("action"))


def next_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """key, version of each key's next row."""
    return rows.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("version"))


def appended(rows: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The rows, and the new ones with each key's next version (1 for keys without rows)."""
    at = next_version(rows, key, version)
    more = new.join(at, key, "left").withColumn(version, F.coalesce("version", F.lit(1)).cast(rows.schema[version].dataType)).select(*rows.columns)
    return rows.unionByName(more)


def erased(visits: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the visits, and the anonymous tally of those that go: two outputs of one table."""
    return without(visits, gone, ["patient_id"]), fold_visits(visits.join(gone.select("patient_id").distinct(), "patient_id", "left_semi"))


def placed(rows: DataFrame, group: list[str], moved: Column, after: Column, ties: list[str]) -> DataFrame:
    """Rows that move stand right after the place `after`; then each group is numbered again from 1."""
    at = F.when(moved, after + 0.5).otherwise(F.col("position"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(at, *ties)))


def without_folders(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """nodes: id, parent. Children of a folder that goes are lifted to the nearest one above it that stays."""
    going = nodes.join(gone.select("id").distinct(), "id", "left_semi")
    among = going.join(going.select(F.col("id").alias("parent"), F.lit(True).alias("too")), "parent", "left").select("id", F.when(F.col("too"), F.col("parent")).alias("parent"))
    above = going.select(F.col("id").alias("root"), F.col("parent").alias("above"))
    up = ancestors(among).join(above, "root").select(F.col("id").alias("parent"), "above", F.lit(True).alias("gone"))
    out = nodes.join(up, "parent", "left").select("id", F.when(F.col("gone"), F.col("above")).otherwise(F.col("parent")).alias("parent"))
    return out.join(gone.select("id").distinct(), "id", "left_anti")


def closure(nodes: DataFrame) -> DataFrame:
    """id, at: every node with itself and all that are above it. Pairs of rising distance are joined, so a depth of n takes log n joins."""
    pairs = written(nodes.select("id", F.col("id").alias("at")).unionByName(nodes.where("parent is not null").select("id", F.col("parent").alias("at"))).distinct())
    n = pairs.count()
    while True:
        further = pairs.join(pairs.select(F.col("id").alias("at"), F.col("at").alias("to")), "at").select("id", F.col("to").alias("at"))
        pairs = written(pairs.unionByName(further).distinct())
        now = pairs.count()
        if now == n:
            return pairs
        n = now


def cycles(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: id, target. With cycle: whether the target is below the folder that moves, or is it."""
    up = closure(nodes).select(F.col("id").alias("target"), F.col("at").alias("id"), F.lit(True).alias("cycle"))
    return moves.join(up, ["id", "target"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
