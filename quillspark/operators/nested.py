"""Strings of JSON texts at any depth, level by level.

A level's objects and arrays are taken apart where they are; their strings are results, and what is an object or array again makes the
next level. So a text takes as many steps as it is deep, whatever its shape, and no row holds more than one value's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.records import written


def _step(key: Column, pos: Column) -> Column:
    """A place's last part: .name, ."any other name" or [number]."""
    quoted = F.concat(F.lit('."'), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(quoted)


def bad(docs: DataFrame) -> DataFrame:
    """docs: id, body. The ids of bodies that are no JSON, or hold a name twice in one object; null bodies are not told."""
    return docs.where(F.col("body").isNotNull() & F.try_parse_json("body").isNull()).select("id")


def strings(docs: DataFrame) -> DataFrame:
    """docs: id, body. id, path, value of every string value (not names of fields), at any depth; none of bodies that are bad (see bad).

    Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    level = docs.select("id", F.lit("$").alias("path"), F.try_parse_json("body").alias("v")).where("v is not null")
    kind = lambda v: F.schema_of_variant(v)
    said = lambda rows: rows.where(kind("v") == "STRING").select("id", "path", F.variant_get("v", "$", "string").alias("value"))
    deeper = lambda rows: rows.where(kind("v").rlike("^(OBJECT|ARRAY)<")).select("id", "path", F.to_json("v").alias("body"))
    out, level = said(level), written(deeper(level))
    while level.limit(1).count():
        parsed = level.select("id", "path", F.parse_json("body").alias("whole"))
        parts = parsed.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer())).select("id", F.concat("path", _step(F.col("key"), F.col("pos"))).alias("path"), F.col("value").alias("v"))
        out, level = out.unionByName(said(parts)), written(deeper(parts))
    return out
