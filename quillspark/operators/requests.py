"""Requests made to fit: the longest blocks of a request are cut until its size is within a limit, each at most once.

What a loop would do block by block follows from sums over a request's blocks in order of length: each block that is cut to the floor
saves an amount that doesn't hang on the others, so the bytes still too many before a block are the whole excess less the
savings before it. The first block that is enough is cut just as far as needed, and those after it stay whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTE = "\n(The rest of this was not sent, as the request was too long.)"


def cut(text: str, keep: int) -> str:
    """At most `keep` bytes of a text: up to its last line end if that lies in the second half, or else its last blank there, or else whole characters. A tag isn't cut through."""
    head = text.encode()[:keep].decode("utf-8", "ignore")
    at = len(head.encode())
    for mark in ("\n", " "):
        i = head.rfind(mark)
        if i >= 0 and len(head[:i].encode()) >= at // 2:
            head = head[:i]
            break
    opened, closed = head.rfind("["), head.rfind("]")
    return head[:opened] if opened > closed else head


def kept_part(text: Column, keep: Column) -> Column:
    """cut of each row; null where either is."""

    def run(texts: pd.Series, keeps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or pd.isna(k) else cut(t, int(k)) for t, k in zip(texts, keeps, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(text, keep)


def shrunk(blocks: DataFrame, most: int, rest: int = 0, floor: int = 400, margin: int = 2048, note: str = NOTE) -> DataFrame:
    """blocks: request, block, text. request, block, total and kept (bytes), text, outcome of the request: fits, shrunk or refused.

    A request's size is the bytes of its blocks and `rest`. Over `most`, its longest block (of equal ones the last) is cut to end
    `margin` below the limit, but not under `floor` bytes, and ends with the note; if that isn't enough the next longest follows. Where
    all blocks over the floor are cut and it is still too large it is refused, and its blocks come back whole. margin must be at least
    the note's bytes. Null texts are empty. A request's (request, block) pairs are distinct.
    """
    if margin < len(note.encode()):
        raise ValueError("the margin has no room for the note")
    one = Window.partitionBy("request")
    sized = blocks.select("request", "block", F.coalesce("text", F.lit("")).alias("text")).withColumn("total", F.octet_length("text"))
    sized = sized.withColumn("size", F.sum("total").over(one) + rest)
    over = (F.col("size") > most) & (F.col("total") > floor)
    at_floor = sized.withColumn("least", kept_part(F.when(over, F.col("text")), F.lit(floor)))
    saving = F.when(F.col("least").isNotNull(), F.col("total") - F.octet_length("least") - len(note.encode())).otherwise(0)
    longest = one.orderBy(F.desc("total"), F.desc("block"))
    saved = at_floor.withColumn("saving", saving).withColumn("before", F.col("size") - F.coalesce(F.sum("saving").over(longest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keep = F.when(F.col("least").isNotNull() & (F.col("before") > most), F.greatest(F.col("total") - (F.col("before") - most + margin), F.lit(floor)))
    asked = saved.withColumn("keep", keep)
    part = F.when(F.col("keep") == floor, F.col("least")).otherwise(kept_part(F.when(F.col("keep") > floor, F.col("text")), F.col("keep")))
    done = asked.withColumn("part", part).withColumn("after", F.sum(F.when(F.col("part").isNull(), F.col("total")).otherwise(F.octet_length("part") + len(note.encode()))).over(one) + rest)
    outcome = F.when(F.col("size") <= most, "fits").when(F.col("after") <= most, "shrunk").otherwise("refused")
    goes = (outcome == "shrunk") & F.col("part").isNotNull()
    return done.select("request", "block", "total", F.when(goes, F.octet_length("part")).otherwise(F.col("total")).alias("kept"), F.when(goes, F.concat("part", F.lit(note))).otherwise(F.col("text")).alias("text"), outcome.alias("outcome"))
