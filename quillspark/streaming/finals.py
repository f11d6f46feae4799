"""What finished reports teach, case by case, so that each can be taken back exactly.

A finished report of a case takes the place of the one before it of that case; every finished report makes those of other cases
count a little less; a case that is forgotten leaves nothing. So the state is each case's own sums, in whole units, and the number of
reports finished until then: moments are made of these each time, and no sum is ever corrected by subtraction. A stream in
any split into batches, read in order, ends with what one batch gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: what an earlier finished report still counts after a later one.
FADE = 0.98
FINAL, FORGET = "final", "forget"
MOMENTS = "author long, finished long, n double, mean double, sd double"


def moments(actions: DataFrame, fade: float = FADE) -> DataFrame:
    """actions: author, seq, case, action (final, forget), n, total, squares (longs: how many values, their sum, the sum of their squares).

    author, finished (cases that count), n (weighted), mean, sd of all actions in order of seq, which tells an author's actions apart.
    Actions of other names and rows without an author or case are left out; a report without values teaches nothing, but takes
    the place of what the case taught before. sd is 0 where n is 1 or less. Authors of whom nothing is left have n 0 and no mean.
    """
    rows = actions.where(F.col("action").isin(FINAL, FORGET) & F.col("author").isNotNull() & F.col("case").isNotNull())
    counts = ((F.col("action") == FINAL) & (F.col("n") > 0)).cast("long")
    order = Window.partitionBy("author").orderBy("seq")
    rows = rows.withColumn("at", F.sum(counts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.groupBy("author", "case").agg(F.max_by(F.struct("action", "n", "total", "squares", "at"), "seq").alias("x"), F.max("at").alias("most"))
    most = last.groupBy("author").agg(F.max("most").alias("most"))
    live = (F.col("x.action") == FINAL) & (F.col("x.n") > 0)
    w = F.when(live, F.pow(F.lit(fade), F.col("b.most") - F.col("x.at"))).otherwise(0.0)
    sums = last.drop("most").join(most.alias("b"), "author").groupBy("author").agg(F.sum(live.cast("long")).alias("finished"), *(F.sum(w * F.coalesce(f"x.{c}", F.lit(0))).alias(c) for c in ("n", "total", "squares")))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    var = F.when(F.col("n") > 1, F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0)
    return sums.select("author", "finished", "n", mean.alias("mean"), F.when(mean.isNotNull(), F.sqrt(var)).alias("sd"))


class Finals(StatefulProcessor):
    """One author's cases."""

    def __init__(self, fade: float):
        self.fade = fade

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "at long")
        self.cases = handle.getMapState("cases", "case string", "at long, n long, total long, squares long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.count.get()[0] if self.count.exists() else 0
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.action == FINAL and r.n > 0:
                at += 1
                self.cases.updateValue((r.case,), (at, r.n, r.total, r.squares))
            else:
                self.cases.removeKey((r.case,))
        self.count.update((at,))
        n = total = squares = 0.0
        finished = 0
        for _, (then, k, s, q) in self.cases.iterator():
            w = self.fade ** (at - then)
            finished, n, total, squares = finished + 1, n + w * k, total + w * s, squares + w * q
        mean = total / n if n else None
        sd = (max(squares - total * mean, 0.0) / (n - 1)) ** 0.5 if n > 1 else 0.0 if n else None
        yield pd.DataFrame({"author": [key[0]], "finished": [finished], "n": [n], "mean": [mean], "sd": [sd]})

    def close(self) -> None:
        pass


def moments_stream(actions: DataFrame, fade: float = FADE) -> DataFrame:
    """The same of a stream, in update mode: each batch gives the authors that it has something of. Needs the RocksDB state store.

    Batches come in order of seq; within one, an author's rows are put in order.
    """
    rows = actions.where(F.col("action").isin(FINAL, FORGET) & F.col("author").isNotNull() & F.col("case").isNotNull())
    rows = rows.select(F.col("author").cast("long"), "seq", F.col("case").cast("string").alias("case"), "action", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("n", "total", "squares")))
    return rows.groupBy("author").transformWithStateInPandas(Finals(fade), MOMENTS, "Update", "None")
