"""Request limits and circuit breakers: folds over each key's rows in order of time, whose state has a fixed size.

What is refused must not count, so a window expression can't say it. In a batch, rows are dealt by key and sorted, and
each task streams through its rows with the state of one key at a time: a key may hold any share of the rows without
being gathered. Limits forget: where a key has no request for as long as its state can reach, the key is cut, and its pieces are
worked through side by side. Rows without a time are refused with a null wait; rows without a key share one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.records import written

ANSWER = "id long, key long, accepted boolean, wait_us long"
SECOND = 1_000_000


def pieces(rows: DataFrame, reach_us: int) -> DataFrame:
    """rows: id, key, at (microseconds). The rows with piece: numbers of runs of a key's rows without a gap of `reach_us` or more.

    Rows are sorted in ranges of key and time, so a key with many rows is in many ranges; what a range's first row follows is known
    from the last rows of the ranges, one each.
    """
    order = ["key", "at", "id"]
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    last = ranged.groupBy("range").agg(F.max(F.struct(*order)).alias("last"))
    last = last.select("range", F.lag("last").over(Window.orderBy("range")).alias("before"))
    within = Window.partitionBy("range").orderBy(*order)
    now = ranged.join(F.broadcast(last), "range").withColumn("nth", F.row_number().over(within))
    before = lambda c: F.when(F.col("nth") == 1, F.col(f"before.{c}")).otherwise(F.lag(c).over(within))
    first = (F.col("nth") == 1) & F.col("before").isNull()
    cut = first | ~before("key").eqNullSafe(F.col("key")) | F.coalesce(F.col("at") - before("at") >= reach_us, F.lit(False))
    marked = written(now.withColumn("cut", cut.cast("long")).drop("before", "nth"))
    sums = marked.groupBy("range").agg(F.sum("cut").alias("n"))
    sums = sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("past"))
    piece = F.col("past") + F.sum("cut").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(F.broadcast(sums), "range").withColumn("piece", piece).select(*rows.columns, "piece")


def fold(rows: DataFrame, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], schema: str, by: str = "key") -> DataFrame:
    """step(state, row) of each row, in order within its key (or what `by` names); start() makes a key's state. step returns an output row."""
    columns = rows.columns
    at = columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, object()
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != key:
                    state, key = start(), row[at]
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def _micros(at: str) -> Column:
    """Microseconds; times without a zone are those of the session's zone."""
    return F.unix_micros(F.col(at).cast("timestamp")).alias(at)


def take(sent: list[int], now: int | None, most: int, window: int) -> tuple[bool, int | None]:
    """A place in the window now, or the wait for the oldest place to leave it. sent holds `most` times at most."""
    if now is None:
        return False, None
    sent[:] = [t for t in sent if now - t < window]
    if len(sent) >= most:
        return False, max(min(sent) + window - now, 1)
    sent.append(now)
    return True, None


def limited(requests: DataFrame, most: int = 20, window_s: int = 60) -> DataFrame:
    """requests: id, key (longs), at (timestamp). id, key, accepted, wait_us: a key has `most` accepted requests in any window."""
    rows = requests.select(F.col("id").cast("long"), F.col("key").cast("long"), _micros("at"))

    def step(sent: list[int], row: tuple) -> tuple:
        return row[0], row[1], *take(sent, row[2], most, window_s * SECOND)

    return fold(pieces(rows, window_s * SECOND), ["at", "id"], list, step, ANSWER, "piece")


def place(starts: list[int], now: int | None, most: int, window: int, longest: int) -> tuple[bool, int | None]:
    """Whether a request of now gets a place within `longest`, and how long it waits for it. starts: when the last `most` of those that got one began."""
    if now is None:
        return False, None
    begins = now if len(starts) < most else max(now, starts[0] + window)
    if begins - now > longest:
        return False, begins - now
    starts.append(begins)
    del starts[:-most]
    return True, begins - now


def waited(requests: DataFrame, most: int = 20, window_s: int = 60, longest_s: int = 90) -> DataFrame:
    """requests: id, key (longs), at. id, key, accepted, wait_us: requests wait for a place, in the order in which they came, and go in when the oldest of
    the last `most` leaves the window; one that would wait over longest_s is refused and takes no place.

    A key is cut where nothing came for a window and the longest wait: whoever was let in before has left by then.
    """
    rows = requests.select(F.col("id").cast("long"), F.col("key").cast("long"), _micros("at"))

    def step(starts: list[int], row: tuple) -> tuple:
        return row[0], row[1], *place(starts, row[2], most, window_s * SECOND, longest_s * SECOND)

    return fold(pieces(rows, (window_s + longest_s) * SECOND), ["at", "id"], list, step, ANSWER, "piece")


def limited_stream(requests: DataFrame, most: int = 20, window_s: int = 60) -> DataFrame:
    """The same of a stream; each micro-batch is taken in order of time after those before it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = list(state.get[0]) if state.exists else []
        rows = sorted(((None if pd.isna(t) else int(t), int(i)) for b in batches for t, i in zip(b["at"], b["id"], strict=True)), key=lambda x: (x[0] is not None, x))
        out = [(i, key[0], *take(sent, t, most, window_s * SECOND)) for t, i in rows]
        state.update((sent,))
        yield pd.DataFrame(out, columns=["id", "key", "accepted", "wait_us"]).astype({"wait_us": "Int64"})

    rows = requests.select(F.col("id").cast("long"), F.col("key").cast("long"), _micros("at")).where("id is not null")
    return rows.groupBy("key").applyInPandasWithState(run, ANSWER, "sent array<long>", "append", GroupStateTimeout.NoTimeout)


class Breaker:
    """Closed until `most` busy outcomes in a row, then open for a while, then one trial decides."""

    def __init__(self, most: int, cool_us: int):
        self.most, self.cool_us, self.busy, self.until = most, cool_us, 0, None

    def step(self, row: tuple) -> tuple:
        i, key, now, outcome = row
        if now is None or (self.until is not None and now < self.until):
            return i, key, False, None if now is None else self.until - now
        if outcome == "up":
            self.busy, self.until = 0, None
        elif outcome == "busy":
            self.busy += 1
            if self.until is not None or self.busy >= self.most:
                self.until = now + self.cool_us
        return i, key, True, None


def breaker(requests: DataFrame, most: int = 5, cool_s: int = 60) -> DataFrame:
    """requests: id, key, at, outcome (up, busy; anything else tells nothing), known as soon as a request is let through.

    id, key, accepted, wait_us. A refused request's outcome doesn't count. After the wait the next request is a trial: busy opens
    the breaker again at once, up closes it.
    """
    rows = requests.select(F.col("id").cast("long"), F.col("key").cast("long"), _micros("at"), F.col("outcome").cast("string"))
    return fold(rows, ["at", "id"], lambda: Breaker(most, cool_s * SECOND), Breaker.step, ANSWER)
