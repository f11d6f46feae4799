"""Messages put together from streams of events: deltas in order, usage summed up, errors told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of event.
DELTA, USAGE, STOP, ERROR = "delta", "usage", "stop", "error"


def assembled(events: DataFrame) -> DataFrame:
    """events: stream_id, seq, event, data. stream_id, text, tokens, state: done, error (the first one's data) or cut (no stop came).

    Deltas are put together in order of seq; repeated events (one stream_id and seq) count once; what comes after a stop or an
    error is left out. The list is one message's deltas. The same in a batch and, grouped by stream, in complete mode of a stream.
    """
    once = events.groupBy("stream_id", "seq").agg(F.min(F.struct("event", "data")).alias("x")).select("stream_id", "seq", "x.event", "x.data")
    ends = once.where(F.col("event").isin(STOP, ERROR)).groupBy("stream_id").agg(F.min(F.struct("seq", "event", "data")).alias("end"))
    live = once.join(ends, "stream_id", "left").where(F.col("end").isNull() | (F.col("seq") <= F.col("end.seq")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == DELTA, F.struct("seq", F.coalesce("data", F.lit("")).alias("data"))))), lambda x: x["data"]), "")
    tokens = F.coalesce(F.sum(F.when(F.col("event") == USAGE, F.expr("try_cast(data AS long)"))), F.lit(0))
    state = F.when(F.first("end.event") == STOP, "done").when(F.first("end.event") == ERROR, F.concat(F.lit("error: "), F.coalesce(F.first("end.data"), F.lit("")))).otherwise("cut")
    return live.groupBy("stream_id").agg(text.alias("text"), tokens.alias("tokens"), state.alias("state"))
