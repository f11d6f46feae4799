"""Messages put together from events, block by block: text, thinking and the input of tools, with what may go wrong told apart.

A message's events are numbered from 0; one that comes twice counts once. They are read in order up to the first that ends the
message, is wrong, or is missing. A block starts once and has its pieces after that; pieces of a tool's input make one JSON
text at the block's end. `assembled` reads a table, by windows over each message; `assembled_stream` keeps a message's events in
state until they are all there, or until none came for a while. Both give the same whatever the order of arrival.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Blocks and bytes that a message has at most.
MOST_BLOCKS, MOST_BYTES = 64, 8_000_000
MESSAGE = "stream_id string, state string, text string, thinking string, inputs string, stop_reason string, output_tokens long, words long"
#: Kinds of event that belong to a block, and the field of each kind of piece.
IN_BLOCKS = ("content_block_start", "content_block_delta", "content_block_stop")
PIECES = {"text_delta": "text", "thinking_delta": "thinking", "input_json_delta": "partial_json"}


def _read(data: Column) -> Column:
    """The parts of an event that are looked at; text fields are null where they are no text or number."""
    at = lambda path: F.get_json_object(data, f"$.{path}")
    valid = F.try_parse_json(data).isNotNull() & data.rlike(r"^\s*\{")
    piece = F.coalesce(*(F.when(at("delta.type") == kind, at(f"delta.{field}")) for kind, field in PIECES.items()))
    return F.struct(
        valid.alias("valid"),
        at("type").alias("type"),
        F.when(at("index").rlike("^[0-9]{1,2}$"), at("index").cast("int")).alias("index"),
        at("content_block.type").alias("block"),
        at("delta.type").alias("kind"),
        F.coalesce(piece, F.lit("")).alias("piece"),
        at("delta.stop_reason").alias("stop_reason"),
        F.coalesce(at("usage.output_tokens"), at("message.usage.output_tokens")).try_cast("long").alias("tokens"),
        F.coalesce(at("error.type"), F.lit("")).alias("error"),
    )


def assembled(events: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """events: stream_id, seq, data (JSON). stream_id, state, text, thinking, inputs, stop_reason, output_tokens, words.

    state: done; cut (no stop came, or an event is missing); or the first fault, with the text up to it: bad event, no valid index,
    block started twice, delta before its block, bad tool input, too large, or error: and its type. inputs: the tools' inputs in order of
    their blocks, as [index, text] pairs in JSON. Events without a stream or number are left out; of different events of one
    number the least counts. A message whose first event is missing has no text.
    """
    once = events.where("stream_id is not null and seq >= 0").groupBy("stream_id", "seq").agg(F.min(F.coalesce("data", F.lit(""))).alias("data"))
    order = Window.partitionBy("stream_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = once.withColumn("nth", F.row_number().over(order) - 1).withColumn("bytes", F.sum(F.octet_length("data")).over(so_far)).where("nth = seq")
    rows = rows.select("stream_id", "seq", "bytes", F.explode(F.array(_read(F.col("data")))).alias("e")).select("stream_id", "seq", "bytes", "e.*")
    in_block = F.col("type").isin(*IN_BLOCKS)
    start, delta, stop = (F.col("type") == x for x in IN_BLOCKS)
    block = Window.partitionBy("stream_id", "index").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("starts", F.sum((F.coalesce(start, F.lit(False))).cast("int")).over(block))
    pieces = F.collect_list(F.when(delta & (F.col("kind") == "input_json_delta"), F.col("piece"))).over(block)
    rows = rows.withColumn("input", F.when(stop, F.array_join(pieces, "")))
    bad_input = stop & (F.col("input") != "") & F.try_parse_json("input").isNull()
    fault = (
        F.when(F.col("bytes") > most_bytes, "too large")
        .when(~F.coalesce("valid", F.lit(False)), "bad event")
        .when(in_block & (F.col("index").isNull() | (F.col("index") >= MOST_BLOCKS)), "no valid index")
        .when(start & (F.col("starts") > 1), "block started twice")
        .when(delta & (F.col("starts") == 0), "delta before its block")
        .when(bad_input, "bad tool input")
        .when(F.col("type") == "error", F.concat(F.lit("error: "), "error"))
    )
    rows = rows.withColumn("fault", fault)
    over = F.col("fault").isNotNull() | (F.col("type") == "message_stop")
    rows = rows.withColumn("ends", F.sum(F.coalesce(over, F.lit(False)).cast("int")).over(so_far)).withColumn("over", F.coalesce(over, F.lit(False)))
    live = rows.where((F.col("ends") == 0) | ((F.col("ends") == 1) & F.col("over")))
    fine = F.col("fault").isNull()

    def joined(kind: str) -> Column:
        of = F.when(fine & (F.col("type") == "content_block_delta") & (F.col("kind") == kind), F.struct("seq", "piece"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["piece"]), "")

    tool = F.when(fine & (F.col("type") == "content_block_stop") & (F.col("input") != ""), F.struct("index", "seq", "input"))
    last = lambda c: F.max_by(c, F.when(fine & F.col(c).isNotNull(), F.col("seq")))
    begun = F.max((fine & (F.col("type") == "message_start")).cast("int")) == 1
    ended = F.max((fine & (F.col("type") == "message_stop")).cast("int")) == 1
    out = live.groupBy("stream_id").agg(
        F.max("fault").alias("fault"), begun.alias("begun"), ended.alias("ended"), joined("text_delta").alias("text"), joined("thinking_delta").alias("thinking"),
        F.to_json(F.transform(F.array_sort(F.collect_list(tool)), lambda x: F.array(x["index"].cast("string"), x["input"]))).alias("inputs"), last("stop_reason").alias("stop_reason"), last("tokens").alias("output_tokens"),
    )
    streams = once.select("stream_id").distinct().join(out, "stream_id", "left")
    state = F.coalesce("fault", F.when(F.col("begun") & F.col("ended"), "done"), F.lit("cut"))
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("long")
    return streams.select("stream_id", state.alias("state"), text.alias("text"), F.coalesce("thinking", F.lit("")).alias("thinking"), F.coalesce("inputs", F.lit("[]")).alias("inputs"), "stop_reason", "output_tokens", words.alias("words"))


def _fields(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _said(x: object) -> str:
    """A value as text, as reading it by its path gives it."""
    return x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _parsed(text: str) -> object:
    """JSON as a parser without extensions reads it."""
    return json.loads(text, parse_constant=lambda x: float(f"no {x}"))


class _Message:
    """One message, event by event."""

    def __init__(self, most_bytes: int):
        self.most, self.bytes, self.state = most_bytes, 0, None
        self.started: set[int] = set()
        self.partial: dict[int, str] = {}
        self.inputs: list[tuple[int, int, str]] = []
        self.text = self.thinking = ""
        self.begun, self.stop_reason, self.tokens = False, None, None

    def fault(self, seq: int, data: str) -> str | None:
        """Takes an event in; what is wrong with it, if anything is."""
        self.bytes += len(data.encode())
        if self.bytes > self.most:
            return "too large"
        try:
            e = _parsed(data)
        except ValueError:
            return "bad event"
        if not isinstance(e, dict):
            return "bad event"
        kind, i = e.get("type"), e.get("index")
        i = int(i) if isinstance(i, str) and re.fullmatch("[0-9]{1,2}", i) else i  # an index written as text counts
        if kind in IN_BLOCKS:
            if not isinstance(i, int) or isinstance(i, bool) or not 0 <= i < MOST_BLOCKS:
                return "no valid index"
            if kind == "content_block_start":
                if i in self.started:
                    return "block started twice"
                self.started.add(i)
            elif kind == "content_block_delta":
                if i not in self.started:
                    return "delta before its block"
                delta = _fields(e.get("delta"))
                piece = _said(delta.get(PIECES.get(delta.get("type"), "")))
                if delta.get("type") == "text_delta":
                    self.text += piece
                elif delta.get("type") == "thinking_delta":
                    self.thinking += piece
                elif delta.get("type") == "input_json_delta":
                    self.partial[i] = self.partial.get(i, "") + piece
            elif self.partial.get(i):
                try:
                    _parsed(self.partial[i])
                except ValueError:
                    return "bad tool input"
                self.inputs.append((i, seq, self.partial[i]))
        if kind == "error":
            return f"error: {_said(_fields(e.get('error')).get('type'))}"
        self.begun |= kind == "message_start"
        reason = _fields(e.get("delta")).get("stop_reason")
        self.stop_reason = self.stop_reason if reason is None else _said(reason)
        for usage in (e.get("usage"), _fields(e.get("message")).get("usage")):
            tokens = _fields(usage).get("output_tokens")
            if tokens is not None:
                self.tokens = int(tokens) if re.fullmatch("-?[0-9]{1,18}", _said(tokens)) else self.tokens
                break
        if kind == "message_stop":
            self.state = "done" if self.begun else "cut"
        return None

    def row(self, stream: str) -> dict:
        inputs = json.dumps([[str(i), x] for i, _, x in sorted(self.inputs)], ensure_ascii=False, separators=(",", ":"))
        return {"stream_id": stream, "state": self.state or "cut", "text": self.text, "thinking": self.thinking, "inputs": inputs, "stop_reason": self.stop_reason, "output_tokens": self.tokens, "words": len([w for w in self.text.split() if w])}


def message_of(stream: str, events: dict[int, str], most_bytes: int = MOST_BYTES) -> tuple[dict, bool]:
    """A message from its events by number, and whether it is over (done or wrong, rather than waiting for an event)."""
    m, seq = _Message(most_bytes), 0
    while seq in events and m.state is None:
        m.state = m.fault(seq, events[seq])
        if m.state is None and _ended(events[seq]):
            m.state = "done" if m.begun else "cut"
        seq += 1
    return m.row(stream), m.state is not None


def _ended(data: str) -> bool:
    return '"message_stop"' in data and _parsed(data).get("type") == "message_stop"


class Waiting(StatefulProcessor):
    """A message's events so far. It is given out once, when it is over or when no event came for a while."""

    def __init__(self, wait_ms: int, most_bytes: int):
        self.wait_ms, self.most = wait_ms, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", "data string")
        self.given = handle.getValueState("given", "given boolean")

    def _give(self, key: tuple, row: dict) -> pd.DataFrame:
        self.given.update((True,))
        self.events.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        return pd.DataFrame([row]).astype({"output_tokens": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.given.exists():
            return
        for part in rows:
            for seq, data in zip(part["seq"], part["data"], strict=True):
                known = self.events.getValue((int(seq),)) if self.events.containsKey((int(seq),)) else None
                self.events.updateValue((int(seq),), (data if known is None else min(known[0], data),))
        row, over = message_of(key[0], {k[0]: v[0] for k, v in self.events.iterator()}, self.most)
        if over:
            yield self._give(key, row)
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.given.exists():
            yield self._give(key, message_of(key[0], {k[0]: v[0] for k, v in self.events.iterator()}, self.most)[0])

    def close(self) -> None:
        pass


def assembled_stream(events: DataFrame, wait_ms: int = 600_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The same of a stream, in append mode: each message once, when it is over, or as far as it came when no event arrived for wait_ms. Needs the RocksDB state store."""
    rows = events.where("stream_id is not null and seq >= 0").select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), F.coalesce("data", F.lit("")).alias("data"))
    return rows.groupBy("stream_id").transformWithStateInPandas(Waiting(wait_ms, most_bytes), MESSAGE, "Append", "ProcessingTime")
