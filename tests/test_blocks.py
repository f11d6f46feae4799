"""Messages from events: a table by windows, a stream by state, whatever the order of arrival."""

import json
import random
import tempfile
import time

from quillspark.streaming import blocks

SCHEMA = "stream_id string, seq long, data string"
E = lambda kind, **more: json.dumps({"type": kind, **more}, ensure_ascii=False)
START = E("message_start", message={"id": "m", "usage": {"output_tokens": 1}})
BEGIN = lambda i, kind="text": E("content_block_start", index=i, content_block={"type": kind})
TEXT = lambda i, t: E("content_block_delta", index=i, delta={"type": "text_delta", "text": t})
JSON = lambda i, t: E("content_block_delta", index=i, delta={"type": "input_json_delta", "partial_json": t})
STOP = lambda i: E("content_block_stop", index=i)
END = E("message_stop")

CASES = {
    "whole": [START, BEGIN(0, "thinking"), E("content_block_delta", index=0, delta={"type": "thinking_delta", "thinking": "hm"}), STOP(0), E("ping"), BEGIN(1), TEXT(1, 'say "שלום '), TEXT(1, "עולם\" two\nlines"), STOP(1), E("message_delta", delta={"stop_reason": "end_turn"}, usage={"output_tokens": 42}), END, TEXT(9, "after")],
    "tools": [START, BEGIN(1, "tool_use"), BEGIN(0, "tool_use"), JSON(1, '{"a": [1, '), JSON(0, '{"b'), JSON(1, "2]}"), STOP(1), JSON(0, '": 1}'), STOP(0), END],
    "bad tool": [START, BEGIN(0), TEXT(0, "x"), JSON(0, '{"a": '), STOP(0), END],
    "twice": [START, BEGIN(0), TEXT(0, "x"), BEGIN(0), END],
    "early": [START, TEXT(0, "x"), BEGIN(0), END],
    "index": [START, BEGIN(64), END],
    "no index": [START, E("content_block_start"), END],
    "json": [START, BEGIN(0), TEXT(0, "kept"), "{not", END],
    "list": ["[1]", END],
    "error": [START, BEGIN(0), TEXT(0, "a b"), E("error", error={"type": "overloaded", "message": "m"}), END],
    "cut": [START, BEGIN(0), TEXT(0, "a b c")],
    "no start": [BEGIN(0), TEXT(0, "x"), STOP(0), END],
    "large": [START, BEGIN(0), TEXT(0, "y" * 3_000), TEXT(0, "z" * 3_000), END],
}
STATES = {"whole": "done", "tools": "done", "bad tool": "bad tool input", "twice": "block started twice", "early": "delta before its block", "index": "no valid index", "no index": "no valid index", "json": "bad event", "list": "bad event", "error": "error: overloaded", "cut": "cut", "no start": "cut", "large": "too large"}
MOST = 5_000


def rows_of(cases=CASES):
    rows = [(k, i, e) for k, events in cases.items() for i, e in enumerate(events)]
    rows += [("whole", 5, BEGIN(1)), ("gap", 0, START), ("gap", 2, END), ("late", 1, START), (None, 0, START), ("gap", None, START)]
    random.Random(3).shuffle(rows)
    return rows


def read(df):
    return {r.stream_id: tuple(r)[1:] for r in df.collect()}


def test_each_fault_is_told_and_what_came_before_it_is_kept(spark):
    got = read(blocks.assembled(spark.createDataFrame(rows_of(), SCHEMA), MOST))
    assert {k: v[0] for k, v in got.items()} == STATES | {"gap": "cut", "late": "cut"}
    assert got["whole"] == ("done", 'say "שלום עולם" two\nlines', "hm", "[]", "end_turn", 42, 5)
    assert json.loads(got["tools"][3]) == [["0", '{"b": 1}'], ["1", '{"a": [1, 2]}']]
    assert got["error"][1] == "a b" and got["json"][1] == "kept" and got["twice"][1] == "x" and got["cut"][6] == 3 and got["large"][1] == "y" * 3_000
    assert blocks.assembled(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_and_the_walk_agree(spark):
    rnd, cases = random.Random(6), {}
    pool = [START, BEGIN(0), BEGIN(1, "tool_use"), TEXT(0, "é x "), TEXT(1, "y"), JSON(1, '{"k":'), JSON(1, "1}"), JSON(0, "2"), STOP(0), STOP(1), END, E("ping"), E("message_delta", delta={"stop_reason": "s"}, usage={"output_tokens": 7}), "{", E("error"), E("content_block_delta", index="1")]
    for n in range(150):
        cases[f"s{n}"] = [START, BEGIN(0), BEGIN(1)][: rnd.randrange(4)] + [rnd.choice(pool) for _ in range(rnd.randrange(1, 12))]
    got = read(blocks.assembled(spark.createDataFrame([(k, i, e) for k, es in cases.items() for i, e in enumerate(es)], SCHEMA)))
    want = {k: tuple(blocks.message_of(k, dict(enumerate(es)))[0].values())[1:] for k, es in cases.items()}
    assert got == want


def test_a_stream_gives_what_the_table_gives(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows, folder = rows_of(), tempfile.mkdtemp(prefix="spark-")
        for begin in range(0, len(rows), 24):
            spark.createDataFrame(rows[begin : begin + 24], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        seen = []
        stream = blocks.assembled_stream(source, 600_000, MOST).writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{folder}/at")
        table = read(blocks.assembled(spark.createDataFrame(rows, SCHEMA), MOST))
        over = {k for k, v in table.items() if v[0] != "cut"} | {"no start"}
        running, until = stream.start(), time.time() + 120
        # a stream with timers goes on asking for batches, so it is stopped once all is there
        while len(seen) < len(over) and time.time() < until:
            time.sleep(0.5)
        running.stop()
        got = {r.stream_id: tuple(r)[1:] for r in seen}
        assert len(got) == len(seen) and got == {k: v for k, v in table.items() if k in over}
    finally:
        spark.conf.set(conf, before)
