"""Limits, breakers, style and CSV on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import style, text
from quillspark.sources import csv
from quillspark.streaming import folds

T = dt.datetime(2024, 1, 1)
at = lambda s: T + dt.timedelta(seconds=s)


def answers(df):
    return {r.id: (r.accepted, r.wait_us and r.wait_us // 1_000_000) for r in df.collect()}


def test_refused_requests_do_not_count(spark):
    rows = [(1, 1, at(0)), (2, 1, at(10)), (3, 1, at(59)), (4, 1, at(60)), (5, 1, at(61)), (6, 2, at(61)), (7, 1, None), (8, None, at(0)), (9, None, at(1)), (10, None, at(2))]
    df = spark.createDataFrame(rows, "id long, key long, at timestamp")
    got = answers(folds.limited(df, 2, 60))
    assert got == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (True, None), 5: (False, 9), 6: (True, None), 7: (False, None), 8: (True, None), 9: (True, None), 10: (False, 58)}
    assert folds.limited(df.where("false")).count() == 0
    large = (1 << 60) + 1
    rows = spark.createDataFrame([(large, 1, at(0)), (None, None, None)], "id long, key long, at timestamp")
    assert {tuple(r) for r in folds.limited(rows).collect()} == {(large, 1, True, None), (None, None, False, None)}


def test_waiting_requests_go_in_turn_or_are_refused(spark):
    rows = [(1, 1, at(0)), (2, 1, at(10)), (3, 1, at(11)), (4, 1, at(12)), (5, 1, at(13)), (6, 1, at(100)), (7, 2, at(0)), (8, 1, None), (9, None, at(5))]
    got = answers(folds.waited(spark.createDataFrame(rows, "id long, key long, at timestamp"), 2, 60, 50))
    # 3 and 4 wait for 1 and 2 to leave; 5 would wait until 120; 6 comes when only 4 is still in
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 49), 4: (False, 58), 5: (False, 57), 6: (True, 0), 7: (True, 0), 8: (False, None), 9: (True, 0)}
    assert folds.waited(spark.createDataFrame([], "id long, key long, at timestamp")).count() == 0


def test_a_key_with_most_rows_is_cut_where_its_state_is_empty(spark):
    import random

    rnd, now, rows = random.Random(4), 0, []
    for i in range(6_000):
        now += rnd.choice([0, 1, 3, 20, 160])
        rows.append((i, 1 if rnd.random() < 0.8 else rnd.choice([2, 3, None]), None if rnd.random() < 0.01 else at(now)))
    df = spark.createDataFrame(rows, "id long, key long, at timestamp").repartition(5)
    micros = df.select("id", "key", F.unix_micros("at").alias("at"))
    cut = folds.pieces(micros, 150 * folds.SECOND)
    sizes = sorted(r["count"] for r in cut.groupBy("piece").count().collect())
    assert sum(sizes) == 6_000 and sizes[-1] < 200 and not cut.groupBy("piece").agg(F.count_distinct(F.coalesce("key", F.lit(-1))).alias("n")).where("n > 1").count()
    order = lambda r: (r[1] if r[1] is not None else -1, r[2] is not None, r[2] or T, r[0])
    for most, mine, step in ((2, folds.limited(df, 2, 60), lambda s, t: folds.take(s, t, 2, 60_000_000)), (3, folds.waited(df, 3, 60, 90), lambda s, t: folds.place(s, t, 3, 60_000_000, 90_000_000))):
        want, state, key = {}, [], object()
        for i, k, t in sorted(rows, key=order):
            state, key = (state, key) if k == key else ([], k)
            want[i] = step(state, None if t is None else round((t - T).total_seconds() * 1e6))
        assert {r.id: (r.accepted, r.wait_us) for r in mine.collect()} == want, most


def test_a_stream_keeps_its_window(spark, tmp_path):
    schema = "id long, key long, at timestamp"
    for rows in ([(1, 1, at(0)), (2, 1, at(10))], [(3, 1, at(59)), (4, 1, at(60))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folds.limited_stream(source, 2, 60).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert answers(spark.table("limits")) == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (True, None)}


def test_a_breaker_opens_and_tries_again(spark):
    rows = [(1, 1, at(0), "busy"), (2, 1, at(1), "up"), (3, 1, at(2), "busy"), (4, 1, at(3), "busy"), (5, 1, at(30), "up"), (6, 1, at(63), "busy"), (7, 1, at(64), "up"), (8, 1, at(123), None), (9, 1, at(124), "up"), (10, 1, at(125), "busy"), (11, 1, at(126), "up")]
    got = answers(folds.breaker(spark.createDataFrame(rows, "id long, key long, at timestamp, outcome string"), 2, 60))
    assert {k for k, v in got.items() if not v[0]} == {5, 7}
    assert got[5] == (False, 33) and got[7] == (False, 59)


def test_style_of_a_few_texts(spark):
    docs = spark.createDataFrame([(1, "a", 1.0, "One two three. Four, five!"), (2, "a", 1.0, "Six seven."), (3, "a", 1.0, None), (4, "b", 1.0, "...")], "id long, section string, weight double, text string")
    measured = style.features(docs)
    got = {r.feature: (r.n, r.mean, r.sd) for r in style.moments(measured).collect()}
    assert got["sentence_words"] == (2.0, 2.25, 0.125**0.5) and got["commas"][1] == 10.0
    near = {r.id: r for r in style.closeness(measured, style.moments(measured)).collect()}
    assert set(near) == {1, 2} and 0 < near[1].fidelity < 100 and near[1].delta > 0
    assert style.closeness(measured.where("false"), style.moments(measured.where("false"))).count() == 0


def test_recurring_sentences(spark):
    rows = [(i, "a", f"The child is {i} years old. Other.") for i in range(3)] + [(0, "a", "The child is 9 years old."), (7, "a", None), (8, "b", "The child is 8 years old.")]
    got = style.formulas(spark.createDataFrame(rows, "child long, section string, text string")).collect()
    assert [tuple(r) for r in got] == [("a", "The child is # years old", 3, 1)]


def test_cells_are_guarded(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 'say "x"'), (None, "a,b"), ("-2", "plain")], "a string, b string")
    assert {r.line for r in csv.lines(rows).collect()} == {"'=1+1,\"say \"\"x\"\"\"", ',"a,b"', "'-2,plain"}
    csv.write(rows.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().count(b"\r\n") == 3
    assert spark.range(1).select(csv.csv_cell(F.lit("\tx")).alias("c")).first().c == "'\tx"


TOPICS = {"sleep": ["sleep", "night"], "food": ["eat", "food"]}


def test_topics_in_their_usual_order(spark):
    rows = [
        (1, "a", "x", "Intro.\nSleep at night\nwell.\nEat food"),
        (2, "a", "x", "Night. Then eat more food."),
        (3, "a", None, "eat sleep\nfood"),
        (4, "a", "y", None),
        (None, "a", "y", "sleep\neat"),
        (5, "b", "y", "sleep\neat"),
    ]
    read = style.topics_read(spark.createDataFrame(rows, "id long, section string, band string, text string"), TOPICS)
    got = {(r.id, r.topic): (r.place, r.words) for r in read.collect()}
    assert got == {(1, "sleep"): (0.0, 4), (1, "food"): (1.0, 2), (2, "sleep"): (0.0, 1), (2, "food"): (1.0, 4), (3, "sleep"): (0.0, 2), (3, "food"): (1.0, 1), (5, "sleep"): (0.0, 1), (5, "food"): (1.0, 1)}
    shapes = {tuple(r) for r in style.skeletons(read).collect()}
    assert shapes == {("a", None, "sleep", 1, 1.0, 2, 3), ("a", None, "food", 2, 1.0, 2, 3)}
    assert style.skeletons(read, least=2).where("band = 'x'").count() == 2
    assert style.skeletons(read.where("false")).count() == 0


def test_rates_of_listed_words(spark):
    docs = spark.createDataFrame([(1, "a", 1.0, "The cat, the dog"), (2, "a", 1.0, None), (3, "a", 1.0, "...")], "id long, section string, weight double, text string")
    assert {(r.id, r.feature, r.x) for r in style.word_rates(docs, ["the", "of"]).collect()} == {(1, "the", 50.0), (1, "of", 0.0)}


def test_names_of_other_cases(spark):
    schema = "case_id long, name string"
    asked = spark.createDataFrame([(1, "Ann Lee"), (1, "Ann Lee"), (2, None), (None, "Lee")], schema)
    known = spark.createDataFrame([(1, "Ann"), (2, "Bo LEE"), (3, "lee-Ann"), (3, "B"), (4, None)], schema)
    assert sorted(tuple(r) for r in text.name_matches(asked, known).collect()) == [(1, "Ann Lee", 2, "Bo LEE"), (1, "Ann Lee", 3, "lee-Ann")]
    assert text.name_matches(asked.where("false"), known).count() == 0
