"""Edge cases of alerts, schedules, row changes, holidays, personal details and text checks."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import alerts, checks, holidays, mining, overlap, privacy, reads, schedule, scores, stored_rows, validation
from quillspark.sources import files
from quillspark.streaming import messages

D = dt.date
NOW = alerts.Today("2026-11-17", 600)
VISITS = "id long, patient_id long, kind string, date date, start int, minutes int, status string, fee long, charge_missed boolean"


def test_alerts_at_their_borders(spark):
    day = D(2026, 11, 17)
    back = lambda n: day - dt.timedelta(n)
    rows = [
        (1, 1, "therapy", day, 540, 60, "planned", 0, False), (2, 1, "therapy", day, 541, 60, "planned", 0, False), (3, 1, "block", back(9), 0, 60, "planned", 0, False), (4, 1, "therapy", back(60), 0, 60, "held", 0, False), (5, 1, "therapy", back(61), 0, 60, "held", 0, False),
        (6, 1, "meeting", back(1), 0, 60, "held", 0, False), (7, 2, "feedback", back(-7), 0, 60, "planned", 0, False), (8, 2, "feedback", back(-8), 0, 60, "planned", 0, False), (9, 3, "assessment", back(30), 0, 60, "held", 0, False), (10, 4, "assessment", back(31), 0, 60, "held", 0, False),
        (11, 5, "therapy", None, 0, 60, "planned", 0, False), (12, 9, "therapy", back(3), 0, 60, "planned", 0, False),
    ]
    v = spark.createDataFrame(rows, VISITS)
    p = spark.createDataFrame([(i, "active", None, D(2020, 1, 1)) for i in range(1, 6)] + [(6, "waiting", back(56), D(2020, 1, 1)), (7, "waiting", None, back(55))], "id long, status string, waiting_since date, created_on date")
    money = "patient_id long, date date, amount long, voided boolean"
    c, m = spark.createDataFrame([(3, back(60), 100, False), (4, back(59), 100, False)], money), spark.createDataFrame([], money)
    t = spark.createDataFrame([(1, 2, "document", back(1), None), (2, 2, "document", None, None), (3, 8, "other", back(1), None), (4, None, "other", day, None), (5, 2, "document", back(1), back(1))], "id long, patient_id long, kind string, due date, done_on date")
    n = spark.createDataFrame([(4, 2)], "visit_id long, patient_id long")
    r = spark.createDataFrame([(4, 1, 5), (2, 0, 0)], "patient_id long, approved int, total int")
    got = alerts.in_order(alerts.clinic_alerts(p, v, c, m, t, n, r, NOW)).collect()
    want = {("unmarked", 1, 1, None, None), ("no_note", 1, 4, None, None), ("feedback_soon", 2, 7, None, None), ("materials_missing", 2, 7, None, 2), ("report_due", 4, None, None, None), ("debt", 3, None, None, 100), ("task_overdue", 2, None, 1, None), ("task_overdue", None, None, 3, None), ("waiting", 6, None, None, 8)}
    assert {(x.kind, x.patient_id, x.visit_id, x.task_id, x.n) for x in got} >= want
    assert {x.patient_id for x in got if x.kind == "no_next_visit"} == {3, 4} and len(got) == len(want) + 4  # no_note of the two assessments' patients too
    assert [(x.since, x.rank) for x in got] == sorted((x.since, x.rank) for x in got)


def test_known_holidays(spark):
    got = {(r.date, r.name): r.closed for r in holidays.between(spark, "2023-01-01", "2026-12-31").collect()}
    for day, name, closed in (
        (D(2024, 10, 3), "New Year", True), (D(2025, 9, 23), "New Year", True), (D(2024, 4, 23), "Passover", True), (D(2026, 9, 21), "Day of Atonement", True), (D(2024, 3, 24), "Purim", False), (D(2024, 5, 14), "Independence Day", True), (D(2025, 5, 1), "Independence Day", True),
        (D(2024, 8, 13), "Ninth of Av", False), (D(2024, 3, 21), "Fast of Esther", False), (D(2024, 12, 25), "Hanukkah, candle 1", False), (D(2023, 12, 15), "Hanukkah, last day", False),
    ):
        assert got[day, name] is closed
    days = schedule.working_days(spark, "2024-10-02", "2024-10-06", (1, 2, 3, 4, 5), holidays.closed_days(spark, "2024-10-01", "2024-10-31"))
    assert sorted(r.date.day for r in days.collect()) == [2, 6]


def test_free_starts_keep_a_buffer_and_spread(spark):
    v = spark.createDataFrame([(1, 1, "x", D(2024, 1, 1), 535, 50, "held", 0, False), (2, 1, "x", D(2024, 1, 1), 700, 60, "cancelled", 0, False)], VISITS)
    days = spark.createDataFrame([(D(2024, 1, 1),)], "date date")
    free = sorted(r.start for r in schedule.free_on_grid(days, v, 480, 720, 45, buffer=10).collect())
    assert free == [480, *range(600, 690, 15)]  # 480 to 525 ends ten minutes before the visit
    assert [r.start for r in schedule.first_slots(days, v, 480, 720, 45, 9, buffer=10).collect()] == [480, 600, 645]
    assert schedule.free_on_grid(days, v, 480, 500, 45).count() == 0


def test_ages_ranges_and_reasons(spark):
    rows = spark.createDataFrame([(D(2024, 1, 31), D(2024, 2, 29)), (D(2024, 2, 29), D(2025, 2, 28)), (D(2024, 3, 1), D(2024, 2, 1)), (None, D(2024, 1, 1))], "b date, t date")
    assert [r.m for r in rows.select(reads.age_months(F.col("b"), F.col("t")).alias("m")).collect()] == [1, 12, None, None]
    states = rows.select(validation.range_state(F.col("b"), F.col("t")).alias("s")).collect()
    assert [r.s for r in states] == ["ok", "too_long", "reversed", "bad_date"]


def test_rows_change(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None)], "id long, parent long")
    gone = spark.createDataFrame([(2,), (3,)], "id long")
    assert {tuple(r) for r in stored_rows.without_folders(nodes, gone).collect()} == {(1, None), (4, 1), (5, None)}
    moves = spark.createDataFrame([(2, 4), (2, 2), (4, 2), (2, 5)], "id long, target long")
    assert {(r.id, r.target): r.cycle for r in stored_rows.cycles(nodes, moves).collect()} == {(2, 4): True, (2, 2): True, (4, 2): False, (2, 5): False}
    h = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k long, v int, s string")
    out = stored_rows.appended(h, spark.createDataFrame([(1, "c"), (9, "d")], "k long, s string"), "k", "v")
    assert {tuple(r) for r in out.collect()} == {(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (9, 1, "d")}


def test_details_and_gate(spark):
    texts = ["a١٢٣٤٥ b", "id 123456789, é1999, 1999 to 1899", "x@y.org (415) 555-0100", None, "[email] [missing: note] [who]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r.t for r in rows.orderBy("id").select(privacy.hidden(F.col("text")).alias("t")).collect()]
    assert got == ["a12345 b", "id [id], é[year], [year] to 1899", "[email] [phone]", "", "[email] [missing: note] [who]"]
    g = {r.id: r for r in privacy.gate(rows, ["[email]", "[missing: note]"], [], 100).collect()}
    assert g[3].reasons == "" and len(g[3].sha256) == 64 and g[4].reasons == "foreign_tag" and g[4].sha256 is None and g[2].reasons == "pattern:email,pattern:phone"
    hidden = rows.select("id", privacy.hidden(F.col("text")).alias("text"))
    tags = [f"[{k}]" for k in privacy.RULES] + ["[missing: note]", "[who]"]
    assert {r.reasons for r in privacy.gate(hidden, tags, [], 100).collect()} == {""}  # what the rules leave, the gate lets out
    filled = spark.range(1).select(privacy.filled(F.lit("{a} {b} {"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("2"))).alias("t")).first().t
    assert filled == "{b} 2 {"


def test_checks_of_texts(spark):
    rows = spark.createDataFrame([("born 1.1.2030\nseen 31.2.2020 or 2.3.2019",), (None,), ("the The end (a",), ("1. item one two three",), ("say it) now.",)], "t string")
    got = rows.select(checks.document_date(F.col("t")).alias("d"), checks.polish_notes(F.col("t")).alias("n")).collect()
    assert [r.d for r in got] == [D(2019, 3, 2), None, None, None, None]
    assert got[1].n == [] and got[2].n == ["doubled_word", "bracket_open", "unfinished"] and got[3].n == [] and got[4].n == ["bracket_closed"]


def test_percentiles_as_printed(spark):
    v = spark.createDataFrame([(40.0,), (100.0,), (66.0,), (65.0,), (135.0,), (147.0,), (None,)], "v double").select(scores.percentile(F.col("v")).alias("p")).collect()
    assert [r.p for r in v] == ["<0.1", "50", "1", "1", "99", ">99.9", None]


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 0, 90, 3.0), (1, 1, 20, 2.0), (1, 2, 10, 1.0), (2, 0, 5, 0.0), (2, 1, 5, 0.0), (3, 0, 500, 1.0)], "id long, at int, n int, score double")
    assert {(r.id, r["at"]) for r in overlap.within_words(rows, 100).collect()} == {(1, 0), (1, 2), (2, 0), (2, 1), (3, 0)}


def test_trend_is_the_fold(spark):
    xs = [float((k * 37) % 11) for k in range(25)]
    m = 0.0
    for i, x in enumerate(xs, 1):
        m += (x - m) / i if i <= 10 else 0.2 * (x - m)
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)] + [(2, 0, 4.0)], "key long, at long, x double")
    got = {r.key: r.fit for r in mining.trend(rows).collect()}
    assert abs(got[1] - m) < 1e-9 and got[2] == 4.0


def test_messages_and_bytes(spark):
    e = spark.createDataFrame([(1, 1, "delta", "a"), (1, 1, "delta", "a"), (1, 3, "stop", None), (1, 2, "delta", "b"), (1, 4, "delta", "late"), (2, 1, "error", "busy"), (3, 1, "usage", "x"), (3, 2, "usage", "5")], "stream_id long, seq long, event string, data string")
    assert {tuple(r) for r in messages.assembled(e).collect()} == {(1, "ab", 0, "done"), (2, "", 0, "error: busy"), (3, "", 5, "cut")}
    b = spark.createDataFrame([(b"\xef\xbb\xbfhi",), ("é".encode(),), (b"\xe9t\xe9 \x80\x9f",), (b"\x81",), (b"a\x00",), (None,)], "c binary")
    assert [r.t for r in b.select(files.decoded(F.col("c")).alias("t")).collect()] == ["hi", "é", "été €Ÿ", None, None, None]
