"""Edge cases of the operators on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import ledger, records, schedule, scores, text

D = dt.date
VISITS = "id long, patient_id long, kind string, date date, start int, minutes int, status string, fee long, charge_missed boolean"


def visits(spark, rows):
    return spark.createDataFrame(rows, VISITS)


def test_balances_count_no_voided_row_and_no_unknown_status(spark):
    v = visits(spark, [(1, 1, "intake", D(2020, 1, 1), 0, 60, "held", 500, False), (2, 1, "intake", D(2020, 1, 2), 0, 60, "unknown", 500, True), (3, 1, "intake", None, 0, 60, "no_show", 70, True), (4, 2, "intake", D(2020, 1, 1), 0, 60, "held", -5, False)])
    c = spark.createDataFrame([(1, 1, D(2020, 1, 3), 30, False), (2, 1, D(2020, 1, 3), 999, True)], "id long, patient_id long, date date, amount long, voided boolean")
    p = spark.createDataFrame([(1, 1, D(2020, 2, 1), 550, False), (2, 3, D(2020, 2, 1), 10, False), (3, 3, D(2020, 2, 1), 10, True)], "id long, patient_id long, date date, amount long, voided boolean")
    assert {tuple(r) for r in ledger.balances(v, c, p).collect()} == {(1, 600, 550, 50), (3, 0, 10, -10)}
    assert ledger.total_due(ledger.balances(v, c, p)).first().total_due == 50
    assert [tuple(r) for r in ledger.oldest_uncovered(v, c, p).collect()] == [(1, 50, D(2020, 1, 1))]  # the undated charge comes first
    ages = ledger.debt_ageing(ledger.oldest_uncovered(v, c, p), "2020-03-01").collect()
    assert {r.from_day: (r.n, r.amount) for r in ages} == {0: (0, 0), 31: (1, 50), 61: (0, 0), 91: (0, 0)}


def test_touching_visits_do_not_overlap(spark):
    day = D(2020, 1, 1)
    v = visits(spark, [(1, 1, "x", day, 0, 60, "held", 0, False), (2, 1, "x", day, 60, 60, "held", 0, False), (3, 1, "x", day, 90, 10, "planned", 0, False), (4, 1, "x", day, 95, 10, "cancelled", 0, False), (5, 2, "x", day, 0, 600, "held", 0, False)])
    assert {r.id for r in schedule.overlapping(v).collect()} == {2, 3}
    assert schedule.overlapping(v.where("false")).count() == 0


def test_median_of_an_even_count_is_rounded_down(spark):
    rows = spark.createDataFrame([(1,), (4,)], "x int")
    assert rows.agg(ledger.median_floor("x").alias("m")).first().m == 2
    assert rows.where("false").agg(ledger.median_floor("x").alias("m")).first().m is None


def test_rates_are_rounded_half_up(spark):
    got = spark.createDataFrame([(1, 2), (1, 2000), (0, 0)], "p long, w long").select(ledger.per_thousand(F.col("p"), F.col("w")).alias("r")).collect()
    assert [r.r for r in got] == [500, 1, 0]


def test_others_hold_what_the_top_leaves(spark):
    rows = spark.createDataFrame([("A", 1), ("a ", 2), ("b", 3), ("c", 4), ("", 5), (None, 6)], "name string, at int")
    assert [tuple(r) for r in ledger.top_and_others(rows, "name", "at", 1).collect()] == [("A", 2), ("others", 2)]
    assert ledger.top_and_others(rows, "name", "at", 9).count() == 3


def test_chains_pages_and_trees(spark):
    log = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (4, "d", "c"), (5, "e", "x")], "seq long, mac string, prev string")
    assert {tuple(r) for r in records.chain_faults(log).collect()} == {(4, "gap"), (5, "altered")}
    page = records.keyset_page(log, "seq", "seq", (5, 5), 2)
    assert [r.seq for r in page.collect()] == [4, 2]
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 77)], "id long, parent long")
    got = {r.id: (r.root, r.depth) for r in records.ancestors(nodes).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(1, 0), (1, 1), (1, 2), (1, 3)]


def test_scores_between_bands_have_none(spark):
    rows = spark.createDataFrame([(69.5,), (40.0,), (160.0,), (100.0,), (None,)], "v double").select(scores.band_label(F.col("v")).alias("b"), scores.percentile(F.col("v")).alias("p")).collect()
    assert [r.b for r in rows] == [None, "very low", "very high", "average", None]
    assert rows[3].p == "50" and rows[4].p is None


def test_details_are_hidden(spark):
    docs = spark.createDataFrame([(1, "Mail a.b@example.com or see http://x.example/y now 123456789"), (2, None)], "doc_id long, text string")
    assert [r.t for r in docs.select(text.redacted("text").alias("t")).collect()] == ["Mail [email] or see [url] now [digits]", ""]
    assert [tuple(r) for r in text.masks(docs).collect()] == [("a.b@example.com", "[email_1]")]
