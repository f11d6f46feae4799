"""Lines of the diary."""

import datetime as dt

from quillspark.operators import insights


def test_lines_of_one_id_stand_in_one_order(spark):
    day = dt.date(1999, 3, 2)
    visits = spark.createDataFrame([], "id long, patient_id long, kind string, date date, start int, minutes int, status string, fee long, charge_missed boolean")
    schema = "id long, patient_id long, date date, amount long, voided boolean"
    rows = [(5, 1, day, n, False) for n in (70, 30, 90, 10, 50)]
    none = spark.createDataFrame([], schema)
    for some in (rows, rows[::-1]):
        got = insights.diary_lines(visits, spark.createDataFrame(some, schema), none, "1999-03").collect()
        assert sorted((r.place, r.amount) for r in got) == [(1, 10), (2, 30), (3, 50), (4, 70), (5, 90)]
