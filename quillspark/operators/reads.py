"""Composed reads: what a screen asks of the records, as joins of grouped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import ledger, schedule
from quillspark.operators.alerts import Today, open_tasks


def visit_views(visits: DataFrame, patients: DataFrame, notes: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """visits' id, patient_id, date, start, kind, status, with name, has_note, overlaps (within `among`, or all of them, of a day)."""
    names = patients.select(F.col("id").alias("patient_id"), "name")
    noted = notes.where("visit_id is not null").select(F.col("visit_id").alias("id")).distinct().withColumn("has_note", F.lit(True))
    hit = schedule.overlapping(visits if among is None else among, ("date",)).distinct().withColumn("overlaps", F.lit(True))
    rows = visits.select("id", "patient_id", "date", "start", "kind", "status").join(names, "patient_id", "left").join(noted, "id", "left").join(hit, "id", "left")
    return rows.select("id", "patient_id", "date", "start", "kind", "status", "name", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_note", "overlaps")))


def task_views(tasks: DataFrame, patients: DataFrame, today: Today) -> DataFrame:
    """id, patient_id, title, due, done_on, name, overdue."""
    names = patients.select(F.col("id").alias("patient_id"), "name")
    late = F.col("done_on").isNull() & F.coalesce(F.col("due") < today.day, F.lit(False))
    return tasks.join(names, "patient_id", "left").select("id", "patient_id", "title", "due", "done_on", "name", late.alias("overdue"))


def age_months(birth: Column, today: Column) -> Column:
    """Whole months; a month is complete on the birth day, or on the last day of a shorter month. Null for birthdays ahead."""
    months = (F.year(today) - F.year(birth)) * 12 + F.month(today) - F.month(birth)
    short = F.dayofmonth(today) < F.least(F.dayofmonth(birth), F.dayofmonth(F.last_day(today)))
    return F.when(birth <= today, (months - short.cast("int")).cast("int"))


def patient_rows(patients: DataFrame, visits: DataFrame, charges: DataFrame, payments: DataFrame, tasks: DataFrame, today: Today) -> DataFrame:
    """id, name, status, age_years, age_months, next_date, next_start, last_date, due, open_tasks of every patient."""
    at = F.struct("date", "start")
    of = visits.where("date is not null").groupBy("patient_id").agg(
        F.min(F.when((F.col("status") == "planned") & (F.col("date") >= today.day), at)).alias("next"), F.max(F.when(F.col("status") == "held", at)).alias("last"))
    due = ledger.balances(visits, charges, payments).select("patient_id", "due")
    left = open_tasks(tasks).groupBy("patient_id").agg(F.count(F.lit(1)).alias("open_tasks"))
    age = age_months(F.col("birth_date"), today.day)
    rows = patients.withColumnRenamed("id", "patient_id").join(of, "patient_id", "left").join(due, "patient_id", "left").join(left, "patient_id", "left")
    return rows.select(
        F.col("patient_id").alias("id"), "name", "status", F.floor(age / 12).cast("int").alias("age_years"), F.pmod(age, F.lit(12)).cast("int").alias("age_months"),
        F.col("next.date").alias("next_date"), F.col("next.start").alias("next_start"), F.col("last.date").alias("last_date"), F.coalesce("due", F.lit(0)).alias("due"), F.coalesce("open_tasks", F.lit(0)).alias("open_tasks"),
    )


def card(patients: DataFrame, visits: DataFrame, charges: DataFrame, payments: DataFrame, notes: DataFrame, tasks: DataFrame, patient: int, today: Today) -> DataFrame:
    """One patient's lines: section (visit, charge, payment, note, task), date, id, what. The patient is filtered before anything is joined."""
    own = lambda x: x.where(F.col("patient_id") == patient)
    line = lambda x, section, date, ident, what: own(x).select(F.lit(section).alias("section"), F.col(date).alias("date"), F.col(ident).cast("long").alias("id"), what.cast("string").alias("what"))
    out = line(visits, "visit", "date", "id", F.concat_ws(" ", "kind", "status"))
    for more in (line(charges, "charge", "date", "id", F.col("amount")), line(payments, "payment", "date", "id", F.col("amount")), line(notes, "note", "date", "visit_id", F.lit("note")), line(tasks, "task", "due", "id", F.col("title"))):
        out = out.unionByName(more)
    return out


def overview(patients: DataFrame, visits: DataFrame, charges: DataFrame, payments: DataFrame, tasks: DataFrame, today: Today) -> DataFrame:
    """One row: visits_today, next_day, week_visits, open_tasks, overdue, month_received, total_due, waiting, active."""
    day, sunday = today.day, F.date_sub(today.day, F.dayofweek(today.day) - 1)
    live = visits.where("kind <> 'block' and status <> 'cancelled'")
    of_visits = live.agg(
        F.count_if(F.col("date") == day).alias("visits_today"),
        F.min(F.when((F.col("status") == "planned") & (F.col("date") > day), F.col("date"))).alias("next_day"),
        F.count_if(F.col("date").between(sunday, F.date_add(sunday, 6))).alias("week_visits"),
    )
    of_tasks = open_tasks(tasks).agg(F.count(F.lit(1)).alias("open_tasks"), F.count_if(F.col("due") < day).alias("overdue"))
    month = payments.where(~F.col("voided") & (F.trunc("date", "month") == F.trunc(day, "month"))).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("month_received"))
    due = ledger.total_due(ledger.balances(visits, charges, payments)).select("total_due")
    status = patients.agg(F.count_if(F.col("status") == "waiting").alias("waiting"), F.count_if(F.col("status") == "active").alias("active"))
    # one row each
    return of_visits.crossJoin(of_tasks).crossJoin(month).crossJoin(due).crossJoin(status)


def marked(visits: DataFrame, history: DataFrame) -> DataFrame:
    """id of visits that were ever marked, by themselves or by a saved version."""
    once = history.where("status <> 'planned'").select(F.col("record_id").alias("id")).distinct()
    return visits.where("status <> 'planned'").select("id").unionByName(visits.select("id").join(once, "id", "left_semi")).distinct()


def history_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("record_id").agg(F.count(F.lit(1)).alias("versions"))


def history_lines(history: DataFrame, record: int) -> DataFrame:
    """saved_at, status, changed (from the version before) of one record."""
    own = history.where(F.col("record_id") == record)
    before = F.lag("status").over(Window.partitionBy("record_id").orderBy("saved_at", "status"))
    return own.select("saved_at", "status", F.coalesce(before != F.col("status"), F.lit(True)).alias("changed"))


def case_states(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """cases: case_id. case_id, approved, total, finished; cases without a report have 0 of 0."""
    zero = F.lit(0)
    rows = cases.join(reports.select(F.col("patient_id").alias("case_id"), "approved", "total"), "case_id", "left").select("case_id", F.coalesce("approved", zero).alias("approved"), F.coalesce("total", zero).alias("total"))
    return rows.withColumn("finished", (F.col("total") > 0) & (F.col("approved") >= F.col("total")))


def unlinked_cases(cases: DataFrame, patients: DataFrame) -> DataFrame:
    return cases.join(patients.where("case_id is not null").select("case_id").distinct(), "case_id", "left_anti")


def waiting_list(patients: DataFrame) -> DataFrame:
    """place, id, since of waiting patients: urgent first, then by the day they wait since, name and id."""
    rows = patients.where("status = 'waiting'").select("id", "name", "urgent", F.coalesce("waiting_since", "created_on").alias("since"))
    return rows.select("id", "urgent", "since", "name").orderBy(F.desc("urgent"), F.col("since").asc_nulls_last(), "name", "id")
