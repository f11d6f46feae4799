"""Alerts: nine rules over a practice's records, each a small query, united and ordered.

Records as in operators.ledger, with visits' id and start; patients (id, status, waiting_since, created_on), tasks (id, patient_id,
kind, due, done_on), notes (visit_id, patient_id), reports (patient_id, approved, total). Records of a patient who isn't among
the patients are not looked at, but for tasks. Null dates raise no alert.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import ledger

#: The order of kinds among alerts of one day.
RANK = {"unmarked": 0, "no_note": 1, "task_overdue": 2, "feedback_soon": 3, "materials_missing": 4, "report_due": 5, "debt": 6, "no_next_visit": 7, "waiting": 8, "unreadable": 9}
#: Kinds of visit that ask for a note, and days that the rules look ahead or back.
NOTED = ("intake", "assessment", "observation", "feedback", "therapy", "guidance")
NO_NOTE_DAYS, FEEDBACK_SOON_DAYS, NO_NEXT_VISIT_DAYS = 60, 7, 14
COLUMNS = "kind string, since date, patient_id long, visit_id long, task_id long, n long"


@dataclass(frozen=True)
class Today:
    date: str
    minute: int = 0

    @property
    def day(self) -> Column:
        return F.lit(self.date).cast("date")


@dataclass(frozen=True)
class Settings:
    debt_days: int = 60
    waiting_weeks: int = 8
    report_days: int = 30


def _row(rows: DataFrame, kind: str, since: str, patient: str = "patient_id", visit: str | None = None, task: str | None = None, n: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    at = lambda c: F.col(c).cast("long") if c else none
    return rows.select(F.lit(kind).alias("kind"), F.col(since).alias("since"), at(patient).alias("patient_id"), at(visit).alias("visit_id"), at(task).alias("task_id"), (none if n is None else n.cast("long")).alias("n"))


def finished(reports: DataFrame) -> DataFrame:
    """patient_id of those whose report is done."""
    return reports.where("total > 0 and approved >= total").select("patient_id").distinct()


def open_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where("done_on is null")


def unmarked(visits: DataFrame, today: Today) -> DataFrame:
    """Planned visits that have ended."""
    ended = (F.col("date") < today.day) | ((F.col("date") == today.day) & (F.col("start") + F.col("minutes") <= today.minute))
    return _row(visits.where((F.col("status") == "planned") & (F.col("kind") != "block") & ended), "unmarked", "date", visit="id")


def _feedback_near(visits: DataFrame, today: Today) -> DataFrame:
    return visits.where((F.col("status") == "planned") & (F.col("kind") == "feedback") & F.date_diff("date", today.day).between(0, FEEDBACK_SOON_DAYS))


def feedback_soon(visits: DataFrame, reports: DataFrame, today: Today) -> DataFrame:
    return _row(_feedback_near(visits, today).join(finished(reports), "patient_id", "left_anti"), "feedback_soon", "date", visit="id")


def materials_missing(visits: DataFrame, tasks: DataFrame, today: Today) -> DataFrame:
    """n: questionnaires and documents still open a week before the feedback."""
    missing = open_tasks(tasks).where("kind in ('questionnaire', 'document')").groupBy("patient_id").agg(F.count(F.lit(1)).alias("missing"))
    return _row(_feedback_near(visits, today).join(missing, "patient_id"), "materials_missing", "date", visit="id", n=F.col("missing"))


def no_note(visits: DataFrame, notes: DataFrame, today: Today) -> DataFrame:
    held = visits.where((F.col("status") == "held") & F.col("kind").isin(*NOTED) & F.date_diff(today.day, "date").between(0, NO_NOTE_DAYS))
    noted = notes.where("visit_id is not null").select("patient_id", F.col("visit_id").alias("id")).distinct()
    return _row(held.join(noted, ["patient_id", "id"], "left_anti"), "no_note", "date", visit="id")


def debt(uncovered: DataFrame, today: Today, settings: Settings) -> DataFrame:
    """n: what is owed."""
    return _row(uncovered.where((F.col("due") > 0) & (F.date_diff(today.day, "oldest") >= settings.debt_days)), "debt", "oldest", n=F.col("due"))


def waiting(patients: DataFrame, today: Today, settings: Settings) -> DataFrame:
    """n: whole weeks on the list, since the day of joining or else of the card."""
    rows = patients.where("status = 'waiting'").select("id", F.coalesce("waiting_since", "created_on").alias("since"))
    days = F.date_diff(today.day, "since")
    return _row(rows.where(days >= 7 * settings.waiting_weeks), "waiting", "since", "id", n=F.floor(days / 7))


def by_patient(visits: DataFrame, today: Today) -> DataFrame:
    """patient_id and what the rules about a patient's visits need, in one pass."""
    when = lambda kind, status, date: F.when((F.col("kind") == kind) & (F.col("status") == status), date)
    date = F.col("date")
    return visits.groupBy("patient_id").agg(
        F.max(when("assessment", "held", date)).alias("assessed"),
        F.count_if((F.col("kind") == "assessment") & (F.col("status") == "planned") & (date >= today.day)).alias("assessments_ahead"),
        F.count_if((F.col("kind") == "feedback") & (F.col("status") == "held")).alias("feedbacks"),
        F.max(F.when(date <= today.day, date)).alias("last_day"),
        F.count_if((F.col("status") == "planned") & (date >= today.day)).alias("ahead"),
    )


def report_due(patients: DataFrame, of: DataFrame, reports: DataFrame, today: Today, settings: Settings) -> DataFrame:
    """The last assessment is over for some time, no other is ahead, no feedback was held and the report isn't done."""
    active = patients.where("status = 'active'").select(F.col("id").alias("patient_id"))
    late = of.where((F.col("assessments_ahead") == 0) & (F.col("feedbacks") == 0) & (F.date_diff(today.day, "assessed") > settings.report_days))
    return _row(late.join(active, "patient_id", "left_semi").join(finished(reports), "patient_id", "left_anti"), "report_due", "assessed")


def no_next_visit(patients: DataFrame, of: DataFrame, tasks: DataFrame, balances: DataFrame, today: Today) -> DataFrame:
    """Active, last seen over two weeks ago, nothing planned, no open task, and not through with a feedback and all paid."""
    active = patients.where("status = 'active'").select(F.col("id").alias("patient_id"))
    busy = open_tasks(tasks).select("patient_id").distinct()
    quiet = of.where((F.col("ahead") == 0) & (F.date_diff(today.day, "last_day") > NO_NEXT_VISIT_DAYS)).join(active, "patient_id", "left_semi").join(busy, "patient_id", "left_anti")
    owing = quiet.join(balances.select("patient_id", "due"), "patient_id", "left").where((F.col("feedbacks") == 0) | (F.coalesce("due", F.lit(0)) > 0))
    return _row(owing, "no_next_visit", "last_day")


def task_overdue(tasks: DataFrame, patients: DataFrame, today: Today) -> DataFrame:
    """A task of an unknown patient counts as nobody's."""
    known = patients.select(F.col("id").alias("known"))
    late = open_tasks(tasks).where(F.col("due") < today.day)
    return _row(late.join(known, F.col("patient_id") == F.col("known"), "left"), "task_overdue", "due", "known", task="id")


def unreadable(rows: DataFrame, damaged: Column, today: Today) -> DataFrame:
    """One row with the number of rows that can't be read; none where all can."""
    counted = rows.agg(F.count_if(damaged).alias("k")).where("k > 0").select(today.day.alias("since"), "k", F.lit(None).cast("long").alias("nobody"))
    return _row(counted, "unreadable", "since", "nobody", n=F.col("k"))


def clinic_alerts(patients: DataFrame, visits: DataFrame, charges: DataFrame, payments: DataFrame, tasks: DataFrame, notes: DataFrame, reports: DataFrame, today: Today, settings: Settings = Settings()) -> DataFrame:
    """kind, rank, since, patient_id, visit_id, task_id, n of all rules."""
    known = patients.select(F.col("id").alias("patient_id"))
    visits, charges, payments = (x.join(known, "patient_id", "left_semi") for x in (visits, charges, payments))
    of = by_patient(visits, today)
    uncovered = ledger.oldest_uncovered(visits, charges, payments)
    out = unmarked(visits, today)
    for more in (
        no_note(visits, notes, today), task_overdue(tasks, patients, today), feedback_soon(visits, reports, today), materials_missing(visits, tasks, today), report_due(patients, of, reports, today, settings),
        debt(uncovered, today, settings), no_next_visit(patients, of, tasks, ledger.balances(visits, charges, payments), today), waiting(patients, today, settings),
    ):
        out = out.unionByName(more)
    return out.withColumn("rank", rank_of("kind"))


def rank_of(kind: str) -> Column:
    out = F.lit(None).cast("int")
    for k, r in RANK.items():
        out = F.when(F.col(kind) == k, r).otherwise(out)
    return out


def in_order(alerts: DataFrame) -> DataFrame:
    """Oldest first; then by kind, patient, visit and task, those without one first."""
    return alerts.orderBy("since", "rank", *(F.col(c).asc_nulls_first() for c in ("patient_id", "visit_id", "task_id")))
