"""Insights over a stretch of months ("YYYY-MM" to "YYYY-MM", both counted): what was held, how long families waited, what came in.

Records as in operators.ledger. A patient's visit is one that isn't a block and has a patient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.ledger import median_floor, month_of, visit_charge


def bounds(first: str, last: str) -> tuple[Column, Column]:
    return F.to_date(F.lit(f"{first}-01")), F.last_day(F.to_date(F.lit(f"{last}-01")))


def of_patients(visits: DataFrame) -> DataFrame:
    return visits.where("kind <> 'block' and patient_id is not null")


def held(visits: DataFrame) -> DataFrame:
    return of_patients(visits).where("status = 'held' and date is not null")


def held_in_order(visits: DataFrame) -> DataFrame:
    """id, patient_id, date, start, nth held visit of the patient."""
    order = Window.partitionBy("patient_id").orderBy("date", "start", "id")
    return held(visits).select("id", "patient_id", "date", "start", F.row_number().over(order).alias("nth"))


def fold_visits(visits: DataFrame) -> DataFrame:
    """month, kind, n of held visits that are about to be erased: what stays of them."""
    return visits.where("status = 'held' and date is not null").groupBy(month_of().alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))


def fold_cards(patients: DataFrame) -> DataFrame:
    """month, n of cards that are about to be erased."""
    return patients.where("created_on is not null").groupBy(month_of("created_on").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def by_kind(visits: DataFrame, first: str, last: str, tally: DataFrame | None = None) -> DataFrame:
    """kind, n of held visits, and of erased ones where there is a tally."""
    rows = held(visits).where(F.col("date").between(*bounds(first, last))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    if tally is None:
        return rows
    return rows.unionByName(tally.where(F.col("month").between(first, last)).select("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")


def opened(patients: DataFrame, cards: DataFrame, first: str, last: str) -> DataFrame:
    """One row: cards opened, the erased ones too."""
    live = patients.where(F.col("created_on").between(*bounds(first, last))).agg(F.count(F.lit(1)).alias("n"))
    return live.unionByName(cards.where(F.col("month").between(first, last)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).agg(F.sum("n").alias("opened"))


def waited(patients: DataFrame, visits: DataFrame, first: str, last: str) -> DataFrame:
    """n, median_days from joining the list to the first held visit, of those whose first was in the stretch."""
    seen = held(visits).groupBy("patient_id").agg(F.min("date").alias("first")).where(F.col("first").between(*bounds(first, last)))
    days = patients.where("waiting_since is not null").join(seen, F.col("id") == F.col("patient_id")).select(F.date_diff("first", "waiting_since").alias("days")).where("days >= 0")
    return days.agg(F.count(F.lit(1)).alias("n"), median_floor("days").alias("median_days"))


def waiting_now(patients: DataFrame, today: str) -> DataFrame:
    """waiting, median_days that those on the list have waited, since they joined or else since their card was opened."""
    days = F.date_diff(F.lit(today).cast("date"), F.coalesce("waiting_since", "created_on"))
    rows = patients.where("status = 'waiting'").select(F.when(days >= 0, days).alias("days"))
    return rows.agg(F.count(F.lit(1)).alias("waiting"), median_floor("days").alias("median_days"))


def to_feedback(visits: DataFrame, first: str, last: str) -> DataFrame:
    """from_intake, from_assessment (median days), feedbacks: up to each patient's last held feedback of the stretch.

    From the first intake, or the first visit where there was none; and from the last assessment before it.
    """
    seen = held(visits).select("patient_id", "kind", "date", F.struct("date", "start").alias("at"))
    end = seen.where((F.col("kind") == "feedback") & F.col("date").between(*bounds(first, last))).groupBy("patient_id").agg(F.max("at").alias("end"))
    kind = lambda k: F.when(F.col("kind") == k, F.col("at"))
    per = seen.join(end, "patient_id").where("at <= end").groupBy("patient_id", "end").agg(
        F.min(kind("intake")).alias("intake"), F.min("at").alias("first"), F.max(F.when(F.col("at") < F.col("end"), kind("assessment"))).alias("assessed"))
    days = per.select(F.date_diff("end.date", F.coalesce("intake.date", "first.date")).alias("a"), F.date_diff("end.date", "assessed.date").alias("b"))
    return days.agg(median_floor("a").alias("from_intake"), median_floor("b").alias("from_assessment"), F.count(F.lit(1)).alias("feedbacks"))


def work_minutes(spark: SparkSession, first: str, last: str, today: str, days: tuple[int, ...], per_day: int, closed: DataFrame) -> DataFrame:
    """One row: minutes of the working days (1: Sunday) up to today that aren't closed (date)."""
    start, end = bounds(first, last)
    calendar = spark.range(1).select(F.explode(F.sequence(start, F.least(end, F.lit(today).cast("date")))).alias("date")).where(F.dayofweek("date").isin(*days))
    return calendar.join(closed.select("date").distinct(), "date", "left_anti").agg((F.count(F.lit(1)) * per_day).alias("work_minutes"))


def month_money(visits: DataFrame, charges: DataFrame, payments: DataFrame) -> DataFrame:
    """month, held, cancelled, no_show, charged, received of months that have any."""
    zero, one = F.lit(0).cast("long"), lambda s: (F.col("status") == s).cast("long")
    rows = visits.select("date", *(one(s).alias(n) for s, n in (("held", "held"), ("cancelled", "cancelled"), ("no_show", "no_show"))), visit_charge().alias("charged"), zero.alias("received"))
    none = [zero.alias(n) for n in ("held", "cancelled", "no_show")]
    rows = rows.unionByName(charges.where(~F.col("voided")).select("date", *none, F.col("amount").alias("charged"), zero.alias("received")))
    rows = rows.unionByName(payments.where(~F.col("voided")).select("date", *none, zero.alias("charged"), F.col("amount").alias("received")))
    return rows.where("date is not null").groupBy(month_of().alias("month")).agg(*(F.sum(n).alias(n) for n in ("held", "cancelled", "no_show", "charged", "received")))


def income_months(visits: DataFrame, charges: DataFrame, payments: DataFrame, first: str, last: str) -> DataFrame:
    """month_money of each month of a stretch, empty ones too."""
    inside = lambda x: x.where(F.col("date").between(*bounds(first, last)))
    sums = month_money(inside(visits), inside(charges), inside(payments))
    start, end = bounds(first, last)
    spine = visits.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("first")).select(F.date_format("first", "yyyy-MM").alias("month"))
    return spine.join(sums, "month", "left").select("month", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("held", "cancelled", "no_show", "charged", "received")))


def diary_lines(visits: DataFrame, charges: DataFrame, payments: DataFrame, month: str) -> DataFrame:
    """date, line (0: visit, 1: charge, 2: payment), id, patient_id, amount, place within the day. Voided lines are shown too.

    Lines of one id (the ids of charges and payments need not be distinct) stand by patient and amount, so that places are the same each time.
    """
    zero = F.lit(0)
    inside = lambda x: x.where(F.col("date").between(*bounds(month, month)))
    rows = inside(visits).where("status <> 'planned'").select("date", zero.alias("line"), "start", "id", "patient_id", visit_charge().alias("amount"))
    for n, x in ((1, charges), (2, payments)):
        rows = rows.unionByName(inside(x).select("date", F.lit(n).alias("line"), zero.alias("start"), "id", "patient_id", "amount"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("line", "start", "id", "patient_id", "amount"))).drop("start")


def preceding(first: str, last: str) -> tuple[str, str]:
    """The stretch of the same length just before."""
    at = lambda m: int(m[:4]) * 12 + int(m[5:]) - 1
    text = lambda n: f"{n // 12:04d}-{n % 12 + 1:02d}"
    length = at(last) - at(first) + 1
    return text(at(first) - length), text(at(last) - length)


def with_preceding(visits: DataFrame, charges: DataFrame, payments: DataFrame, first: str, last: str) -> DataFrame:
    """stretch (now, before), held, cancelled, no_show, charged, received."""
    names = ("held", "cancelled", "no_show", "charged", "received")
    out = None
    for name, (a, b) in (("now", (first, last)), ("before", preceding(first, last))):
        sums = income_months(visits, charges, payments, a, b).agg(*(F.sum(n).alias(n) for n in names)).select(F.lit(name).alias("stretch"), *names)
        out = sums if out is None else out.unionByName(sums)
    return out


def method_order(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """rows: method, amount. With `place` by the order of a screen, others last; methods without an amount are left out."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, methods)), F.col("method")), F.lit(0))
    sums = rows.groupBy("method").agg(F.sum("amount").alias("amount")).where("amount > 0")
    return sums.withColumn("place", F.when(place == 0, len(methods) + 1).otherwise(place).cast("int"))

