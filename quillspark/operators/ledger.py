"""Ledger operators: charges, balances, ageing, income, rates. Each takes and returns DataFrames and runs nothing.

Records: visits (patient_id, kind, date, status, fee, charge_missed, minutes), charges and payments (patient_id, date,
amount, voided; payments also method). Voided rows never count. Null amounts count as zero, rows with a null date are
in balances but in no month. Sums are longs; a sum out of range raises, as Spark's ANSI mode does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First days of the ageing buckets.
AGES = (0, 31, 61, 91)


def visit_charge() -> Column:
    """Held: the fee; cancelled or missed: the fee if missed visits are charged; never negative."""
    due = (F.col("status") == "held") | (F.col("status").isin("cancelled", "no_show") & F.col("charge_missed"))
    return F.when(due, F.greatest(F.coalesce("fee", F.lit(0)), F.lit(0))).otherwise(0).cast("long")


def charged_rows(visits: DataFrame, charges: DataFrame) -> DataFrame:
    """patient_id, date, amount of what was charged."""
    of_visits = visits.select("patient_id", "date", visit_charge().alias("amount")).where("amount > 0")
    return of_visits.unionByName(charges.where(~F.col("voided")).select("patient_id", "date", F.coalesce("amount", F.lit(0)).cast("long").alias("amount")))


def balances(visits: DataFrame, charges: DataFrame, payments: DataFrame) -> DataFrame:
    """patient_id, charged, paid, due."""
    zero = F.lit(0).cast("long")
    plus = charged_rows(visits, charges).select("patient_id", F.col("amount").alias("charged"), zero.alias("paid"))
    minus = payments.where(~F.col("voided")).select("patient_id", zero.alias("charged"), F.coalesce("amount", zero).alias("paid"))
    sums = plus.unionByName(minus).groupBy("patient_id").agg(F.sum("charged").alias("charged"), F.sum("paid").alias("paid"))
    return sums.withColumn("due", F.col("charged") - F.col("paid"))


def total_due(balance: DataFrame) -> DataFrame:
    """One family's credit never hides another's debt."""
    return balance.agg(F.coalesce(F.sum(F.greatest("due", F.lit(0))), F.lit(0)).alias("total_due"), F.count_if(F.col("due") > 0).alias("in_debt"))


def oldest_uncovered(visits: DataFrame, charges: DataFrame, payments: DataFrame) -> DataFrame:
    """patient_id, due, oldest: the first day whose charges the payments, oldest first, no longer cover.

    Charges are summed by patient and day before the running sum, so a window holds a patient's days, not rows.
    """
    days = charged_rows(visits, charges).groupBy("patient_id", "date").agg(F.sum("amount").alias("amount"))
    paid = payments.where(~F.col("voided")).groupBy("patient_id").agg(F.sum(F.coalesce("amount", F.lit(0))).alias("paid"))
    run = Window.partitionBy("patient_id").orderBy(F.col("date").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    so_far = days.withColumn("charged", F.sum("amount").over(run)).join(paid, "patient_id", "left").withColumn("paid", F.coalesce("paid", F.lit(0)))
    return so_far.where(F.col("charged") > F.col("paid")).groupBy("patient_id").agg((F.max("charged") - F.first("paid")).alias("due"), F.min("date").alias("oldest"))


def debt_ageing(uncovered: DataFrame, today: str) -> DataFrame:
    """from_day, n, amount: four buckets by the age of the oldest uncovered charge, those without debts too."""
    age = F.date_diff(F.lit(today).cast("date"), "oldest")
    bucket = F.lit(AGES[0])
    for day in AGES[1:]:
        bucket = F.when(age >= day, day).otherwise(bucket)
    spine = uncovered.sparkSession.createDataFrame([(x,) for x in AGES], "from_day int")
    sums = uncovered.groupBy(bucket.alias("from_day")).agg(F.count(F.lit(1)).alias("n"), F.sum("due").alias("amount"))
    return spine.join(sums, "from_day", "left").select("from_day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0)).alias("amount"))


def month_of(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def month_received(payments: DataFrame) -> DataFrame:
    return payments.where(~F.col("voided") & F.col("date").isNotNull()).groupBy(month_of().alias("month")).agg(F.sum("amount").alias("received"), F.count(F.lit(1)).alias("n"))


def income_year(visits: DataFrame, charges: DataFrame, payments: DataFrame, year: int) -> DataFrame:
    """Twelve months, empty ones too: held, cancelled, charged, received."""
    zero = F.lit(0).cast("long")
    of_visits = visits.select("date", (F.col("status") == "held").cast("long").alias("held"), (F.col("status") == "cancelled").cast("long").alias("cancelled"), visit_charge().alias("charged"), zero.alias("received"))
    of_charges = charges.where(~F.col("voided")).select("date", zero.alias("held"), zero.alias("cancelled"), F.col("amount").alias("charged"), zero.alias("received"))
    of_payments = payments.where(~F.col("voided")).select("date", zero.alias("held"), zero.alias("cancelled"), zero.alias("charged"), F.col("amount").alias("received"))
    first, last = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")
    rows = of_visits.unionByName(of_charges).unionByName(of_payments).where(F.col("date").between(first, last))
    names = ("held", "cancelled", "charged", "received")
    sums = rows.groupBy(F.month("date").alias("month")).agg(*(F.sum(c).alias(c) for c in names))
    spine = visits.sparkSession.range(1, 13, numPartitions=1).select(F.col("id").cast("int").alias("month"))
    return spine.join(sums, "month", "left").select("month", *(F.coalesce(c, zero).alias(c) for c in names))


def diary_month(visits: DataFrame, charges: DataFrame, payments: DataFrame, month: str) -> DataFrame:
    """date, n_visits, n_charges, n_payments, charged, received of each day of a month that has any."""
    one, zero = F.lit(1), F.lit(0)
    rows = (
        visits.where("status <> 'planned'").select("date", one.alias("v"), zero.alias("c"), zero.alias("p"), visit_charge().alias("charged"), zero.cast("long").alias("received"))
        .unionByName(charges.where(~F.col("voided")).select("date", zero.alias("v"), one.alias("c"), zero.alias("p"), F.col("amount").alias("charged"), zero.cast("long").alias("received")))
        .unionByName(payments.where(~F.col("voided")).select("date", zero.alias("v"), zero.alias("c"), one.alias("p"), zero.cast("long").alias("charged"), F.col("amount").alias("received")))
    )
    first = F.to_date(F.lit(f"{month}-01"))
    return rows.where(F.col("date").between(first, F.last_day(first))).groupBy("date").agg(F.sum("v").alias("n_visits"), F.sum("c").alias("n_charges"), F.sum("p").alias("n_payments"), F.sum("charged").alias("charged"), F.sum("received").alias("received"))


def method_sums(payments: DataFrame) -> DataFrame:
    """month, method, amount, n with a total of each month and of all (method, then month, 'all')."""
    rows = payments.where(~F.col("voided") & F.col("date").isNotNull()).select(month_of().alias("month"), F.coalesce("method", F.lit("unknown")).alias("method"), "amount")
    out = rows.groupingSets([[F.col("month"), F.col("method")], [F.col("month")], []], "month", "method").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("month", F.lit("all")).alias("month"), F.coalesce("method", F.lit("all")).alias("method"), "amount", "n")


def weekday_counts(visits: DataFrame) -> DataFrame:
    """Seven days (0: Sunday): held, cancelled, planned."""
    spine = visits.sparkSession.range(0, 7, numPartitions=1).select(F.col("id").cast("int").alias("weekday"))
    names = ("held", "cancelled", "planned")
    sums = visits.groupBy((F.dayofweek("date") - 1).alias("weekday")).agg(*(F.count_if(F.col("status") == s).alias(s) for s in names))
    return spine.join(sums, "weekday", "left").select("weekday", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def per_thousand(part: Column, whole: Column) -> Column:
    """Half up; 0 without a whole."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor((part * 1000 + F.floor(whole / 2)) / F.when(whole == 0, 1).otherwise(whole)))


def month_rates(visits: DataFrame) -> DataFrame:
    """month, held, cancelled, cancelled_per_thousand."""
    rows = visits.where("date is not null").groupBy(month_of().alias("month")).agg(F.count_if(F.col("status") == "held").alias("held"), F.count_if(F.col("status") == "cancelled").alias("cancelled"))
    return rows.withColumn("cancelled_per_thousand", per_thousand(F.col("cancelled"), F.col("held") + F.col("cancelled")))


def top_and_others(rows: DataFrame, name: str, first_by: str, keep: int) -> DataFrame:
    """name, n: the largest groups, equal but for case and blanks, by their first-written form; the rest as 'others'."""
    own = rows.select(F.trim(name).alias("name"), F.col(first_by).alias("at")).where("name <> ''")
    groups = own.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "at").alias("name"), F.count(F.lit(1)).alias("n"))
    top = groups.orderBy(F.desc("n"), "key").limit(keep)
    rest = groups.join(top.select("key"), "key", "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("others").alias("name"), "n")
    return top.select("name", "n").unionByName(rest)


def median_floor(column: str) -> Column:
    """The mean of an even count's middle two, rounded down."""
    return F.floor(F.median(column)).cast("long")


def pathway_days(visits: DataFrame) -> DataFrame:
    """n, median_days from a patient's first held intake to the first held feedback not before it."""
    held = visits.where("status = 'held'")
    start = held.where("kind = 'intake'").groupBy("patient_id").agg(F.min("date").alias("start"))
    end = held.where("kind = 'feedback'").select("patient_id", "date")
    both = start.join(end, "patient_id").where("date >= start").groupBy("patient_id", "start").agg(F.min("date").alias("end"))
    return both.select(F.date_diff("end", "start").alias("days")).agg(F.count(F.lit(1)).alias("n"), median_floor("days").alias("median_days"))


def occupancy(visits: DataFrame, day_minutes: int) -> DataFrame:
    """month, work_days (Sunday to Thursday), held_minutes, per_thousand of the working minutes."""
    held = visits.where("status = 'held'").groupBy(F.trunc("date", "month").alias("first")).agg(F.sum("minutes").alias("held_minutes"))
    days = held.withColumn("day", F.explode(F.sequence("first", F.last_day("first")))).where(F.dayofweek("day") <= 5)
    out = days.groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("work_days"), F.first("held_minutes").alias("held_minutes"))
    return out.withColumn("per_thousand", per_thousand(F.col("held_minutes"), F.col("work_days") * day_minutes))


def with_rollup(live: DataFrame, erased: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Add an anonymous roll-up of deleted rows to live sums."""
    return live.select(*keys, *sums).unionByName(erased.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def tally(visits: DataFrame, charges: DataFrame, payments: DataFrame) -> DataFrame:
    """month, what, part, n of records that are about to be erased: held by kind, cancelled and missed, charged, received by method."""
    month, none = month_of().alias("month"), F.lit("")
    counted = visits.where("status in ('held', 'cancelled', 'no_show')").groupBy(month, F.col("status").alias("what"), F.when(F.col("status") == "held", F.col("kind")).otherwise(none).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    owed = charged_rows(visits, charges).groupBy(month, F.lit("charged").alias("what"), none.alias("part")).agg(F.sum("amount").alias("n"))
    came = payments.where(~F.col("voided")).groupBy(month, F.lit("received").alias("what"), F.coalesce("method", F.lit("unknown")).alias("part")).agg(F.sum("amount").alias("n"))
    return counted.unionByName(owed).unionByName(came).where("month is not null")
