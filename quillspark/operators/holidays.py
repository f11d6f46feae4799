"""Holidays of the Hebrew calendar, by joins of three small tables: years, months and days.

A year begins on the day of its new moon, put off by the four rules of the calendar. How long it is tells its months' lengths;
running sums give where each month begins, and each holiday is a day of a month, moved by its weekday where its rule says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values, in parts of an hour (1,080): a day, a month, and the first new moon, on the second day of its week.
DAY, MONTH = 24 * 1080, (29 * 24 + 12) * 1080 + 793
FIRST_MOON = DAY + 5 * 1080 + 204
#: Days from 1970-01-01 to the Sunday before the first year.
FIRST_SUNDAY = -2_092_591
#: Years of a cycle of 19 that have a thirteenth month.
LEAP = (3, 6, 8, 11, 14, 17, 19)

#: Months in order. Days; None: 30 or 29 by how long the year is.
MONTHS = {
    "Tishrei": 30, "Heshvan": None, "Kislev": None, "Tevet": 29, "Shevat": 30, "First Adar": 30, "Adar": 29, "Nisan": 30, "Iyar": 29, "Sivan": 30, "Tammuz": 29, "Av": 30, "Elul": 29,
}

#: Month, days of the month, name ({n}: which of the days), whether no work is done, and the rule that moves it.
HOLIDAYS = [
    ("Tishrei", (1, 2), "New Year", True, None),
    ("Tishrei", (9,), "Eve of Atonement", False, None),
    ("Tishrei", (10,), "Day of Atonement", True, None),
    ("Tishrei", (14,), "Eve of Tabernacles", False, None),
    ("Tishrei", (15,), "Tabernacles", True, None),
    ("Tishrei", (16, 17, 18, 19, 20), "Middle of Tabernacles", False, None),
    ("Tishrei", (21,), "Great Hosanna", False, None),
    ("Tishrei", (22,), "Rejoicing of the Law", True, None),
    ("Kislev", (24, 25, 26, 27, 28, 29, 30, 31), "Hanukkah, candle {n}", False, None),
    ("Kislev", (32,), "Hanukkah, last day", False, None),
    ("Shevat", (15,), "New Year of Trees", False, None),
    ("Adar", (13,), "Fast of Esther", False, "fast before"),
    ("Adar", (14,), "Purim", False, None),
    ("Adar", (15,), "Shushan Purim", False, None),
    ("Nisan", (14,), "Eve of Passover", False, None),
    ("Nisan", (15,), "Passover", True, None),
    ("Nisan", (16, 17, 18, 19, 20), "Middle of Passover", False, None),
    ("Nisan", (21,), "Seventh of Passover", True, None),
    ("Nisan", (27,), "Holocaust Day", False, "remembrance"),
    ("Iyar", (4,), "Memorial Day", False, "memorial"),
    ("Iyar", (5,), "Independence Day", True, "independence"),
    ("Iyar", (18,), "Lag BaOmer", False, None),
    ("Iyar", (28,), "Jerusalem Day", False, None),
    ("Sivan", (5,), "Eve of Weeks", False, None),
    ("Sivan", (6,), "Weeks", True, None),
    ("Av", (9,), "Ninth of Av", False, "fast after"),
    ("Elul", (29,), "Eve of New Year", False, None),
]

#: Rule, weekday (Sunday is 0) that the day would be, days that it moves by.
MOVES = [
    ("fast before", 6, -2),
    ("fast after", 6, 1),
    ("remembrance", 5, -1),
    ("remembrance", 0, 1),
    ("independence", 5, -1),
    ("independence", 6, -2),
    ("independence", 1, 1),
    ("memorial", 4, -1),
    ("memorial", 5, -2),
    ("memorial", 0, 1),
]


def new_years(spark: SparkSession, last: int) -> DataFrame:
    """year, starts (days from 1970-01-01), days, of each year up to `last`: some thousand rows, whatever the data."""
    years = spark.range(1, last + 2, numPartitions=1).withColumnRenamed("id", "year")
    leap = F.pmod(F.col("year") - 1, F.lit(19)) + 1
    years = years.withColumn("leap", leap.isin(*LEAP))
    order = Window.orderBy("year")
    before = F.coalesce(F.sum(12 + F.col("leap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moon = years.withColumn("moon", F.lit(FIRST_MOON) + MONTH * before).withColumn("after_leap", F.coalesce(F.lag("leap").over(order), F.lit(False)))
    at = moon.withColumn("day", F.floor(F.col("moon") / DAY)).withColumn("part", F.col("moon") % DAY)
    weekday = F.pmod("day", F.lit(7))
    # too late in the day; or else the year, or the one before, would get a length that there isn't
    late = F.col("part") >= 18 * 1080
    long = ~F.col("leap") & (weekday == 2) & (F.col("part") >= 9 * 1080 + 204)
    short = F.col("after_leap") & (weekday == 1) & (F.col("part") >= 15 * 1080 + 589)
    put_off = at.withColumn("day", F.col("day") + (late | long | short).cast("int"))
    # never on the first, fourth or sixth day of a week
    starts = F.col("day") + F.pmod("day", F.lit(7)).isin(0, 3, 5).cast("int") + FIRST_SUNDAY
    return put_off.select("year", starts.alias("starts")).withColumn("days", F.lead("starts").over(order) - F.col("starts")).where(F.col("days").isNotNull())


def month_starts(years: DataFrame) -> DataFrame:
    """years: see new_years. year, month, first: days from 1970-01-01 to each month's first."""
    rows = years.select("year", "starts", "days", F.posexplode(F.array(*map(F.lit, MONTHS))).alias("place", "month")).where((F.col("days") > 355) | (F.col("month") != "First Adar"))
    fixed = F.create_map(*(F.lit(x) for m, n in MONTHS.items() if n for x in (m, n)))
    long = F.when(F.col("month") == "Heshvan", F.when(F.col("days") % 10 == 5, 30).otherwise(29)).when(F.col("month") == "Kislev", F.when(F.col("days") % 10 == 3, 29).otherwise(30)).otherwise(fixed[F.col("month")])
    past = F.coalesce(F.sum(long).over(Window.partitionBy("year").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("year", "month", (F.col("starts") + past).alias("first"))


def holidays(years: DataFrame) -> DataFrame:
    """years: year (of the common calendar). date, name, closed of their holidays; repeated and null years count once and not at all."""
    spark = years.sparkSession
    asked = years.select(F.col("year").cast("int").alias("year")).where("year is not null").distinct()
    last = asked.agg(F.max("year")).first()[0] or 0
    listed = [(m, d, name.format(n=i + 1), closed, rule) for m, days, name, closed, rule in HOLIDAYS for i, d in enumerate(days)]
    days = spark.createDataFrame(listed, "month string, day int, name string, closed boolean, rule string")
    moves = spark.createDataFrame(MOVES, "rule string, weekday int, by int")
    dated = month_starts(new_years(spark, last + 3761)).join(F.broadcast(days), "month").withColumn("at", F.col("first") + F.col("day") - 1)
    dated = dated.withColumn("weekday", F.pmod(F.col("at") + 4, F.lit(7)).cast("int")).join(F.broadcast(moves), ["rule", "weekday"], "left")
    out = dated.select(F.date_from_unix_date((F.col("at") + F.coalesce("by", F.lit(0))).cast("int")).alias("date"), "name", "closed")
    return out.join(F.broadcast(asked), F.year("date") == F.col("year"), "left_semi")


def between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Those between two dates."""
    years = spark.range(int(first[:4]), int(last[:4]) + 1, numPartitions=1).withColumnRenamed("id", "year")
    return holidays(years).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def closed_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return between(spark, first, last).where("closed").select("date").distinct()
