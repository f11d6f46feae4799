"""Schedule operators: overlaps, neighbours in time, working days, free starts, series, differences, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def overlapping(visits: DataFrame, by: tuple[str, ...] = ("patient_id", "date")) -> DataFrame:
    """Ids of visits, not cancelled, that overlap another of the same group; touching is no overlap.

    No pairs are made: a visit overlaps one that starts before it if the latest end so far is after its start, and one
    that starts after it if the next start is before its end.
    """
    v = visits.where("status <> 'cancelled' and date is not null").select("id", *by, "start", (F.col("start") + F.col("minutes")).alias("end"))
    order = Window.partitionBy(*by).orderBy("start", "id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return v.select("id", (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(F.lead("start").over(order) < F.col("end"), F.lit(False))).alias("hit")).where("hit").select("id")


def neighbours(visits: DataFrame, today: str) -> DataFrame:
    """patient_id, last_held, next_planned (ids): the last held before today and the first planned from today on."""
    at = F.struct("date", "start", "id")
    day = F.lit(today).cast("date")
    last = F.max(F.when((F.col("status") == "held") & (F.col("date") < day), at))["id"]
    ahead = F.min(F.when((F.col("status") == "planned") & (F.col("date") >= day), at))["id"]
    return visits.where("date is not null").groupBy("patient_id").agg(last.alias("last_held"), ahead.alias("next_planned"))


def free_starts(visits: DataFrame, first: str, last: str, opens: int, closes: int, length: int, per_day: int) -> DataFrame:
    """date, start: the first free starts of each day, on a grid of `length` minutes.

    Visits are dealt out to the grid's cells that they touch, so the join is an equality.
    """
    spark = visits.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).select("date", F.explode(F.sequence(F.lit(opens), F.lit(closes - length), F.lit(length))).alias("start"))
    day = visits.where("status <> 'cancelled'").where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    cell = lambda minute: F.floor((minute - opens) / length)
    busy = day.select("date", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("minutes") - 1))).alias("cell")).select("date", (F.col("cell") * length + opens).cast("int").alias("start")).distinct()
    free = grid.join(busy, ["date", "start"], "left_anti")
    return free.withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy("start"))).where(F.col("r") <= per_day).drop("r")


def series(starts: DataFrame, every_weeks: int, count: int) -> DataFrame:
    """id, n, date: `count` dates every so many weeks."""
    return starts.select("id", F.posexplode(F.sequence(F.lit(0), F.lit(count - 1))).alias("n", "k"), "date").select("id", "n", F.date_add("date", F.col("k") * 7 * every_weeks).alias("date"))


def differences(wanted: DataFrame, there: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, action: insert, update or delete what makes `there` equal to `wanted`."""
    a, b = (x.select(key, F.struct(*values).alias(n)) for x, n in ((wanted, "a"), (there, "b")))
    action = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action is not null")


def alerts(visits: DataFrame, uncovered: DataFrame, today: str) -> DataFrame:
    """patient_id, alert, since: planned visits of the past without an outcome, patients with a held visit in the last 60 days and nothing ahead, debts over 60 days."""
    day = F.lit(today).cast("date")
    unmarked = visits.where((F.col("status") == "planned") & (F.col("date") < day)).groupBy("patient_id").agg(F.min("date").alias("since")).select("patient_id", F.lit("unmarked").alias("alert"), "since")
    last = visits.groupBy("patient_id").agg(F.max(F.when(F.col("status") == "held", F.col("date"))).alias("since"), F.count_if((F.col("status") == "planned") & (F.col("date") >= day)).alias("ahead"))
    quiet = last.where((F.col("ahead") == 0) & F.col("since").between(F.date_sub(day, 60), day)).select("patient_id", F.lit("no_next_visit").alias("alert"), "since")
    debt = uncovered.where(F.date_diff(day, "oldest") > 60).select("patient_id", F.lit("old_debt").alias("alert"), F.col("oldest").alias("since"))
    return unmarked.unionByName(quiet).unionByName(debt)


def in_range(visits: DataFrame, first: str, last: str) -> DataFrame:
    return visits.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def week_of(date: Column) -> dict[str, Column]:
    """The Sunday and the Saturday of the date's week."""
    sunday = F.date_sub(date, F.dayofweek(date) - 1)
    return {"sunday": sunday, "saturday": F.date_add(sunday, 6)}


def working_days(spark: SparkSession, first: str, last: str, days: tuple[int, ...], closed: DataFrame | None = None) -> DataFrame:
    """date of each working day (1: Sunday) that isn't among the closed ones (date)."""
    out = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).where(F.dayofweek("date").isin(*days))
    return out if closed is None else out.join(closed.select("date").distinct(), "date", "left_anti")


def free_on_grid(days: DataFrame, visits: DataFrame, opens: int, closes: int, length: int, buffer: int = 0, step: int = 15) -> DataFrame:
    """date, start: starts on a grid of `step` minutes from midnight that no visit comes nearer to than `buffer` minutes.

    A visit is dealt out to the grid's starts that it blocks, so the join is an equality and a day's visits stay small.
    """
    first = -(-opens // step) * step
    grid = days.select("date", F.explode(F.sequence(F.lit(first), F.lit(closes - length), F.lit(step))).alias("start")) if first <= closes - length else days.select("date", F.lit(0).alias("start")).where("false")
    begin, end = F.greatest(F.col("start") - buffer, F.lit(0)), F.col("start") + F.col("minutes") + buffer
    low, high = (F.floor((begin - length) / step) + 1) * step, (F.ceil(end / step) - 1) * step
    busy = visits.where("status <> 'cancelled' and minutes > 0").join(days, "date", "left_semi").select("date", F.greatest(low, F.lit(0)).cast("int").alias("low"), high.cast("int").alias("high")).where("low <= high")
    blocked = busy.select("date", F.explode(F.sequence("low", "high", F.lit(step))).alias("start")).distinct()
    return grid.join(blocked, ["date", "start"], "left_anti")


def spread(starts: Column, length: int, most: int) -> Column:
    """Of a day's starts in order, each that begins when the one picked before has ended, `most` at most."""
    fits = lambda picked, s: (F.size(picked) < most) & ((F.size(picked) == 0) | (s >= F.coalesce(F.get(picked, F.size(picked) - 1), F.lit(0)) + length))
    return F.aggregate(F.array_sort(starts), F.array().cast("array<int>"), lambda picked, s: F.when(fits(picked, s), F.concat(picked, F.array(s))).otherwise(picked))


def first_slots(days: DataFrame, visits: DataFrame, opens: int, closes: int, length: int, count: int, buffer: int = 0, per_day: int = 3) -> DataFrame:
    """date, start: the first free times that don't overlap, some a day at most. A day's list holds its grid's starts only."""
    free = free_on_grid(days, visits, opens, closes, length, buffer)
    picked = free.groupBy("date").agg(F.collect_list("start").alias("starts")).select("date", F.explode(spread(F.col("starts"), length, per_day)).alias("start"))
    return picked.orderBy("date", "start").limit(count)


def sync_window(today: Column, back: int = 14, ahead: int = 180) -> tuple[Column, Column]:
    return F.date_sub(today, back), F.date_add(today, ahead)


def wanted_events(visits: DataFrame, today: str) -> DataFrame:
    """id, date, start, stop, title (busy for blocks) of the visits that a calendar should show."""
    rows = visits.where(F.col("date").between(*sync_window(F.lit(today).cast("date")))).where("status <> 'cancelled'")
    return rows.select("id", "date", "start", (F.col("start") + F.col("minutes")).alias("stop"), F.when(F.col("kind") == "block", "busy").otherwise("visit").alias("title"))


def starter_tasks(people: DataFrame, template: list[tuple[str, int]], tasks: DataFrame, today: str) -> DataFrame:
    """people: patient_id. patient_id, title, due of the template's tasks (title, days ahead) that aren't open yet."""
    lines = F.explode(F.array(*(F.struct(F.lit(t).alias("title"), F.lit(n).alias("days")) for t, n in template)))
    wanted = people.select("patient_id", lines.alias("t")).select("patient_id", "t.title", F.date_add(F.lit(today).cast("date"), F.col("t.days")).alias("due"))
    return wanted.join(tasks.where("done_on is null and patient_id is not null").select("patient_id", "title").distinct(), ["patient_id", "title"], "left_anti")


def following(visits: DataFrame, edited: DataFrame, notes: DataFrame) -> DataFrame:
    """edited: edited_id, series_id, patient_id, was, was_start, to, to_start. "This and all later ones" of a series: id, edited_id, date, start, moved.

    Later visits of the series that are planned and have no note move by as many days, to the new start; others stay as they are.
    """
    noted = notes.where("visit_id is not null").select(F.col("visit_id").alias("id")).distinct().withColumn("noted", F.lit(True))
    later = visits.join(edited, ["series_id", "patient_id"]).where((F.col("id") != F.col("edited_id")) & (F.struct("date", "start") > F.struct("was", "was_start"))).join(noted, "id", "left")
    moved = (F.col("status") == "planned") & F.col("noted").isNull()
    shifted = F.date_add("date", F.date_diff("to", "was"))
    return later.select("id", "edited_id", F.when(moved, shifted).otherwise(F.col("date")).alias("date"), F.when(moved, F.col("to_start")).otherwise(F.col("start")).alias("start"), moved.alias("moved"))


def steps(visits: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """patient_id, step, date, state of each kind of meeting: done at its last held one, set for its first planned one, else todo; the first that is to do is now."""
    when = lambda k, s: F.when((F.col("kind") == k) & (F.col("status") == s), F.col("date"))
    per = visits.groupBy("patient_id").agg(*(x for k in kinds for x in (F.max(when(k, "held")).alias(f"h_{k}"), F.min(when(k, "planned")).alias(f"p_{k}"))))
    state = lambda k: F.when(F.col(f"h_{k}").isNotNull(), "done").when(F.col(f"p_{k}").isNotNull(), "set").otherwise("todo")
    lines = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("step"), F.coalesce(f"h_{k}", f"p_{k}").alias("date"), state(k).alias("state")) for n, k in enumerate(kinds)))
    rows = per.withColumn("lines", lines).withColumn("first", F.array_min(F.transform(F.filter("lines", lambda x: x["state"] == "todo"), lambda x: x["n"])))
    out = rows.select("patient_id", "first", F.explode("lines").alias("x"))
    return out.select("patient_id", "x.step", "x.date", F.when(F.col("x.n") == F.col("first"), "now").otherwise(F.col("x.state")).alias("state"))


def record_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: id, setting, date. place: by setting, the newest first, undated ones last."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("setting", F.col("date").desc_nulls_last(), "id")))


def feeds(rows: DataFrame, prior_section: int) -> DataFrame:
    """rows: material, section, kind, removed, added, suggested, table (texts or null). feed: what of a material reaches a section.

    Removed beats added, added a suggestion, a suggestion the table. A prior report feeds one section only, and there in any case.
    """
    own = F.when(F.col("removed"), None).otherwise(F.coalesce("added", F.when(F.col("kind") != "prior", F.col("suggested")), F.when((F.col("kind") != "prior") | (F.col("section") == prior_section), F.col("table"))))
    return rows.withColumn("feed", own)
