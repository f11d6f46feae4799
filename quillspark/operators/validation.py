"""Records before they are saved: normal forms, and the first reason against a row. Bad rows are set apart, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.text import clean_line

#: Longest names, short and long texts in characters, and the largest amount in minor units.
NAME_MAX, SHORT_MAX, LONG_MAX, AMOUNT_MAX = 120, 200, 4_000, 10_000_000
#: Shortest and longest visit, and a day, in minutes; longest range in days, both ends counted.
MINUTES, DAY_MINUTES, RANGE_DAYS = (5, 720), 1_440, 100
BIRTH_FIRST = "1900-01-01"


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds; null where none does. A rule over nulls doesn't hold."""
    out = F.lit(None).cast("string")
    for bad, reason in reversed(rules):
        out = F.when(bad, reason).otherwise(out)
    return out


def blank(text: str) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def normalized(rows: DataFrame, one_line: tuple[str, ...] = (), trimmed: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """Texts on one line with single blanks, free texts without outer blanks, empty optional texts null."""
    out = {c: clean_line(c) for c in one_line} | {c: F.trim(c) for c in trimmed} | {c: F.when(~blank(c), F.trim(c)) for c in optional}
    return rows.withColumns(out)


def visit_reason() -> Column:
    """visits: kind, patient_id, date, start, minutes, fee, title."""
    block, nobody = F.col("kind") == "block", F.col("patient_id").isNull()
    return first_reason(
        (block & ~nobody, "block_with_patient"), (block & (F.col("fee") != 0), "block_with_fee"), (~block & nobody, "no_patient"), (F.col("date").isNull(), "bad_date"), (~F.col("minutes").between(*MINUTES), "bad_length"),
        (F.col("start") + F.col("minutes") > DAY_MINUTES, "past_midnight"), (~F.col("fee").between(0, AMOUNT_MAX), "bad_fee"), (F.length("title") > SHORT_MAX, "title_too_long"),
    )


def money_reason() -> Column:
    """payments and charges: patient_id, date, amount, voided, void_reason."""
    return first_reason((F.col("patient_id").isNull(), "no_patient"), (F.col("date").isNull(), "bad_date"), (~F.coalesce(F.col("amount").between(1, AMOUNT_MAX), F.lit(False)), "bad_amount"), (F.col("voided") & blank("void_reason"), "void_without_reason"))


def patient_reason(today: str) -> Column:
    """patients: name, birth_date, created_on."""
    birth = F.col("birth_date")
    return first_reason(
        (blank("name"), "no_name"), (F.length(F.trim("name")) > NAME_MAX, "name_too_long"), ((birth > F.lit(today).cast("date")) | (birth < F.lit(BIRTH_FIRST).cast("date")), "bad_birth_date"), (F.col("created_on").isNull(), "bad_date")
    )


def task_reason(kinds: tuple[str, ...]) -> Column:
    return first_reason((blank("title"), "no_title"), (F.length(F.trim("title")) > SHORT_MAX, "title_too_long"), (~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown_kind"))


def contact_reason(roles: tuple[str, ...]) -> Column:
    """contacts: role, name, phone, email."""
    return first_reason((~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "unknown_role"), (blank("name") & blank("phone") & blank("email"), "empty_contact"), (F.length(F.trim("name")) > NAME_MAX, "name_too_long"))


def note_reason() -> Column:
    """notes: patient_id, date, record, personal."""
    return first_reason((F.col("patient_id").isNull(), "no_patient"), (F.col("date").isNull(), "bad_date"), (blank("record") & blank("personal"), "empty_note"), (F.greatest(F.length("record"), F.length("personal")) > 20_000, "note_too_long"))


def quarantine(rows: DataFrame, reason: Column) -> DataFrame:
    """The rows that are refused, with their reason; `accepted` gives the others."""
    return rows.withColumn("reason", reason).where("reason is not null")


def accepted(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.where(reason.isNull())


def range_state(first: Column, last: Column) -> Column:
    return F.coalesce(first_reason((first.isNull() | last.isNull(), "bad_date"), (last < first, "reversed"), (F.date_diff(last, first) >= RANGE_DAYS, "too_long")), F.lit("ok"))


def unmark_states(visits: DataFrame, notes: DataFrame, balances: DataFrame) -> DataFrame:
    """id, state of marked visits: has_note, paid (without its charge more would be paid than charged), or ok to go back to planned."""
    from quillspark.operators.ledger import visit_charge

    noted = notes.where("visit_id is not null").select(F.col("visit_id").alias("id")).distinct().withColumn("noted", F.lit(True))
    rows = visits.where("status <> 'planned'").select("id", "patient_id", visit_charge().alias("charge")).join(noted, "id", "left").join(balances.select("patient_id", "charged", "paid"), "patient_id", "left")
    zero = F.lit(0)
    state = first_reason((F.col("noted"), "has_note"), (F.coalesce("charged", zero) - F.col("charge") < F.coalesce("paid", zero), "paid"))
    return rows.select("id", F.coalesce(state, F.lit("ok")).alias("state"))


def deletable(visits: DataFrame, history: DataFrame) -> DataFrame:
    """id of visits that were never marked, by themselves or in a saved version."""
    once = history.where("status <> 'planned'").select(F.col("record_id").alias("id")).distinct()
    return visits.where("status = 'planned'").select("id").join(once, "id", "left_anti")


def erasable(patients: DataFrame, visits: DataFrame, charges: DataFrame, payments: DataFrame, notes: DataFrame, today: str, keep_years: int, keep_until_age: int) -> DataFrame:
    """id, until, may: a card without any activity may go at once; others some years after the last one, and not before an age.

    One union and one aggregate by patient: no record is joined to another.
    """
    line = lambda x, used: x.select(F.col("patient_id").alias("id"), F.col("date").alias("last"), F.lit(None).cast("date").alias("birth"), used.cast("int").alias("used"))
    rows = patients.select("id", F.col("created_on").alias("last"), F.col("birth_date").alias("birth"), F.lit(0).alias("used")).unionByName(line(visits, F.col("status") != "planned"))
    for x in (charges, payments, notes):
        rows = rows.unionByName(line(x, F.lit(1)))
    per = rows.where("id is not null").groupBy("id").agg(F.max("last").alias("last"), F.max("birth").alias("birth"), F.max("used").alias("used"))
    day = F.lit(today).cast("date")
    until = F.greatest(F.add_months("last", 12 * keep_years), F.coalesce(F.add_months("birth", 12 * keep_until_age), F.lit(BIRTH_FIRST).cast("date")))
    return per.select("id", F.when(F.col("used") == 0, day).otherwise(until).alias("until"), ((F.col("used") == 0) | (until <= day)).alias("may"))


def international_phone(raw: Column, country: str = "1", national: int = 10) -> Column:
    """Digits alone with the country's code; null for what is no such number."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    whole = (F.length(digits) == national + len(country)) & digits.startswith(country)
    return F.when(F.length(digits) == national, F.concat(F.lit(f"+{country}"), digits)).when(whole, F.concat(F.lit("+"), digits))


def plain_email(raw: Column) -> Column:
    """One address in lower case without outer blanks; null for anything else."""
    address = F.lower(F.trim(raw))
    return F.when(address.rlike(r"^[a-z0-9._%+\-]+@[a-z0-9\-]+(\.[a-z0-9\-]+)+$"), address)
