"""Queries over a practice's records: alerts, reads, insights, validation, schedules, and changes to stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import alerts, insights, ledger, reads, schedule, stored_rows, validation
from quillspark.plans.registry import BALANCE, CHARGED, TODAY, UNCOVERED, query
from quillspark.sources.records import charges, history, notes, patients, payments, reports, table, tasks, visits

DAY = f"DATE '{TODAY}'"
NOW = alerts.Today(TODAY, 600)
SETTINGS = alerts.Settings()

ALERTS = f"""{UNCOVERED}, done AS (SELECT DISTINCT patient_id FROM reports WHERE total > 0 AND approved >= total),
of AS (SELECT patient_id, max(date) FILTER (kind = 'assessment' AND status = 'held') AS assessed, count(*) FILTER (kind = 'assessment' AND status = 'planned' AND date >= {DAY}) AS assess_ahead, count(*) FILTER (kind = 'feedback' AND status = 'held') AS feedbacks,
  max(date) FILTER (date <= {DAY}) AS last_day, count(*) FILTER (status = 'planned' AND date >= {DAY}) AS ahead FROM visits GROUP BY 1),
bal AS (SELECT patient_id, sum(c) - sum(p) AS due FROM (SELECT patient_id, amount AS c, 0 AS p FROM charged UNION ALL SELECT patient_id, 0, amount FROM payments WHERE NOT voided) GROUP BY 1),
soon AS (SELECT * FROM visits WHERE status = 'planned' AND kind = 'feedback' AND date - {DAY} BETWEEN 0 AND 7),
missing AS (SELECT patient_id, count(*) AS n FROM tasks WHERE done_on IS NULL AND kind IN ('questionnaire', 'document') GROUP BY 1),
every_alert AS (
SELECT 'unmarked' AS kind, 0 AS rank, date AS since, patient_id, id AS visit_id, NULL::BIGINT AS task_id, NULL::BIGINT AS n FROM visits WHERE status = 'planned' AND kind <> 'block' AND (date < {DAY} OR (date = {DAY} AND start + minutes <= 600))
UNION ALL SELECT 'no_note', 1, date, patient_id, id, NULL, NULL FROM visits v WHERE status = 'held' AND kind IN ('intake', 'assessment', 'observation', 'feedback', 'therapy', 'guidance') AND {DAY} - date BETWEEN 0 AND 60 AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.visit_id = v.id AND n.patient_id = v.patient_id)
UNION ALL SELECT 'task_overdue', 2, due, p.id, NULL, t.id, NULL FROM tasks t LEFT JOIN patients p ON p.id = t.patient_id WHERE done_on IS NULL AND due < {DAY}
UNION ALL SELECT 'feedback_soon', 3, date, patient_id, id, NULL, NULL FROM soon WHERE patient_id NOT IN (SELECT patient_id FROM done)
UNION ALL SELECT 'materials_missing', 4, date, s.patient_id, id, NULL, n FROM soon s JOIN missing m ON s.patient_id = m.patient_id
UNION ALL SELECT 'report_due', 5, assessed, o.patient_id, NULL, NULL, NULL FROM of o JOIN patients p ON p.id = o.patient_id WHERE p.status = 'active' AND assess_ahead = 0 AND feedbacks = 0 AND {DAY} - assessed > 30 AND o.patient_id NOT IN (SELECT patient_id FROM done)
UNION ALL SELECT 'debt', 6, oldest, patient_id, NULL, NULL, due FROM uncovered WHERE due > 0 AND {DAY} - oldest >= 60
UNION ALL SELECT 'no_next_visit', 7, last_day, o.patient_id, NULL, NULL, NULL FROM of o JOIN patients p ON p.id = o.patient_id LEFT JOIN bal b ON b.patient_id = o.patient_id WHERE p.status = 'active' AND ahead = 0 AND {DAY} - last_day > 14
  AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.patient_id = o.patient_id AND done_on IS NULL) AND (feedbacks = 0 OR coalesce(b.due, 0) > 0)
UNION ALL SELECT 'waiting', 8, coalesce(waiting_since, created_on), id, NULL, NULL, CAST(floor(({DAY} - coalesce(waiting_since, created_on)) / 7) AS BIGINT) FROM patients WHERE status = 'waiting' AND {DAY} - coalesce(waiting_since, created_on) >= 56)"""


def _all(spark, d):
    return patients(spark, d), visits(spark, d), charges(spark, d), payments(spark, d), tasks(spark, d), notes(spark, d), reports(spark, d)


@query(f"{ALERTS} SELECT * FROM every_alert")
def clinic_alerts(spark, d):
    return alerts.clinic_alerts(*_all(spark, d), NOW, SETTINGS)


@query(f"{ALERTS} SELECT * FROM every_alert ORDER BY since, rank, patient_id NULLS FIRST, visit_id NULLS FIRST, task_id NULLS FIRST LIMIT 200")
def alerts_first_page(spark, d):
    return alerts.in_order(alerts.clinic_alerts(*_all(spark, d), NOW, SETTINGS)).limit(200)


@query(f"SELECT 'unreadable' AS kind, {DAY} AS since, NULL::BIGINT AS patient_id, NULL::BIGINT AS visit_id, NULL::BIGINT AS task_id, k AS n FROM (SELECT count(*) FILTER (props NOT LIKE '%7}}') AS k FROM events) WHERE k > 0")
def unreadable_alert(spark, d):
    return alerts.unreadable(table(spark, d, "events").select("props"), ~F.col("props").endswith("7}"), NOW)


VIEWS = """, lap AS (SELECT DISTINCT a.id FROM visits a JOIN visits b ON a.date = b.date AND a.id <> b.id AND a.status <> 'cancelled' AND b.status <> 'cancelled' AND a.start < b.start + b.minutes AND b.start < a.start + a.minutes)"""


@query(f"""{VIEWS} SELECT v.id, patient_id, date, start, kind, v.status, name, v.id IN (SELECT visit_id FROM notes) AS has_note, v.id IN (SELECT id FROM lap) AS overlaps FROM visits v LEFT JOIN patients p ON p.id = v.patient_id""")
def visit_views(spark, d):
    return reads.visit_views(visits(spark, d), patients(spark, d), notes(spark, d))


@query(f"""{VIEWS} SELECT v.id, patient_id, date, start, kind, v.status, name, v.id IN (SELECT visit_id FROM notes) AS has_note, v.id IN (SELECT id FROM lap) AS overlaps FROM visits v LEFT JOIN patients p ON p.id = v.patient_id WHERE date BETWEEN DATE '2000-02-01' AND DATE '2000-05-10'""")
def clinic_calendar(spark, d):
    return reads.visit_views(schedule.in_range(visits(spark, d), "2000-02-01", "2000-05-10"), patients(spark, d), notes(spark, d))


@query(f"SELECT t.id, patient_id, title, due, done_on, name, done_on IS NULL AND coalesce(due < {DAY}, false) AS overdue FROM tasks t LEFT JOIN patients p ON p.id = t.patient_id")
def clinic_tasks(spark, d):
    return reads.task_views(tasks(spark, d), patients(spark, d), NOW)


AGE = f"CAST(CASE WHEN birth_date <= {DAY} THEN (year({DAY}) - year(birth_date)) * 12 + month({DAY}) - month(birth_date) - CASE WHEN day({DAY}) < least(day(birth_date), day(last_day({DAY}))) THEN 1 ELSE 0 END END AS INTEGER)"


@query(f"""{BALANCE}, nxt AS (SELECT patient_id, min((date, start)) FILTER (status = 'planned' AND date >= {DAY}) AS n, max(date) FILTER (status = 'held') AS last_date FROM visits GROUP BY 1), open AS (SELECT patient_id, count(*) AS k FROM tasks WHERE done_on IS NULL GROUP BY 1)
SELECT p.id, name, status, age // 12 AS age_years, age % 12 AS age_months, n[1] AS next_date, n[2] AS next_start, last_date, coalesce(due, 0) AS due, coalesce(k, 0) AS open_tasks FROM (SELECT *, {AGE} AS age FROM patients) p
LEFT JOIN nxt ON nxt.patient_id = p.id LEFT JOIN balance b ON b.patient_id = p.id LEFT JOIN open o ON o.patient_id = p.id""")
def clinic_patients(spark, d):
    return reads.patient_rows(patients(spark, d), visits(spark, d), charges(spark, d), payments(spark, d), tasks(spark, d), NOW)


@query("""SELECT 'visit' AS section, date, id, kind || ' ' || status AS what FROM visits WHERE patient_id = 7 UNION ALL SELECT 'charge', date, id, CAST(amount AS VARCHAR) FROM charges WHERE patient_id = 7 UNION ALL SELECT 'payment', date, id, CAST(amount AS VARCHAR) FROM payments WHERE patient_id = 7
UNION ALL SELECT 'note', date, visit_id, 'note' FROM notes WHERE patient_id = 7 UNION ALL SELECT 'task', due, id, title FROM tasks WHERE patient_id = 7""")
def clinic_card(spark, d):
    return reads.card(patients(spark, d), visits(spark, d), charges(spark, d), payments(spark, d), notes(spark, d), tasks(spark, d), 7, NOW)


@query(f"""{BALANCE}, live AS (SELECT * FROM visits WHERE kind <> 'block' AND status <> 'cancelled')
SELECT * FROM (SELECT count(*) FILTER (date = {DAY}) AS visits_today, min(date) FILTER (status = 'planned' AND date > {DAY}) AS next_day, count(*) FILTER (date_trunc('week', date + 1) = date_trunc('week', {DAY} + 1)) AS week_visits FROM live),
(SELECT count(*) AS open_tasks, count(*) FILTER (due < {DAY}) AS overdue FROM tasks WHERE done_on IS NULL), (SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) AS month_received FROM payments WHERE NOT voided AND date_trunc('month', date) = date_trunc('month', {DAY})),
(SELECT CAST(coalesce(sum(greatest(due, 0)), 0) AS BIGINT) AS total_due FROM balance), (SELECT count(*) FILTER (status = 'waiting') AS waiting, count(*) FILTER (status = 'active') AS active FROM patients)""")
def clinic_overview(spark, d):
    return reads.overview(patients(spark, d), visits(spark, d), charges(spark, d), payments(spark, d), tasks(spark, d), NOW)


@query("SELECT id FROM visits WHERE status <> 'planned' UNION SELECT id FROM visits WHERE id IN (SELECT record_id FROM history WHERE status <> 'planned')")
def marked_visits(spark, d):
    return reads.marked(visits(spark, d), history(spark, d))


@query("SELECT record_id, count(*) AS versions FROM history GROUP BY 1")
def history_counts(spark, d):
    return reads.history_counts(history(spark, d))


@query("SELECT saved_at, status, coalesce(lag(status) OVER (ORDER BY saved_at, status) <> status, true) AS changed FROM history WHERE record_id = 11")
def clinic_history(spark, d):
    return reads.history_lines(history(spark, d), 11)


CASES = "(SELECT c_custkey AS case_id FROM customer)"


def _cases(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"))


@query(f"SELECT case_id, coalesce(approved, 0) AS approved, coalesce(total, 0) AS total, coalesce(total > 0 AND approved >= total, false) AS finished FROM {CASES} LEFT JOIN reports ON patient_id = case_id")
def clinic_cases(spark, d):
    return reads.case_states(_cases(spark, d), reports(spark, d))


@query(f"SELECT case_id FROM {CASES} WHERE case_id NOT IN (SELECT case_id FROM patients WHERE case_id IS NOT NULL)")
def case_choices(spark, d):
    return reads.unlinked_cases(_cases(spark, d), patients(spark, d))


@query("SELECT id, urgent, coalesce(waiting_since, created_on) AS since, name FROM patients WHERE status = 'waiting'")
def waiting_list(spark, d):
    return reads.waiting_list(patients(spark, d))


# ---------------------------------------------------------------- insights
FROM, TO = "2000-01", "2000-12"
STRETCH = "DATE '2000-01-01' AND DATE '2000-12-31'"


@query("SELECT id, patient_id, date, start, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY date, start, id) AS INTEGER) AS nth FROM visits WHERE status = 'held' AND kind <> 'block' AND patient_id IS NOT NULL")
def held_by_patient(spark, d):
    return insights.held_in_order(visits(spark, d))


@query(f"""SELECT kind, n FROM (SELECT kind, count(*) AS n FROM visits WHERE status = 'held' AND kind <> 'block' AND date BETWEEN {STRETCH} GROUP BY 1)""")
def insights_by_kind(spark, d):
    return insights.by_kind(visits(spark, d), FROM, TO)


@query(f"""SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT kind, count(*) AS n FROM visits WHERE status = 'held' AND kind <> 'block' AND date BETWEEN {STRETCH} AND patient_id % 10 <> 0 GROUP BY 1
UNION ALL SELECT kind, count(*) FROM visits WHERE status = 'held' AND date BETWEEN {STRETCH} AND patient_id % 10 = 0 GROUP BY 1, strftime(date, '%Y-%m')) GROUP BY 1""")
def by_kind_with_erased(spark, d):
    v = visits(spark, d)
    tally = insights.fold_visits(v.where("patient_id % 10 = 0"))
    return insights.by_kind(v.where("patient_id % 10 <> 0"), FROM, TO, tally)


@query(f"SELECT count(*) AS opened FROM patients WHERE created_on BETWEEN {STRETCH}")
def patients_opened(spark, d):
    p = patients(spark, d)
    return insights.opened(p.where("id % 10 <> 0"), insights.fold_cards(p.where("id % 10 = 0")), FROM, TO)


@query(f"""SELECT count(*) AS n, CAST(floor(median(days)) AS BIGINT) AS median_days FROM (SELECT first - waiting_since AS days FROM patients p JOIN (SELECT patient_id, min(date) AS first FROM visits WHERE status = 'held' AND kind <> 'block' GROUP BY 1) f ON f.patient_id = p.id WHERE waiting_since IS NOT NULL AND first BETWEEN {STRETCH} AND first >= waiting_since)""")
def insights_waited(spark, d):
    return insights.waited(patients(spark, d), visits(spark, d), FROM, TO)


@query(f"SELECT count(*) AS waiting, CAST(floor(median({DAY} - coalesce(waiting_since, created_on)) FILTER ({DAY} >= coalesce(waiting_since, created_on))) AS BIGINT) AS median_days FROM patients WHERE status = 'waiting'")
def insights_waiting_now(spark, d):
    return insights.waiting_now(patients(spark, d), TODAY)


@query(f"""SELECT CAST(floor(median(f.date - coalesce(intake, first))) AS BIGINT) AS from_intake, CAST(floor(median(f.date - assessed)) AS BIGINT) AS from_assessment, count(*) AS feedbacks FROM (
SELECT f.patient_id, f.date, min(v.date) FILTER (v.kind = 'intake') AS intake, min(v.date) AS first, max(v.date) FILTER (v.kind = 'assessment' AND (v.date, v.start) < (f.date, f.start)) AS assessed
FROM (SELECT patient_id, max((date, start))[1] AS date, max((date, start))[2] AS start FROM visits WHERE kind = 'feedback' AND status = 'held' AND date BETWEEN {STRETCH} GROUP BY 1) f JOIN visits v ON v.patient_id = f.patient_id AND v.status = 'held' AND v.kind <> 'block' AND (v.date, v.start) <= (f.date, f.start) GROUP BY 1, 2) f""")
def insights_to_feedback(spark, d):
    return insights.to_feedback(visits(spark, d), FROM, TO)


@query(f"SELECT count(*) * 480 AS work_minutes FROM (SELECT unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2000-12-31', INTERVAL 1 DAY)) AS day) WHERE dayofweek(day) <= 4 AND CAST(day AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_orderkey % 97 = 5)")
def work_minutes(spark, d):
    closed = table(spark, d, "lineitem").where("l_orderkey % 97 = 5").select(F.to_date("l_shipdate").alias("date"))
    return insights.work_minutes(spark, FROM, TO, TODAY, (1, 2, 3, 4, 5), 480, closed)


@query(f"""{CHARGED}, rows AS (SELECT date, 1 AS h, 0 AS x, 0 AS s, charge AS c, 0 AS r FROM vc WHERE status = 'held' UNION ALL SELECT date, 0, CAST(status = 'cancelled' AS INTEGER), CAST(status = 'no_show' AS INTEGER), charge, 0 FROM vc WHERE status <> 'held' UNION ALL SELECT date, 0, 0, 0, amount, 0 FROM charges WHERE NOT voided UNION ALL SELECT date, 0, 0, 0, 0, amount FROM payments WHERE NOT voided)
SELECT strftime(m, '%Y-%m') AS month, CAST(coalesce(sum(h), 0) AS BIGINT) AS held, CAST(coalesce(sum(x), 0) AS BIGINT) AS cancelled, CAST(coalesce(sum(s), 0) AS BIGINT) AS no_show, CAST(coalesce(sum(c), 0) AS BIGINT) AS charged, CAST(coalesce(sum(r), 0) AS BIGINT) AS received
FROM (SELECT unnest(generate_series(TIMESTAMP '1999-05-01', TIMESTAMP '2000-10-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN rows ON date_trunc('month', date) = m GROUP BY 1""")
def income_months(spark, d):
    return insights.income_months(visits(spark, d), charges(spark, d), payments(spark, d), "1999-05", "2000-10")


@query(f"""{CHARGED} SELECT strftime(date, '%Y-%m') AS month, CAST(sum(h) AS BIGINT) AS held, CAST(sum(c) AS BIGINT) AS charged, CAST(sum(r) AS BIGINT) AS received FROM (SELECT date, CAST(status = 'held' AS INTEGER) AS h, charge AS c, 0 AS r FROM vc UNION ALL SELECT date, 0, amount, 0 FROM charges WHERE NOT voided UNION ALL SELECT date, 0, 0, amount FROM payments WHERE NOT voided) WHERE date IS NOT NULL GROUP BY 1""")
def income_with_erased(spark, d):
    gone = lambda x: x.where("patient_id % 10 = 0")
    live = lambda x: x.where("patient_id % 10 <> 0")
    v, c, p = visits(spark, d), charges(spark, d), payments(spark, d)
    return ledger.with_rollup(insights.month_money(live(v), live(c), live(p)), insights.month_money(gone(v), gone(c), gone(p)), ["month"], ["held", "charged", "received"])


@query("SELECT date, line, id, patient_id, amount, CAST(row_number() OVER (PARTITION BY date ORDER BY line, start, id) AS INTEGER) AS place FROM (SELECT date, 0 AS line, start, id, patient_id, CASE WHEN status = 'held' OR (status IN ('cancelled', 'no_show') AND charge_missed) THEN greatest(coalesce(fee, 0), 0) ELSE 0 END AS amount FROM visits WHERE status <> 'planned' UNION ALL SELECT date, 1, 0, id, patient_id, amount FROM charges UNION ALL SELECT date, 2, 0, id, patient_id, amount FROM payments) WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31'")
def diary_lines(spark, d):
    return insights.diary_lines(visits(spark, d), charges(spark, d), payments(spark, d), "1999-03")


# ---------------------------------------------------------------- validation
@query(f"""SELECT id, reason FROM (SELECT id, CASE WHEN kind = 'block' AND patient_id IS NOT NULL THEN 'block_with_patient' WHEN kind = 'block' AND fee <> 0 THEN 'block_with_fee' WHEN kind <> 'block' AND patient_id IS NULL THEN 'no_patient' WHEN date IS NULL THEN 'bad_date'
WHEN minutes NOT BETWEEN 5 AND 720 THEN 'bad_length' WHEN start + minutes > 1440 THEN 'past_midnight' WHEN fee NOT BETWEEN 0 AND 10000000 THEN 'bad_fee' WHEN length(title) > 200 THEN 'title_too_long' END AS reason
FROM (SELECT id, CASE WHEN id % 50 = 1 THEN 'block' ELSE kind END AS kind, CASE WHEN id % 41 <> 2 THEN patient_id END AS patient_id, CASE WHEN id % 43 <> 3 THEN date END AS date, start + CAST(id % 90 AS INTEGER) AS start, CASE WHEN id % 47 = 4 THEN 3 ELSE minutes END AS minutes, fee, repeat('x', CAST(id % 210 AS INTEGER)) AS title FROM visits)) WHERE reason IS NOT NULL""")
def invalid_visits(spark, d):
    k = F.col("id")
    rows = visits(spark, d).select(
        "id", F.when(k % 50 == 1, "block").otherwise(F.col("kind")).alias("kind"), F.when(k % 41 != 2, F.col("patient_id")).alias("patient_id"), F.when(k % 43 != 3, F.col("date")).alias("date"),
        (F.col("start") + (k % 90).cast("int")).alias("start"), F.when(k % 47 == 4, 3).otherwise(F.col("minutes")).alias("minutes"), "fee", F.repeat(F.lit("x"), (k % 210).cast("int")).alias("title"),
    )
    return validation.quarantine(rows, validation.visit_reason()).select("id", "reason")


@query("""SELECT id, reason FROM (SELECT id, CASE WHEN patient_id IS NULL THEN 'no_patient' WHEN date IS NULL THEN 'bad_date' WHEN amount NOT BETWEEN 1 AND 10000000 THEN 'bad_amount' WHEN voided AND trim(void_reason) = '' THEN 'void_without_reason' END AS reason
FROM (SELECT *, CASE WHEN id % 3 = 0 THEN ' ' ELSE 'mistake' END AS void_reason FROM payments)) WHERE reason IS NOT NULL""")
def invalid_payments(spark, d):
    rows = payments(spark, d).withColumn("void_reason", F.when(F.col("id") % 3 == 0, " ").otherwise("mistake"))
    return validation.quarantine(rows, validation.money_reason()).select("id", "reason")


@query(f"""SELECT id, reason FROM (SELECT id, CASE WHEN trim(name) = '' THEN 'no_name' WHEN length(trim(name)) > 120 THEN 'name_too_long' WHEN birth_date > {DAY} OR birth_date < DATE '1900-01-01' THEN 'bad_birth_date' WHEN created_on IS NULL THEN 'bad_date' END AS reason
FROM (SELECT id, CASE WHEN id % 17 = 0 THEN '  ' WHEN id % 19 = 0 THEN repeat(name, 8) ELSE name END AS name, birth_date + CAST(id % 7 AS INTEGER) * 1500 AS birth_date, created_on FROM patients)) WHERE reason IS NOT NULL""")
def invalid_patients(spark, d):
    k = F.col("id")
    rows = patients(spark, d).select("id", F.when(k % 17 == 0, "  ").when(k % 19 == 0, F.repeat("name", F.lit(8))).otherwise(F.col("name")).alias("name"), F.date_add("birth_date", (k % 7).cast("int") * 1500).alias("birth_date"), "created_on")
    return validation.quarantine(rows, validation.patient_reason(TODAY)).select("id", "reason")


@query("""SELECT id, reason FROM (SELECT id, CASE WHEN trim(title) = '' THEN 'no_title' WHEN length(trim(title)) > 200 THEN 'title_too_long' WHEN kind NOT IN ('questionnaire', 'document', 'call', 'report') THEN 'unknown_kind' END AS reason FROM tasks) WHERE reason IS NOT NULL""")
def invalid_tasks(spark, d):
    return validation.quarantine(tasks(spark, d), validation.task_reason(("questionnaire", "document", "call", "report"))).select("id", "reason")


@query(r"""SELECT id, trim(regexp_replace(name, '[ \t\n\r]+', ' ', 'g')) AS name, CASE WHEN trim(case_id) <> '' THEN trim(case_id) END AS case_id FROM (SELECT id, ' ' || replace(name, '#', '   ') || chr(10) AS name, CASE WHEN id % 3 = 0 THEN ' ' ELSE ' c' || id END AS case_id FROM patients)""")
def normalized_patients(spark, d):
    k = F.col("id")
    rows = patients(spark, d).select("id", F.concat(F.lit(" "), F.replace("name", F.lit("#"), F.lit("   ")), F.lit("\n")).alias("name"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" c"), k.cast("string"))).alias("case_id"))
    return validation.normalized(rows, one_line=("name",), optional=("case_id",))


@query("SELECT f, t, CASE WHEN f IS NULL OR t IS NULL THEN 'bad_date' WHEN t < f THEN 'reversed' WHEN t - f >= 100 THEN 'too_long' ELSE 'ok' END AS state FROM (SELECT DISTINCT waiting_since AS f, created_on AS t FROM patients)")
def valid_ranges(spark, d):
    rows = patients(spark, d).select(F.col("waiting_since").alias("f"), F.col("created_on").alias("t")).distinct()
    return rows.withColumn("state", validation.range_state(F.col("f"), F.col("t")))


@query(f"""{BALANCE} SELECT v.id, CASE WHEN v.id IN (SELECT visit_id FROM notes) THEN 'has_note' WHEN coalesce(b.charged, 0) - v.charge < coalesce(b.paid, 0) THEN 'paid' ELSE 'ok' END AS state FROM vc v LEFT JOIN balance b ON b.patient_id = v.patient_id WHERE v.status <> 'planned'""")
def unmark_states(spark, d):
    v = visits(spark, d)
    return validation.unmark_states(v, notes(spark, d), ledger.balances(v, charges(spark, d), payments(spark, d)))


@query("SELECT id FROM visits WHERE status = 'planned' AND id NOT IN (SELECT record_id FROM history WHERE status <> 'planned')")
def deletable_visits(spark, d):
    return validation.deletable(visits(spark, d), history(spark, d))


@query(f""", s AS (SELECT id, created_on AS d, birth_date, 0 AS used FROM patients UNION ALL SELECT patient_id, date, NULL, CAST(status <> 'planned' AS INTEGER) FROM visits UNION ALL SELECT patient_id, date, NULL, 1 FROM charges UNION ALL SELECT patient_id, date, NULL, 1 FROM payments UNION ALL SELECT patient_id, date, NULL, 1 FROM notes),
g AS (SELECT id, max(d) AS last, max(birth_date) AS birth, max(used) AS used FROM s GROUP BY 1) SELECT id, CASE WHEN used = 0 THEN {DAY} ELSE until END AS until, used = 0 OR until <= {DAY} AS may FROM (SELECT id, used, CAST(greatest(last + INTERVAL 1 YEAR, coalesce(birth + INTERVAL 18 YEAR, DATE '1900-01-01')) AS DATE) AS until FROM g)""")
def can_erase(spark, d):
    return validation.erasable(patients(spark, d), visits(spark, d), charges(spark, d), payments(spark, d), notes(spark, d), TODAY, 1, 18)


# ---------------------------------------------------------------- schedules
@query("SELECT DISTINCT date, CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS sunday, CAST(date - CAST(dayofweek(date) AS INTEGER) + 6 AS DATE) AS saturday FROM visits")
def week_bounds(spark, d):
    return visits(spark, d).select("date").distinct().select("date", *(c.alias(n) for n, c in schedule.week_of(F.col("date")).items()))


@query(""", days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1999-05-01', TIMESTAMP '1999-05-31', INTERVAL 1 DAY)) AS DATE) AS date), grid AS (SELECT date, CAST(s AS INTEGER) AS start FROM days, (SELECT unnest(range(480, 1051, 15)) AS s) WHERE dayofweek(date) <= 4),
free AS (SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.status <> 'cancelled' AND v.date = g.date AND g.start < v.start + v.minutes + 10 AND greatest(v.start - 10, 0) < g.start + 45)) SELECT * FROM free WHERE start + 45 <= 1080""")
def free_starts_15(spark, d):
    return schedule.free_on_grid(schedule.working_days(spark, "1999-05-01", "1999-05-31", (1, 2, 3, 4, 5)), visits(spark, d), 480, 1080, 45, buffer=10)


@query(""", days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1999-05-01', TIMESTAMP '1999-06-30', INTERVAL 1 DAY)) AS DATE) AS date), grid AS (SELECT date, CAST(s AS INTEGER) AS start FROM days, (SELECT unnest(range(480, 1036, 15)) AS s) WHERE dayofweek(date) <= 4),
free AS (SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.status <> 'cancelled' AND v.date = g.date AND g.start < v.start + v.minutes AND v.start < g.start + 45)), l AS (SELECT date, list(start ORDER BY start) AS s FROM free GROUP BY 1),
p AS (SELECT date, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN len(a) < 3 AND x[1] >= a[len(a)] + 45 THEN list_concat(a, x) ELSE a END) AS picked FROM l)
SELECT date, start FROM (SELECT date, unnest(picked) AS start FROM p) ORDER BY date, start LIMIT 12""")
def free_slots_spread(spark, d):
    return schedule.first_slots(schedule.working_days(spark, "1999-05-01", "1999-06-30", (1, 2, 3, 4, 5)), visits(spark, d), 480, 1080, 45, 12)


@query(f"SELECT id, date, start, start + minutes AS stop, CASE WHEN kind = 'block' THEN 'busy' ELSE 'visit' END AS title FROM visits WHERE status <> 'cancelled' AND date BETWEEN {DAY} - 14 AND {DAY} + 180")
def wanted_events(spark, d):
    return schedule.wanted_events(visits(spark, d), TODAY)


@query("""SELECT p.id AS patient_id, t.title, DATE '2001-06-15' + t.days AS due FROM patients p, (VALUES ('view 3', 7), ('consent form', 0), ('call school', 14)) t(title, days) WHERE p.status = 'active' AND NOT EXISTS (SELECT 1 FROM tasks k WHERE k.patient_id = p.id AND k.done_on IS NULL AND k.title = t.title)""")
def starter_tasks(spark, d):
    template = [("view 3", 7), ("consent form", 0), ("call school", 14)]
    return schedule.starter_tasks(patients(spark, d).where("status = 'active'").select(F.col("id").alias("patient_id")), template, tasks(spark, d), TODAY)


@query("""SELECT v.id, CAST(v.date + 3 AS DATE) AS date, 540 AS start FROM visits v JOIN visits e ON e.id % 500 = 1 AND v.patient_id = e.patient_id AND v.kind = e.kind AND v.id <> e.id AND (v.date, v.start) > (e.date, e.start) WHERE v.status = 'planned' AND v.id NOT IN (SELECT visit_id FROM notes)""")
def apply_following(spark, d):
    v = visits(spark, d).withColumn("series_id", F.concat_ws("-", "patient_id", "kind"))
    edited = v.where("id % 500 = 1").select(F.col("id").alias("edited_id"), F.col("series_id"), "patient_id", F.col("date").alias("was"), F.col("start").alias("was_start"), F.date_add("date", 3).alias("to"), F.lit(540).alias("to_start"))
    return schedule.following(v, edited, notes(spark, d)).where("moved").select("id", "date", "start")


@query(f"""SELECT patient_id, step, date, CASE WHEN s = 'todo' AND n = min(n) FILTER (s = 'todo') OVER (PARTITION BY patient_id) THEN 'now' ELSE s END AS state FROM (SELECT patient_id, unnest([{{'step': 'intake', 'n': 0, 'h': max(date) FILTER (kind = 'intake' AND status = 'held'), 'p': min(date) FILTER (kind = 'intake' AND status = 'planned')}}, {{'step': 'assessment', 'n': 1, 'h': max(date) FILTER (kind = 'assessment' AND status = 'held'), 'p': min(date) FILTER (kind = 'assessment' AND status = 'planned')}},
{{'step': 'feedback', 'n': 2, 'h': max(date) FILTER (kind = 'feedback' AND status = 'held'), 'p': min(date) FILTER (kind = 'feedback' AND status = 'planned')}}], recursive := true) FROM visits GROUP BY patient_id), LATERAL (SELECT coalesce(h, p) AS date, CASE WHEN h IS NOT NULL THEN 'done' WHEN p IS NOT NULL THEN 'set' ELSE 'todo' END AS s)""")
def process_steps(spark, d):
    return schedule.steps(visits(spark, d), ("intake", "assessment", "feedback"))


# ---------------------------------------------------------------- stored rows
@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return stored_rows.without(table(spark, d, "orders"), gone, ["o_custkey"]).select(F.col("o_orderkey").alias("id"))


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN {DAY} END AS trashed_on FROM patients")
def trash_and_restore(spark, d):
    keys = lambda n: patients(spark, d).where(f"id % 10 in {n}").select("id")
    trashed = stored_rows.trashed(patients(spark, d).select("id"), keys("(0, 3, 5)"), TODAY)
    return stored_rows.restored(trashed, keys("(3, 4)"))


@query("SELECT id FROM patients WHERE status = 'finished' AND created_on < DATE '1999-01-01'")
def trashed_before(spark, d):
    rows = patients(spark, d).select("id", F.when(F.col("status") == "finished", F.col("created_on")).alias("trashed_on"))
    return stored_rows.trashed_before(rows, "1999-01-01").select("id")


@query("SELECT id, CASE WHEN status = 'planned' AND kind = 'therapy' AND patient_id % 4 = 1 THEN 'superseded' ELSE status END AS status FROM visits")
def supersede_proposals(spark, d):
    asked = patients(spark, d).where("id % 4 = 1").select(F.col("id").alias("patient_id"), F.lit("therapy").alias("kind"))
    return stored_rows.transition(visits(spark, d), asked, ["patient_id", "kind"], "planned", "superseded").select("id", "status")


@query("""WITH old AS (SELECT o_custkey AS k, o_orderkey AS tag, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS tag, upper(o_orderpriority) AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(o.tag, n.tag) AS tag, n.v, CASE WHEN o.tag IS NULL THEN 'insert' WHEN n.tag IS NULL THEN 'delete' WHEN o.v <> n.v THEN 'update' ELSE 'keep' END AS action FROM old o FULL JOIN new n ON o.tag = n.tag""")
def set_identities(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("tag"), F.col("o_orderpriority").alias("v"))
    return stored_rows.merged(o.where("tag % 3 <> 0"), o.where("tag % 5 <> 0").withColumn("v", F.upper("v")), ["tag"], ["v"])


@query("SELECT record_id, saved_at, status FROM history UNION ALL SELECT record_id, max(saved_at) + 1, 'held' FROM history WHERE record_id % 4 = 0 GROUP BY 1")
def put_with_history(spark, d):
    h = history(spark, d)
    return stored_rows.appended(h, h.where("record_id % 4 = 0").select("record_id", F.lit("held").alias("status")).distinct(), "record_id", "saved_at")


@query(""", live AS (SELECT 'live' AS part, CAST(patient_id AS VARCHAR) AS key, count(*) AS n FROM visits WHERE patient_id % 10 <> 0 GROUP BY ALL), erased AS (SELECT 'tally', strftime(date, '%Y-%m') || ' ' || kind, count(*) FROM visits WHERE patient_id % 10 = 0 AND status = 'held' GROUP BY ALL) SELECT * FROM live UNION ALL SELECT * FROM erased""")
def erase_patients(spark, d):
    kept, tally = stored_rows.erased(visits(spark, d), patients(spark, d).where("id % 10 = 0").select(F.col("id").alias("patient_id")))
    live = kept.groupBy(F.lit("live").alias("part"), F.col("patient_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return live.unionByName(tally.select(F.lit("tally").alias("part"), F.concat_ws(" ", "month", "kind").alias("key"), "n"))


@query("SELECT coalesce(max(l_linenumber), 0) + 1 AS version, l_orderkey AS key FROM lineitem GROUP BY l_orderkey")
def next_versions(spark, d):
    return stored_rows.next_version(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "key")


@query("SELECT l_orderkey AS k, l_linenumber AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 1 THEN 3.5 ELSE l_linenumber END, l_partkey, l_suppkey) AS INTEGER) AS position FROM lineitem")
def place_draft(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").cast("double").alias("position"), "l_partkey", "l_suppkey")
    return stored_rows.placed(rows, ["k"], F.col("id") == 1, F.lit(3.0), ["l_partkey", "l_suppkey"]).select("k", "id", "position")


TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey < 10 THEN NULL ELSE p_partkey // 10 END AS parent FROM part"


@query(f"""WITH RECURSIVE n AS ({TREE}), up AS (SELECT id, parent FROM n WHERE id % 7 <> 3 UNION ALL SELECT up.id, n.parent FROM up JOIN n ON n.id = up.parent WHERE up.parent % 7 = 3) SELECT id, parent FROM up WHERE parent IS NULL OR parent % 7 <> 3""")
def delete_folder(spark, d):
    return stored_rows.without_folders(_tree(spark, d), _tree(spark, d).where("id % 7 = 3").select("id"))


def _tree(spark, d):
    parent = F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10).cast("long"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent"))


@query(f"""WITH RECURSIVE n AS ({TREE}), up AS (SELECT id, id AS at, parent FROM n UNION ALL SELECT up.id, n.id, n.parent FROM up JOIN n ON up.parent = n.id)
SELECT m.id, m.target, EXISTS (SELECT 1 FROM up WHERE up.id = m.target AND up.at = m.id) AS cycle FROM (SELECT p_partkey AS id, p_size AS target FROM part WHERE p_size IN (SELECT p_partkey FROM part)) m""")
def move_folder(spark, d):
    moves = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("target"))
    moves = moves.join(_tree(spark, d).select(F.col("id").alias("target")), "target", "left_semi")
    return stored_rows.cycles(_tree(spark, d), moves).select("id", "target", "cycle")


@query("SELECT DISTINCT conv_id FROM (SELECT conv_id FROM conversations WHERE role = 'user' AND turn > 2 UNION SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn > 4)")
def drafts_with_versions(spark, d):
    c = table(spark, d, "conversations")
    return stored_rows.either(c.where("role = 'user' and turn > 2").select("conv_id"), c.where("role = 'assistant' and turn > 4").select("conv_id"))
