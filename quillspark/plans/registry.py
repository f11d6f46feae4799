"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import checks, ledger, records, schedule, scores, style, text
from quillspark.sources import csv
from quillspark.sources import records as source
from quillspark.sources.records import charges, payments, table, visits
from quillspark.streaming import folds

TODAY = "2001-06-15"
FLAGSHIP = "debt_ageing"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {source.SQL}{sql}" if sql.lstrip().startswith((",", "SELECT")) else sql
        return f

    return put


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return visits(spark, d), charges(spark, d), payments(spark, d)


CHARGED = """, vc AS (SELECT *, CASE WHEN status = 'held' OR (status IN ('cancelled', 'no_show') AND charge_missed) THEN greatest(coalesce(fee, 0), 0) ELSE 0 END AS charge FROM visits),
charged AS (SELECT patient_id, date, charge AS amount FROM vc WHERE charge > 0 UNION ALL SELECT patient_id, date, amount FROM charges WHERE NOT voided)"""
BALANCE = f"""{CHARGED}, balance AS (SELECT patient_id, CAST(sum(c) AS BIGINT) AS charged, CAST(sum(p) AS BIGINT) AS paid, CAST(sum(c) - sum(p) AS BIGINT) AS due
  FROM (SELECT patient_id, amount AS c, 0 AS p FROM charged UNION ALL SELECT patient_id, 0, amount FROM payments WHERE NOT voided) GROUP BY patient_id)"""
UNCOVERED = f"""{CHARGED}, days AS (SELECT patient_id, date, sum(amount) AS amount FROM charged GROUP BY ALL),
paid AS (SELECT patient_id, sum(amount) AS paid FROM payments WHERE NOT voided GROUP BY patient_id),
run AS (SELECT d.patient_id, date, sum(amount) OVER (PARTITION BY d.patient_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS c, coalesce(paid, 0) AS paid FROM days d LEFT JOIN paid ON d.patient_id = paid.patient_id),
uncovered AS (SELECT patient_id, CAST(max(c) - min(paid) AS BIGINT) AS due, min(date) AS oldest FROM run WHERE c > paid GROUP BY patient_id)"""


@query(f"{BALANCE} SELECT * FROM balance")
def patient_balance(spark, d):
    return ledger.balances(*_three(spark, d))


@query(f"{BALANCE} SELECT CAST(coalesce(sum(greatest(due, 0)), 0) AS BIGINT) AS total_due, count(*) FILTER (due > 0) AS in_debt FROM balance")
def total_due(spark, d):
    return ledger.total_due(ledger.balances(*_three(spark, d)))


@query(f"{UNCOVERED} SELECT * FROM uncovered")
def oldest_uncovered(spark, d):
    return ledger.oldest_uncovered(*_three(spark, d))


@query(f"""{UNCOVERED} SELECT CAST(s.f AS INTEGER) AS from_day, count(patient_id) AS n, CAST(coalesce(sum(due), 0) AS BIGINT) AS amount FROM (SELECT unnest([0, 31, 61, 91]) AS f) s
LEFT JOIN (SELECT *, CASE WHEN DATE '{TODAY}' - oldest >= 91 THEN 91 WHEN DATE '{TODAY}' - oldest >= 61 THEN 61 WHEN DATE '{TODAY}' - oldest >= 31 THEN 31 ELSE 0 END AS f FROM uncovered) u ON s.f = u.f GROUP BY s.f""")
def debt_ageing(spark, d):
    return ledger.debt_ageing(ledger.oldest_uncovered(*_three(spark, d)), TODAY)


@query(" SELECT strftime(date, '%Y-%m') AS month, CAST(sum(amount) AS BIGINT) AS received, count(*) AS n FROM payments WHERE NOT voided GROUP BY 1")
def month_received(spark, d):
    return ledger.month_received(payments(spark, d))


@query(f"""{CHARGED}, rows AS (SELECT date, CAST(status = 'held' AS INTEGER) AS h, CAST(status = 'cancelled' AS INTEGER) AS x, charge AS c, 0 AS r FROM vc UNION ALL SELECT date, 0, 0, amount, 0 FROM charges WHERE NOT voided UNION ALL SELECT date, 0, 0, 0, amount FROM payments WHERE NOT voided)
SELECT CAST(m.m AS INTEGER) AS month, CAST(coalesce(sum(h), 0) AS BIGINT) AS held, CAST(coalesce(sum(x), 0) AS BIGINT) AS cancelled, CAST(coalesce(sum(c), 0) AS BIGINT) AS charged, CAST(coalesce(sum(r), 0) AS BIGINT) AS received
FROM (SELECT unnest(range(1, 13)) AS m) m LEFT JOIN (SELECT * FROM rows WHERE year(date) = 1998) ON month(date) = m.m GROUP BY m.m""")
def income_year(spark, d):
    return ledger.income_year(*_three(spark, d), 1998)


@query(f"""{CHARGED}, rows AS (SELECT date, 1 AS v, 0 AS c, 0 AS p, charge AS a, 0 AS r FROM vc WHERE status <> 'planned' UNION ALL SELECT date, 0, 1, 0, amount, 0 FROM charges WHERE NOT voided UNION ALL SELECT date, 0, 0, 1, 0, amount FROM payments WHERE NOT voided)
SELECT date, CAST(sum(v) AS BIGINT) AS n_visits, CAST(sum(c) AS BIGINT) AS n_charges, CAST(sum(p) AS BIGINT) AS n_payments, CAST(sum(a) AS BIGINT) AS charged, CAST(sum(r) AS BIGINT) AS received FROM rows WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31' GROUP BY date""")
def diary_month(spark, d):
    return ledger.diary_month(*_three(spark, d), "1999-03")


@query(""" SELECT coalesce(month, 'all') AS month, coalesce(method, 'all') AS method, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n
FROM (SELECT strftime(date, '%Y-%m') AS month, method, amount FROM payments WHERE NOT voided) GROUP BY GROUPING SETS ((month, method), (month), ())""")
def by_method_grouping_sets(spark, d):
    return ledger.method_sums(payments(spark, d))


@query(""" SELECT CAST(w.w AS INTEGER) AS weekday, count(*) FILTER (status = 'held') AS held, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'planned') AS planned
FROM (SELECT unnest(range(0, 7)) AS w) w LEFT JOIN visits ON dayofweek(date) = w.w GROUP BY w.w""")
def insights_by_weekday(spark, d):
    return ledger.weekday_counts(visits(spark, d))


@query(""" SELECT *, CASE WHEN held + cancelled = 0 THEN 0 ELSE (cancelled * 1000 + (held + cancelled) // 2) // (held + cancelled) END AS cancelled_per_thousand
FROM (SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (status = 'held') AS held, count(*) FILTER (status = 'cancelled') AS cancelled FROM visits GROUP BY 1)""")
def insights_rates(spark, d):
    return ledger.month_rates(visits(spark, d))


@query("""WITH g AS (SELECT lower(trim(p_type || ' ' || p_brand)) AS key, arg_min(trim(p_type || ' ' || p_brand), p_partkey) AS name, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS r FROM g) SELECT name, n FROM r WHERE r <= 8 UNION ALL SELECT 'others', CAST(sum(n) AS BIGINT) FROM r WHERE r > 8 HAVING sum(n) > 0""")
def referrals_topn(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"), "p_partkey")
    return ledger.top_and_others(rows, "name", "p_partkey", 8)


@query(""", s AS (SELECT patient_id, min(date) AS st FROM visits WHERE status = 'held' AND kind = 'intake' GROUP BY 1),
e AS (SELECT s.patient_id, min(v.date) - min(st) AS days FROM s JOIN visits v ON v.patient_id = s.patient_id AND v.status = 'held' AND v.kind = 'feedback' AND v.date >= st GROUP BY s.patient_id)
SELECT count(*) AS n, CAST(floor(median(days)) AS BIGINT) AS median_days FROM e""")
def pathway_medians(spark, d):
    return ledger.pathway_days(visits(spark, d))


@query(""", h AS (SELECT date_trunc('month', date) AS f, sum(minutes) AS m FROM visits WHERE status = 'held' GROUP BY 1),
w AS (SELECT f, m, unnest(generate_series(CAST(f AS TIMESTAMP), CAST(last_day(f) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM h)
SELECT month, work_days, held_minutes, (held_minutes * 1000 + work_days * 480 // 2) // (work_days * 480) AS per_thousand FROM (SELECT strftime(f, '%Y-%m') AS month, count(*) AS work_days, CAST(min(m) AS BIGINT) AS held_minutes FROM w WHERE dayofweek(day) <= 4 GROUP BY f)""")
def occupancy(spark, d):
    return ledger.occupancy(visits(spark, d), 480)


@query(""", v AS (SELECT *, start + minutes AS fin FROM visits WHERE status <> 'cancelled')
SELECT DISTINCT a.id FROM v a JOIN v b ON a.date = b.date AND a.patient_id % 16 = b.patient_id % 16 AND a.id <> b.id AND a.start < b.fin AND b.start < a.fin""")
def visit_overlaps(spark, d):
    return schedule.overlapping(visits(spark, d).withColumn("room", F.col("patient_id") % 16), ("room", "date"))


@query(f""" SELECT patient_id, arg_max(id, (date, start, id)) FILTER (status = 'held' AND date < DATE '{TODAY}') AS last_held, arg_min(id, (date, start, id)) FILTER (status = 'planned' AND date >= DATE '{TODAY}') AS next_planned FROM visits GROUP BY patient_id""")
def next_visit(spark, d):
    return schedule.neighbours(visits(spark, d), TODAY)


@query(""", g AS (SELECT CAST(day AS DATE) AS date, CAST(s AS INTEGER) AS start FROM (SELECT unnest(generate_series(TIMESTAMP '1999-05-01', TIMESTAMP '1999-05-31', INTERVAL 1 DAY)) AS day), (SELECT unnest(range(480, 1080, 30)) AS s)),
f AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.status <> 'cancelled' AND v.date = g.date AND v.start < g.start + 30 AND v.start + v.minutes > g.start))
SELECT date, start FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY start) AS r FROM f) WHERE r <= 3""")
def free_slots(spark, d):
    return schedule.free_starts(visits(spark, d), "1999-05-01", "1999-05-31", 480, 1080, 30, 3)


@query(""", s AS (SELECT patient_id AS id, min(date) AS date FROM visits GROUP BY 1) SELECT id, n, CAST(date + CAST(n * 14 AS INTEGER) AS DATE) AS date FROM (SELECT *, CAST(unnest(range(0, 5)) AS INTEGER) AS n FROM s)""")
def series_dates(spark, d):
    return schedule.series(visits(spark, d).groupBy(F.col("patient_id").alias("id")).agg(F.min("date").alias("date")), 2, 5)


@query(""", a AS (SELECT id, date, start FROM visits WHERE id % 11 <> 3), b AS (SELECT id, CASE WHEN id % 7 = 2 THEN date + 1 ELSE date END AS date, start FROM visits WHERE id % 13 <> 5)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM a FULL JOIN b ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.date <> b.date""")
def calendar_diff(spark, d):
    v = visits(spark, d).select("id", "date", "start")
    there = v.where("id % 13 <> 5").withColumn("date", F.when(F.col("id") % 7 == 2, F.date_add("date", 1)).otherwise(F.col("date")))
    return schedule.differences(v.where("id % 11 <> 3"), there, "id", ["date", "start"])


@query(f"""{UNCOVERED} SELECT patient_id, 'unmarked' AS alert, min(date) AS since FROM visits WHERE status = 'planned' AND date < DATE '{TODAY}' GROUP BY 1
UNION ALL SELECT patient_id, 'no_next_visit', max(date) FILTER (status = 'held') FROM visits GROUP BY 1 HAVING count(*) FILTER (status = 'planned' AND date >= DATE '{TODAY}') = 0 AND max(date) FILTER (status = 'held') BETWEEN DATE '{TODAY}' - 60 AND DATE '{TODAY}'
UNION ALL SELECT patient_id, 'old_debt', oldest FROM uncovered WHERE DATE '{TODAY}' - oldest > 60""")
def alerts(spark, d):
    v, c, p = _three(spark, d)
    return schedule.alerts(v, ledger.oldest_uncovered(v, c, p), TODAY)


@query("""SELECT event_id, user_id, event_type FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 5000) ORDER BY ts DESC, event_id DESC LIMIT 50""")
def keyset_page(spark, d):
    e = table(spark, d, "events").select("ts", "event_id", "user_id", "event_type")
    at = F.lit("2024-01-20 00:00:00").cast(e.schema["ts"].dataType)
    return records.keyset_page(e, "ts", "event_id", (at, 5000), 50).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, event_type, props FROM events WHERE contains(props, '42') ORDER BY event_id DESC LIMIT 1""")
def log_find(spark, d):
    return records.find_newest(table(spark, d, "events").select("event_id", "event_type", "props"), "42", "props", "event_id")


@query("""WITH m AS (SELECT event_id AS seq, sha256(CAST(event_id AS VARCHAR) || event_type) AS mac FROM events), l AS (SELECT seq, mac, CASE WHEN seq % 499 = 7 THEN 'x' ELSE lag(mac) OVER (ORDER BY seq) END AS prev FROM m), g AS (SELECT * FROM l WHERE seq % 307 <> 11)
SELECT a.seq, CASE WHEN b.seq IS NULL THEN 'gap' ELSE 'altered' END AS fault FROM g a LEFT JOIN g b ON b.seq = a.seq - 1 WHERE (b.seq IS NULL AND a.seq > (SELECT min(seq) FROM g)) OR (b.seq IS NOT NULL AND a.prev IS DISTINCT FROM b.mac)""")
def chain_check(spark, d):
    mac = lambda seq, kind: F.sha2(F.concat(seq.cast("string"), kind), 256)
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), mac(F.col("event_id"), F.col("event_type")).alias("mac"))
    log = e.join(e.select((F.col("seq") + 1).alias("seq"), F.col("mac").alias("prev")), "seq", "left")
    log = log.withColumn("prev", F.when(F.col("seq") % 499 == 7, "x").otherwise(F.col("prev"))).where("seq % 307 <> 11")
    return records.chain_faults(log)


@query("""SELECT conv_id, turn, role, length(text) AS n_chars, CAST(version AS INTEGER) AS version FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS version FROM conversations) WHERE version <= 6""")
def recent_turns(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return records.latest(rows, ["conv_id"], [F.desc("turn")], 6)


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 10 THEN NULL ELSE p_partkey // 10 END AS parent FROM part),
t AS (SELECT id, id AS top, parent, 0 AS depth FROM n UNION ALL SELECT t.id, n.id, n.parent, t.depth + 1 FROM t JOIN n ON t.parent = n.id) SELECT id, top AS root, depth FROM t WHERE parent IS NULL""")
def folder_ancestors(spark, d):
    parent = F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10).cast("long"))
    return records.ancestors(table(spark, d, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent")))


@query("""SELECT month, model, tokens, CAST(ceil(tokens * p / 1000000) AS BIGINT) AS cost FROM (SELECT strftime(ts, '%Y-%m') AS month, event_type AS model, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL)
LEFT JOIN (VALUES ('click', 300), ('view', 1500), ('purchase', 25)) v(m, p) ON m = model""")
def usage_cost(spark, d):
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("model"), F.round(F.col("value") * 100).cast("long").alias("tokens"))
    return records.usage_cost(rows, spark.createDataFrame([("click", 300), ("view", 1500), ("purchase", 25)], "model string, price long"))


def _sheets(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("measure"), (F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey"), F.lit(121)) + 40).cast("double").alias("value"), F.to_date("l_shipdate").alias("at"))


SHEETS = """WITH sheets AS (SELECT l_orderkey AS sheet, l_linenumber AS measure, CAST((l_partkey * 31 + l_suppkey) % 121 + 40 AS DOUBLE) AS value, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""


@query(f"""{SHEETS} SELECT CASE WHEN value BETWEEN 40 AND 69 THEN 'very low' WHEN value BETWEEN 70 AND 79 THEN 'low' WHEN value BETWEEN 80 AND 89 THEN 'low average' WHEN value BETWEEN 90 AND 109 THEN 'average' WHEN value BETWEEN 110 AND 119 THEN 'high average' WHEN value BETWEEN 120 AND 129 THEN 'high' WHEN value BETWEEN 130 AND 160 THEN 'very high' END AS band, count(*) AS n FROM sheets GROUP BY 1""")
def score_bands(spark, d):
    return _sheets(spark, d).groupBy(scores.band_label(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{SHEETS}, v AS (SELECT DISTINCT value, (value - 100) / 15 AS z FROM sheets), t AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2))) AS t FROM v),
q AS (SELECT value, z, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS e FROM t), p AS (SELECT value, CASE WHEN z >= 0 THEN 50 * (1 + e) ELSE 50 * (1 - e) END AS p FROM q)
SELECT value, CASE WHEN p < 0.1 THEN '<0.1' WHEN p > 99.9 THEN '>99.9' WHEN p < 1 OR p > 99 THEN CASE WHEN round(p, 1) = round(round(p, 1)) THEN CAST(CAST(round(p, 1) AS INTEGER) AS VARCHAR) ELSE CAST(CAST(round(p, 1) AS DECIMAL(9, 1)) AS VARCHAR) END ELSE CAST(CAST(round(p) AS INTEGER) AS VARCHAR) END AS percentile FROM p""")
def score_percentile(spark, d):
    return _sheets(spark, d).select("value").distinct().select("value", scores.percentile(F.col("value")).alias("percentile"))


@query(f"""{SHEETS}, p AS (SELECT o_custkey AS person, measure, value, row_number() OVER (PARTITION BY o_custkey, measure ORDER BY day DESC, sheet DESC, value DESC) AS r FROM sheets JOIN orders ON sheet = o_orderkey),
a AS (SELECT * FROM p WHERE r = 1), b AS (SELECT * FROM p WHERE r = 2) SELECT a.person, a.measure, b.value AS before, a.value AS after, a.value - b.value AS change FROM a JOIN b ON a.person = b.person AND a.measure = b.measure""")
def score_compare(spark, d):
    people = table(spark, d, "orders").select(F.col("o_orderkey").alias("sheet"), F.col("o_custkey").alias("person"))
    return scores.before_after(_sheets(spark, d).join(people, "sheet"))


@query(f"""{SHEETS}, m AS (SELECT *, avg(value) OVER (PARTITION BY sheet) AS mean, count(value) OVER (PARTITION BY sheet) AS n FROM sheets)
SELECT sheet, measure, CASE WHEN value - mean >= 3 THEN 'strength' ELSE 'weakness' END AS place FROM m WHERE n >= 3 AND abs(value - mean) >= 3""")
def score_relative(spark, d):
    return scores.relative_places(_sheets(spark, d))


@query(f"""{SHEETS} SELECT sheet, max(value) - min(value) AS spread, CASE WHEN max(value) - min(value) >= 23 THEN 'wide' WHEN max(value) - min(value) <= 9 THEN 'flat' ELSE 'usual' END AS shape FROM sheets GROUP BY sheet HAVING count(value) > 1""")
def score_patterns(spark, d):
    return scores.spreads(_sheets(spark, d))


WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS})) AS word FROM benchmark), d AS (SELECT doc_id, {WORDS} AS w FROM documents), n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
c AS (SELECT doc_id, len AS l, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM c GROUP BY word),
s AS (SELECT query_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM c JOIN f USING (word) JOIN q USING (word), n GROUP BY ALL)
SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def bm25_top(spark, d):
    docs, items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return text.top_of(text.bm25(docs, items), "query_id", "score", "doc_id", 3).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH w AS (SELECT doc_id, source, {WORDS} AS w FROM documents), g AS (SELECT DISTINCT doc_id, source, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w))
SELECT source AS section, phrase, count(DISTINCT doc_id) AS reports FROM g GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5""")
def common_phrases(spark, d):
    return text.phrases(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"), "text"), 3, 5)


@query("""SELECT source, lang, k, n, round((k / n + 2.706025 / (2 * n) - 1.645 * sqrt((k / n * (1 - k / n) + 2.706025 / (4 * n)) / n)) / (1 + 2.706025 / n), 6) AS lower FROM (SELECT source, lang, count(*) FILTER (n_chars > 1000) AS k, count(*) AS n FROM documents GROUP BY ALL)""")
def wilson_bounds(spark, d):
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count_if(F.col("n_chars") > 1000).alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("lower", F.round(text.wilson_lower(F.col("k"), F.col("n")), 6))


DETAIL = {k: v.replace("'", "''") for k, v in text.DETAILS.items()}


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(regexp_extract_all(coalesce(text, ''), '{v}')) AS n FROM documents" for k, v in DETAIL.items()) + ") SELECT kind, CAST(sum(n) AS BIGINT) AS places, count(*) FILTER (n > 0) AS documents FROM x GROUP BY kind")
def detail_counts(spark, d):
    return text.detail_counts(table(spark, d, "documents"))


def _redacted_sql() -> str:
    out = "coalesce(text, '')"
    for k, v in DETAIL.items():
        out = f"regexp_replace({out}, '{v}', '[{k}]', 'g')"
    return out


@query(f"SELECT doc_id, {_redacted_sql()} AS text FROM documents")
def redact_details(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redacted("text").alias("text"))


@query(f"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '{DETAIL["email"]}') AS f FROM documents), p AS (SELECT doc_id, unnest(f) AS value, unnest(range(0, len(f))) AS place FROM e),
m AS (SELECT value, min((doc_id, place)) AS first FROM p GROUP BY value) SELECT value, '[email_' || row_number() OVER (ORDER BY first) || ']' AS tag FROM m""")
def mask_book(spark, d):
    return text.masks(table(spark, d, "documents"))


@query(r"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || ' ratio 5:4, mean 98.6 and ' || doc_id ELSE text END AS text FROM documents), o AS (SELECT id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.:][0-9]+)*') AS l FROM d),
e AS (SELECT id, x, min(i) AS at_ FROM (SELECT id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM o) GROUP BY 1, 2), told AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.:][0-9]+)*')) AS x FROM documents WHERE doc_id % 4 = 0)
SELECT id, string_agg(x, ',' ORDER BY at_) AS numbers FROM e WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.id = e.id AND t.x = e.x) GROUP BY id""")
def numbers_not_in_sources(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    added = F.concat(F.coalesce("text", F.lit("")), F.lit(" ratio 5:4, mean 98.6 and "), F.col("id").cast("string"))
    return checks.numbers_not_in(docs.withColumn("text", F.when(F.col("id") % 2 == 0, added).otherwise(F.col("text"))), docs.where("id % 4 = 0"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS line FROM conversations""")
def clean_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.clean_line("text").alias("line"))


@query(f"""{CHARGED}, m AS (SELECT strftime(date, '%Y-%m') AS month, 'held' AS what, kind AS part, count(*) AS n FROM visits WHERE status = 'held' AND patient_id % 10 = 0 GROUP BY ALL UNION ALL SELECT strftime(date, '%Y-%m'), 'cancelled', '', count(*) FROM visits WHERE status = 'cancelled' AND patient_id % 10 = 0 GROUP BY ALL
UNION ALL SELECT strftime(date, '%Y-%m'), 'charged', '', CAST(sum(amount) AS BIGINT) FROM charged WHERE patient_id % 10 = 0 GROUP BY ALL UNION ALL SELECT strftime(date, '%Y-%m'), 'received', method, CAST(sum(amount) AS BIGINT) FROM payments WHERE NOT voided AND patient_id % 10 = 0 GROUP BY ALL) SELECT * FROM m WHERE month IS NOT NULL""")
def erased_rollup(spark, d):
    """What stays of patients that are erased: by month, counts by kind, charges, and receipts by method. Folded in two goes."""
    def of(k: str):
        return tuple(x.where(k) for x in _three(spark, d))

    return ledger.with_rollup(ledger.tally(*of("patient_id % 20 = 0")), ledger.tally(*of("patient_id % 20 = 10")), ["month", "what", "part"], ["n"])


@query(f"""SELECT id, until FROM (SELECT id, CAST(greatest(created_on + INTERVAL 3 YEAR, coalesce(birth_date + INTERVAL 12 YEAR, DATE '1900-01-01')) AS DATE) AS until FROM patients) WHERE until <= DATE '{TODAY}'""")
def retention_due(spark, d):
    return records.retention_due(source.patients(spark, d), "created_on", TODAY, 3, 12)


DAY_S = 86_400


@query(f"""WITH k AS (SELECT user_id AS key, list_reduce(list_transform(list({{'t': epoch_us(ts), 'id': event_id}} ORDER BY ts, event_id), lambda x: [x]),
  lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.t > x[1].t - {DAY_S}000000)) < 2 THEN list_concat(a, x) ELSE a END) AS sent FROM events GROUP BY 1),
r AS (SELECT event_id AS id, key, list_contains(list_transform(sent, lambda y: y.id), event_id) AS accepted, epoch_us(ts) AS t, list_transform(sent, lambda y: y.t) AS sent FROM events JOIN k ON user_id = key)
SELECT id, key, accepted, CASE WHEN NOT accepted THEN list_min(list_filter(sent, lambda y: y <= t AND y > t - {DAY_S}000000)) + {DAY_S}000000 - t END AS wait_us FROM r""")
def request_limit(spark, d):
    return folds.limited(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("at")), 2, DAY_S)


WAIT_S = 20_000
_BEGINS = f"CASE WHEN len(a.sent) < 2 THEN x.t ELSE greatest(x.t, a.sent[len(a.sent) - 1] + {DAY_S}000000) END"


@query(f"""WITH k AS (SELECT user_id AS key, list({{'id': event_id, 't': epoch_us(ts), 'sent': []::BIGINT[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN, w BIGINT)[]}} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
f AS (SELECT key, list_reduce(list_prepend({{'id': -1::BIGINT, 't': 0::BIGINT, 'sent': []::BIGINT[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN, w BIGINT)[]}}, l),
  lambda a, x: {{'id': x.id, 't': x.t, 'sent': CASE WHEN {_BEGINS} - x.t <= {WAIT_S}000000 THEN list_append(a.sent, {_BEGINS}) ELSE a.sent END, 'out': list_append(a.out, {{'id': x.id, 'ok': {_BEGINS} - x.t <= {WAIT_S}000000, 'w': {_BEGINS} - x.t}})}}).out AS o FROM k),
u AS (SELECT key, unnest(o) AS o FROM f) SELECT o.id AS id, key, o.ok AS accepted, o.w AS wait_us FROM u""")
def request_waits(spark, d):
    """Two requests a day for each user; others wait for up to 20,000 seconds, or are refused."""
    return folds.waited(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("at")), 2, DAY_S, WAIT_S)


@query(f"""WITH e AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN 'busy' WHEN event_type <> 'signup' THEN 'up' ELSE 'none' END AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT key, list({{'id': id, 't': t, 'o': o}} ORDER BY i) AS l FROM e GROUP BY 1),
f AS (SELECT key, list_reduce(list_prepend({{'id': -1::BIGINT, 't': 0::BIGINT, 'o': '', 'busy': 0, 'until': NULL::BIGINT, 'out': []::STRUCT(id BIGINT, ok BOOLEAN, w BIGINT)[]}}, list_transform(l, lambda x: {{'id': x.id, 't': x.t, 'o': x.o, 'busy': 0, 'until': NULL::BIGINT, 'out': []::STRUCT(id BIGINT, ok BOOLEAN, w BIGINT)[]}})),
  lambda a, x: CASE WHEN a.until IS NOT NULL AND x.t < a.until THEN {{'id': x.id, 't': x.t, 'o': x.o, 'busy': a.busy, 'until': a.until, 'out': list_append(a.out, {{'id': x.id, 'ok': false, 'w': a.until - x.t}})}}
    ELSE {{'id': x.id, 't': x.t, 'o': x.o, 'busy': CASE x.o WHEN 'up' THEN 0 WHEN 'busy' THEN a.busy + 1 ELSE a.busy END, 'until': CASE WHEN x.o = 'up' THEN NULL WHEN x.o = 'busy' AND (a.until IS NOT NULL OR a.busy + 1 >= 2) THEN x.t + {DAY_S}000000 ELSE a.until END, 'out': list_append(a.out, {{'id': x.id, 'ok': true, 'w': NULL::BIGINT}})}} END).out AS out FROM l)
SELECT r.id AS id, key, r.ok AS accepted, r.w AS wait_us FROM (SELECT key, unnest(out) AS r FROM f)""")
def circuit_breaker(spark, d):
    outcome = F.when(F.col("event_type") == "error", "busy").when(F.col("event_type") != "signup", "up")
    return folds.breaker(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("at"), outcome.alias("outcome")), 2, DAY_S)


def _styled(spark, d):
    docs = table(spark, d, "documents")
    return style.features(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("section"), style.report_weight(F.col("doc_id") % 20).alias("weight"), "text"))


STYLED = f"""WITH d AS (SELECT doc_id AS id, source AS section, greatest(pow(0.9, doc_id % 20), 0.4) AS weight, coalesce(text, '') AS text, len({WORDS}) AS n FROM documents),
f AS (SELECT id, section, weight, unnest([{{'feature': 'sentence_words', 'x': n / greatest(len(regexp_extract_all(text, '[.!?]+')), 1)}}, {{'feature': 'word_chars', 'x': length(regexp_replace(text, '{text.NOT_WORD}', '', 'g')) / n}},
  {{'feature': 'commas', 'x': 100 * len(regexp_extract_all(text, ',')) / n}}, {{'feature': 'questions', 'x': 100 * len(regexp_extract_all(text, '[?]')) / n}}, {{'feature': 'brackets', 'x': 100 * len(regexp_extract_all(text, '[(]')) / n}}], recursive := true) FROM d WHERE n > 0),
s AS (SELECT section, feature, sum(weight) AS n, sum(weight * x) AS a, sum(weight * x * x) AS b FROM f GROUP BY 1, 2),
m AS (SELECT section, feature, n, a / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest(b - a * a / n, 0) / (n - 1)) ELSE 0 END AS sd FROM s)"""


@query(f"{STYLED} SELECT section, feature, round(n, 3) AS n, round(mean, 3) AS mean, round(sd, 3) AS sd FROM m")
def style_moments(spark, d):
    return style.moments(_styled(spark, d)).select("section", "feature", *(F.round(c, 3).alias(c) for c in ("n", "mean", "sd")))


@query(f"{STYLED} SELECT id, round(avg(z), 3) AS delta, round(100 * avg(greatest(1 - z / 4, 0)), 3) AS fidelity FROM (SELECT id, abs(x - mean) / greatest(sd, 0.5) AS z FROM f JOIN m USING (section, feature)) GROUP BY id")
def style_closeness(spark, d):
    measured = _styled(spark, d)
    return style.closeness(measured, style.moments(measured)).select("id", *(F.round(c, 3).alias(c) for c in ("delta", "fidelity")))


@query(r"""WITH a AS (SELECT s_suppkey AS case_id, s_name AS name, unnest(list_distinct(regexp_split_to_array(lower(s_name), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS word FROM supplier),
k AS (SELECT c_custkey AS other, c_name AS other_name, unnest(list_distinct(regexp_split_to_array(lower(c_name), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS word FROM customer)
SELECT DISTINCT case_id, name, other + 1 AS other, other_name FROM a JOIN k USING (word) WHERE length(word) >= 2 AND case_id <> other + 1""")
def name_matches(spark, d):
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("name"))
    known = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("case_id"), F.col("c_name").alias("name"))
    return text.name_matches(asked, known)


LISTED = ["the", "of", "and", "to", "a", "in", "that", "it", "for", "with", "der", "und", "le", "de"]
TOPICS = {"being": ["is", "was", "be", "are"], "place": ["in", "on", "at", "from"], "links": ["and", "that", "with", "und", "et"], "purpose": ["to", "for", "pour"]}
LISTS = ", ".join(f"len(list_filter(w, lambda x: list_contains({words}, x)))" for words in TOPICS.values())


@query(f"""WITH d AS (SELECT doc_id AS id, source AS section, greatest(pow(0.9, doc_id % 20), 0.4) AS weight, {WORDS} AS w FROM documents), l AS (SELECT unnest({LISTED}) AS feature),
f AS (SELECT section, feature, weight, 100 * len(list_filter(w, lambda x: x = feature)) / len(w) AS x FROM d, l WHERE len(w) > 0), s AS (SELECT section, feature, sum(weight) AS n, sum(weight * x) AS a, sum(weight * x * x) AS b FROM f GROUP BY 1, 2)
SELECT section, feature, round(n, 3) AS n, round(a / n, 3) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(b - a * a / n, 0) / (n - 1)) ELSE 0 END, 3) AS sd FROM s""")
def style_word_rates(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"), style.report_weight(F.col("doc_id") % 20).alias("weight"), "text")
    return style.moments(style.word_rates(docs, LISTED)).select("section", "feature", *(F.round(c, 3).alias(c) for c in ("n", "mean", "sd")))


READ = rf"""WITH d AS (SELECT doc_id AS id, source AS section, lang AS band, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r\n]')) AS lines FROM documents),
p AS (SELECT id, section, band, CASE WHEN len(lines) >= 2 THEN lines ELSE list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '[^ \t\r\n]')) END AS ps FROM d WHERE id IS NOT NULL),
e AS (SELECT id, section, band, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM p), w AS (SELECT id, section, band, i, {WORDS} AS w FROM e), h AS (SELECT id, section, band, i, len(w) AS n, [{LISTS}] AS h FROM w),
c AS (SELECT id, section, band, i, n, last_value(CASE WHEN list_max(h) > 0 THEN list_position(h, list_max(h)) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS t FROM h),
r AS (SELECT id, section, band, t, min(i) AS first, CAST(sum(n) AS BIGINT) AS words FROM c WHERE t IS NOT NULL GROUP BY ALL),
read AS (SELECT id, section, band, t, {list(TOPICS)}[t] AS topic, (row_number() OVER (PARTITION BY id ORDER BY first) - 1) / greatest(count(*) OVER (PARTITION BY id) - 1, 1) AS place, words FROM r)"""


def _read(spark, d):
    return style.topics_read(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"), F.col("lang").alias("band"), "text"), TOPICS)


@query(f"{READ} SELECT id, section, topic, round(place, 4) AS place, words FROM read")
def topics_read(spark, d):
    return _read(spark, d).select("id", "section", "topic", F.round("place", 4).alias("place"), "words")


@query(f"""{READ}, b AS (SELECT id, section, band, t, topic, place, words FROM read WHERE band IS NOT NULL UNION ALL SELECT id, section, NULL, t, topic, place, words FROM read),
g AS (SELECT section, band, count(DISTINCT id) AS reports FROM b GROUP BY 1, 2), k AS (SELECT section, band, t, topic, count(*) AS n, avg(place) AS place, list_sort(list(words))[count(*) // 2 + 1] AS words FROM b GROUP BY 1, 2, 3, 4)
SELECT k.section, k.band, topic, CAST(row_number() OVER (PARTITION BY k.section, k.band ORDER BY round(place, 6), t) AS INTEGER) AS rank, round(n / reports, 4) AS share, words, reports
FROM k JOIN g ON k.section IS NOT DISTINCT FROM g.section AND k.band IS NOT DISTINCT FROM g.band WHERE reports >= 3 AND n >= 0.5 * reports QUALIFY count(*) OVER (PARTITION BY k.section, k.band) >= 2""")
def style_skeletons(spark, d):
    return style.skeletons(_read(spark, d)).withColumn("share", F.round("share", 4))


@query(r"""WITH p AS (SELECT doc_id AS child, source AS section, unnest(string_split_regex(coalesce(text, ''), '[.!?]+')) AS s FROM documents),
q AS (SELECT DISTINCT child, section, trim(regexp_replace(regexp_replace(s, '[0-9]+', '#', 'g'), '[ \t\n\r]+', ' ', 'g')) AS sentence FROM p),
c AS (SELECT section, sentence, count(child) AS children FROM q WHERE len(regexp_extract_all(sentence, ' ')) >= 2 GROUP BY 1, 2 HAVING count(child) >= 3)
SELECT section, sentence, children, CAST(row_number() OVER (PARTITION BY section ORDER BY children DESC, sentence) AS INTEGER) AS rank FROM c QUALIFY rank <= 6""")
def style_formulas(spark, d):
    return style.formulas(table(spark, d, "documents").select(F.col("doc_id").alias("child"), F.col("source").alias("section"), "text"))


@query(r"""WITH g AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN chr(39) || t ELSE t END AS t FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '[,"\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell FROM g""")
def csv_cells(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", csv.csv_cell(F.col("text")).alias("cell"))
