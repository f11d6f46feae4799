"""Queries over files, logs, versions, messages and the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import holidays, insights, ledger, mining, overlap, privacy, records, schedule, text, validation
from quillspark.plans.registry import TODAY, query
from quillspark.plans.texts import GROUPS
from quillspark.sources import csv, files
from quillspark.sources.records import charges, patients, payments, table, tasks, visits
from quillspark.streaming import messages

DAY = f"DATE '{TODAY}'"


@query("""WITH p AS (SELECT l_orderkey AS page, l_linenumber % 2 AS block, l_suppkey % 2 AS par, l_partkey % 3 AS line, l_linenumber AS word, l_quantity * 2 - 10 AS conf, CASE WHEN l_linenumber = 4 THEN ' ' ELSE 'w' || l_partkey END AS text FROM lineitem),
l AS (SELECT page, block, par, line, string_agg(text, ' ' ORDER BY word, text) AS t, sum(conf) FILTER (conf >= 0) AS s, count(*) FILTER (conf >= 0) AS n FROM p WHERE trim(text) <> '' GROUP BY 1, 2, 3, 4), r AS (SELECT page, block, par, string_agg(t, chr(10) ORDER BY line, t) AS t, sum(s) AS s, sum(n) AS n FROM l GROUP BY 1, 2, 3)
SELECT page, string_agg(t, chr(10) || chr(10) ORDER BY block, par, t) AS text, round(sum(s) / sum(n), 4) AS conf FROM r GROUP BY 1""")
def recognised_lines(spark, d):
    line = table(spark, d, "lineitem")
    name = F.when(F.col("l_linenumber") == 4, " ").otherwise(F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    words = line.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 2).alias("block"), (F.col("l_suppkey") % 2).alias("par"), (F.col("l_partkey") % 3).alias("line"), F.col("l_linenumber").alias("word"), (F.col("l_quantity") * 2 - 10).alias("conf"), name.alias("text"))
    return files.recognised_lines(words)


@query("SELECT id, date, patient_id FROM visits WHERE kind = 'assessment' AND date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'")
def records_of_kind(spark, d):
    rows = visits(spark, d).withColumn("day", F.col("date"))
    return files.of_kind(rows, "assessment", "1999-01-01", "1999-06-30").select("id", "date", "patient_id")


@query(""", l AS (SELECT strftime(date, '%Y-%m') AS month, method, amount, CAST(id AS VARCHAR) AS label FROM payments WHERE NOT voided AND patient_id % 10 <> 0 AND date BETWEEN DATE '1999-11-01' AND DATE '2000-02-29'), g AS (SELECT strftime(date, '%Y-%m') AS month, method, CAST(sum(amount) AS BIGINT) AS amount FROM payments WHERE NOT voided AND patient_id % 10 = 0 AND date BETWEEN DATE '1999-11-01' AND DATE '2000-02-29' GROUP BY ALL),
s AS (SELECT month, method, CAST(sum(a) AS BIGINT) AS listed, CAST(sum(b) AS BIGINT) AS erased FROM (SELECT month, method, amount AS a, 0 AS b FROM l UNION ALL SELECT month, method, 0, amount FROM g) GROUP BY 1, 2)
SELECT 1 AS part, month, label, amount AS listed, 0 AS erased FROM l UNION ALL SELECT 2, month, method, listed, erased FROM s UNION ALL SELECT 3, m, 'total', CAST(coalesce(sum(listed), 0) AS BIGINT), CAST(coalesce(sum(erased), 0) AS BIGINT) FROM (SELECT unnest(['1999-11', '1999-12', '2000-01', '2000-02']) AS m) LEFT JOIN s ON month = m GROUP BY m""")
def income_parts(spark, d):
    p = payments(spark, d)
    gone = ledger.tally(*(x.where("patient_id % 10 = 0") for x in (visits(spark, d), charges(spark, d), p))).where("what = 'received'").select("month", F.col("part").alias("method"), F.col("n").alias("amount"))
    return files.income_parts(p.where("patient_id % 10 <> 0"), gone, "1999-11", "2000-02")


@query("""WITH e AS (SELECT user_id AS stream_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN CASE WHEN value > 12 THEN 'stop' ELSE 'delta' END WHEN 'error' THEN CASE WHEN value > 14 THEN 'error' ELSE 'usage' END ELSE 'delta' END AS event, CASE WHEN event_type = 'error' AND value <= 14 THEN CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) ELSE substr(event_type, 1, 2) END AS data FROM events),
x AS (SELECT stream_id, min(seq) FILTER (event IN ('stop', 'error')) AS last FROM e GROUP BY 1), l AS (SELECT e.*, last FROM e JOIN x USING (stream_id) WHERE last IS NULL OR seq <= last)
SELECT stream_id, coalesce(string_agg(data, '' ORDER BY seq) FILTER (event = 'delta'), '') AS text, CAST(coalesce(sum(try_cast(data AS BIGINT)) FILTER (event = 'usage'), 0) AS BIGINT) AS tokens, CASE WHEN last IS NULL THEN 'cut' WHEN count(*) FILTER (seq = last AND event = 'stop') > 0 THEN 'done' ELSE 'error: ' || max(data) FILTER (seq = last) END AS state FROM l GROUP BY stream_id, last""")
def assembled_messages(spark, d):
    e, v = table(spark, d, "events"), F.col("value")
    kind = F.when(F.col("event_type") == "purchase", F.when(v > 12, "stop").otherwise("delta")).when(F.col("event_type") == "error", F.when(v > 14, "error").otherwise("usage")).otherwise("delta")
    data = F.when((F.col("event_type") == "error") & (v <= 14), F.floor("value").cast("string")).otherwise(F.substring("event_type", 1, 2))
    return messages.assembled(e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), kind.alias("event"), data.alias("data")))


def _start(y: str) -> str:
    """The year's first day by Gauss's rule for Passover of the spring before it, 163 days earlier (Julian dates are 13 days behind)."""
    a, b, m = f"((12 * ({y} - 1) + 17) % 19)", f"(({y} - 1) % 4)", f"(32.0440932 + 1.5542418 * ((12 * ({y} - 1) + 17) % 19) + 0.25 * (({y} - 1) % 4) - 0.003177794 * ({y} - 1))"
    c = f"((CAST(floor({m}) AS BIGINT) + 3 * ({y} - 1) + 5 * {b} + 5) % 7)"
    late = f"CASE WHEN {c} IN (2, 4, 6) THEN 1 WHEN {c} = 1 AND {a} > 6 AND {m} - floor({m}) >= 0.63287037 THEN 2 WHEN {c} = 0 AND {a} > 11 AND {m} - floor({m}) >= 0.89772376 THEN 1 ELSE 0 END"
    return f"(date_diff('day', DATE '1970-01-01', make_date(CAST({y} - 3761 AS BIGINT), 3, 1)) + CAST(floor({m}) AS BIGINT) - 1 + {late} + 13 + 163)"


#: Month by month from the year's first day, where the operator counts the spring from the next year's.
DAYS = [("0", "New Year", True), ("1", "New Year", True), ("8", "Eve of Atonement", False), ("9", "Day of Atonement", True), ("13", "Eve of Tabernacles", False), ("14", "Tabernacles", True), *((str(n - 1), "Middle of Tabernacles", False) for n in range(16, 21)), ("20", "Great Hosanna", False), ("21", "Rejoicing of the Law", True),
        *((f"kislev + {22 + n}", f"Hanukkah, candle {n}", False) for n in range(1, 9)), ("kislev + 31", "Hanukkah, last day", False), ("shevat + 14", "New Year of Trees", False), ("adar + 12 - CASE WHEN (s + adar + 12 + 4) % 7 = 6 THEN 2 ELSE 0 END", "Fast of Esther", False), ("adar + 13", "Purim", False), ("adar + 14", "Shushan Purim", False),
        ("nisan + 13", "Eve of Passover", False), ("nisan + 14", "Passover", True), *((f"nisan + {n - 1}", "Middle of Passover", False) for n in range(16, 21)), ("nisan + 20", "Seventh of Passover", True), ("nisan + 26 + CASE (s + nisan + 26 + 4) % 7 WHEN 5 THEN -1 WHEN 0 THEN 1 ELSE 0 END", "Holocaust Day", False),
        ("iyar + 4 + m - 1", "Memorial Day", False), ("iyar + 4 + m", "Independence Day", True), ("iyar + 17", "Lag BaOmer", False), ("iyar + 27", "Jerusalem Day", False), ("iyar + 33", "Eve of Weeks", False), ("iyar + 34", "Weeks", True), ("iyar + 96 + CASE WHEN (s + iyar + 96 + 4) % 7 = 6 THEN 1 ELSE 0 END", "Ninth of Av", False), ("iyar + 146", "Eve of New Year", False)]


@query(f"""WITH y AS (SELECT y, {_start("y")} AS s, {_start("y + 1")} - {_start("y")} AS n FROM (SELECT unnest(range(5750, 5765)) AS y)), a AS (SELECT *, 30 + CASE WHEN n % 10 = 5 THEN 30 ELSE 29 END AS kislev FROM y), b AS (SELECT *, kislev + CASE WHEN n % 10 = 3 THEN 29 ELSE 30 END + 29 AS shevat FROM a),
c AS (SELECT *, shevat + 30 + CASE WHEN n > 355 THEN 30 ELSE 0 END AS adar FROM b), e AS (SELECT *, adar + 29 AS nisan, adar + 59 AS iyar FROM c), f AS (SELECT *, CASE (s + iyar + 4 + 4) % 7 WHEN 5 THEN -1 WHEN 6 THEN -2 WHEN 1 THEN 1 ELSE 0 END AS m FROM e),
h AS (SELECT unnest([{", ".join("{'date': CAST(DATE '1970-01-01' + CAST(s + " + at + " AS INTEGER) AS DATE), 'name': '" + name + "', 'closed': " + str(closed).lower() + "}" for at, name, closed in DAYS)}], recursive := true) FROM f) SELECT date, name, closed, count(o_orderkey) AS orders FROM h LEFT JOIN orders ON CAST(o_orderdate AS DATE) = date WHERE year(date) IN (SELECT DISTINCT year(o_orderdate) FROM orders) GROUP BY date, name, closed""")
def hebrew_holidays(spark, d):
    """Holidays of all years with orders, and the orders of each day."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    per = orders.groupBy("date").agg(F.count(F.lit(1)).alias("orders"))
    days = holidays.holidays(per.select(F.year("date").alias("year")))
    return days.join(per, "date", "left").select("date", "name", "closed", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, event_type AS model, CAST(round(value * 100) AS BIGINT) AS v FROM events), s AS (SELECT month, model, sum(v) AS i, sum(v * 2) AS o, sum(v // 3) AS w, sum(v // 5) AS r FROM e GROUP BY 1, 2)
SELECT month, model, CAST(ceil((i * a * 4 + o * b * 4 + w * a * 5 + r * c * 4) / 4000000) AS BIGINT) AS cost, a IS NOT NULL AS priced FROM s LEFT JOIN (VALUES ('click', 300, 1500, 30), ('view', 1500, 7500, 150)) v(m, a, b, c) ON m = model""")
def token_cost(spark, d):
    v = F.round(F.col("value") * 100).cast("long")
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("model"), v.alias("input"), (v * 2).alias("output"), F.floor(v / 3).alias("cache_write"), F.floor(v / 5).alias("cache_read"))
    return records.token_cost(rows, spark.createDataFrame([("click", 300, 1500, 30), ("view", 1500, 7500, 150)], "model string, p_in long, p_out long, p_read long"))


@query("SELECT count(*) > 0 AS older FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-01 00:03:00', 5000)")
def any_older(spark, d):
    e = table(spark, d, "events").select("ts", "event_id")
    return records.any_older(e, "ts", "event_id", (F.lit("2024-01-01 00:03:00").cast(e.schema["ts"].dataType), 5000))


@query("SELECT event_id, user_id FROM events WHERE contains(lower(props), '7}') AND (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 5000) ORDER BY ts DESC, event_id DESC LIMIT 50")
def found_page(spark, d):
    e = table(spark, d, "events").select("ts", "event_id", "user_id", "props")
    return records.found_page(e, "7}", "props", "ts", "event_id", (F.lit("2024-01-20 00:00:00").cast(e.schema["ts"].dataType), 5000), 50).select("event_id", "user_id")


@query("SELECT event_id, user_id, CASE WHEN user_id % 10 = 3 THEN NULL ELSE coalesce(c_name, 'deleted') END AS label FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0")
def labelled_log(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("user_id") % 10 != 3, F.col("user_id")).alias("case_id"))
    names = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("label"))
    return records.with_labels(e, names, "case_id").select("event_id", "user_id", "label")


@query("""SELECT c.case_id, f.name AS first_name, coalesce(sections, '') AS sections, open FROM (SELECT c_custkey AS case_id FROM customer WHERE c_custkey % 6 <> 0) c LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY 1) f ON f.o_custkey = case_id
LEFT JOIN (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_id % 4 = 0) AS sections, min(event_type) FILTER (event_id % 4 <> 0) AS open FROM events GROUP BY 1) s ON s.user_id = case_id""")
def case_summaries(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 6 == 0).alias("trashed"))
    people = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("rowid"), F.col("o_orderpriority").alias("value"))
    sections = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("section"), (F.col("event_id") % 4 == 0).alias("approved"))
    return records.summaries(cases, people, sections)


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 AND p_partkey > 0 THEN p_partkey - 1 END AS replaces FROM part), u AS (SELECT id, id AS version, replaces, 0 AS at_ FROM n UNION ALL SELECT u.id, n.id, n.replaces, at_ + 1 FROM u JOIN n ON u.replaces = n.id) SELECT id, version, at_ AS "at" FROM u""")
def draft_chain(spark, d):
    key = F.col("p_partkey")
    return records.version_chain(table(spark, d, "part").select(key.alias("id"), F.when((key % 9 != 0) & (key > 0), key - 1).alias("replaces")))


@query(""", s AS (SELECT date, CAST(status = 'held' AS INTEGER) AS h, CAST(status = 'cancelled' AS INTEGER) AS x, CASE WHEN status = 'held' OR (status IN ('cancelled', 'no_show') AND charge_missed) THEN greatest(coalesce(fee, 0), 0) ELSE 0 END AS c, 0 AS r FROM visits UNION ALL SELECT date, 0, 0, amount, 0 FROM charges WHERE NOT voided UNION ALL SELECT date, 0, 0, 0, amount FROM payments WHERE NOT voided)
SELECT CASE WHEN date >= DATE '2000-01-01' THEN 'now' ELSE 'before' END AS stretch, CAST(sum(h) AS BIGINT) AS held, CAST(sum(x) AS BIGINT) AS cancelled, 0 AS no_show, CAST(sum(c) AS BIGINT) AS charged, CAST(sum(r) AS BIGINT) AS received FROM s WHERE date BETWEEN DATE '1999-07-01' AND DATE '2000-06-30' GROUP BY 1""")
def insights_with_preceding(spark, d):
    return insights.with_preceding(visits(spark, d), charges(spark, d), payments(spark, d), "2000-01", "2000-06")


@query("""SELECT method, CAST(sum(amount) AS BIGINT) AS amount, CASE WHEN list_contains(['cash', 'transfer', 'check', 'card'], method) THEN CAST(list_position(['cash', 'transfer', 'check', 'card'], method) AS INTEGER) ELSE 5 END AS place FROM payments WHERE NOT voided GROUP BY 1 HAVING sum(amount) > 0""")
def methods_in_order(spark, d):
    return insights.method_order(payments(spark, d).where("not voided"), ("cash", "transfer", "check", "card"))


@query(f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') || ' [see 12] AB-5.1 and ' || doc_id || ', 3-9.' AS text FROM documents) SELECT id, array_to_string(list_transform(regexp_extract_all(text, '{overlap.NUMBER_PIECES}'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '#' ELSE x END), '') AS text FROM d""")
def numbers_masked(spark, d):
    added = F.concat(F.coalesce("text", F.lit("")), F.lit(" [see 12] AB-5.1 and "), F.col("doc_id").cast("string"), F.lit(", 3-9."))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), overlap.numbers_masked(added).alias("text"))


@query(f"""WITH w AS (SELECT conv_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''))) AS written FROM conversations), g AS (SELECT unnest({[{'g': g, 'written': v} for g, vs in GROUPS.items() for v in vs]}, recursive := true)), h AS (SELECT * FROM (VALUES ('join', 'and'), ('aim', 'for')) v(g, usual))
SELECT DISTINCT id, g AS "group", written, usual FROM w JOIN g USING (written) JOIN h USING (g) WHERE written <> usual""")
def other_terms(spark, d):
    texts = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text")
    return mining.other_terms(texts, GROUPS, spark.createDataFrame([("join", "and"), ("aim", "for")], "group string, variant string")).distinct()


@query("""SELECT o_orderkey AS id, o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM orders""")
def record_order(spark, d):
    o = table(spark, d, "orders")
    setting = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("case_id"), setting.alias("setting"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("date"))
    return schedule.record_order(rows, ["case_id"]).select("id", "case_id", "place")


@query("""SELECT l_orderkey AS material, l_linenumber AS section, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_suppkey % 3 = 0 THEN 'added' WHEN l_linestatus = 'F' AND l_returnflag <> 'A' THEN 'suggested' WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber = 1 THEN 'table' END ELSE 'table' END AS feed FROM lineitem""")
def section_feeds(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.select(
        F.col("l_orderkey").alias("material"), F.col("l_linenumber").alias("section"), (F.col("l_returnflag") == "R").alias("removed"), F.when(F.col("l_suppkey") % 3 == 0, "added").alias("added"), F.when(F.col("l_linestatus") == "F", "suggested").alias("suggested"), F.lit("table").alias("table"), F.when(F.col("l_returnflag") == "A", "prior").otherwise("note").alias("kind"),
    )
    return schedule.feeds(rows, prior_section=1).select("material", "section", "feed")


@query("""SELECT s_suppkey AS id, CASE WHEN length(d) = 10 THEN '+1' || d WHEN length(d) = 11 AND d[1:1] = '1' THEN '+' || d END AS phone, CASE WHEN s_suppkey % 4 <> 0 THEN lower(s_name) || '@example.com' END AS email FROM (SELECT s_suppkey, replace(s_name, '#', '') AS s_name, regexp_replace('(' || (200 + s_suppkey % 700) || ') 555-' || lpad(CAST(s_suppkey AS VARCHAR), 3 + CAST(s_suppkey % 3 AS INTEGER), '0'), '[^0-9]', '', 'g') AS d FROM supplier)""")
def contact_forms(spark, d):
    key = F.col("s_suppkey")
    name = F.replace("s_name", F.lit("#"), F.lit(""))
    phone = F.concat(F.lit("("), (200 + key % 700).cast("string"), F.lit(") 555-"), F.expr("lpad(cast(s_suppkey as string), cast(s_suppkey % 3 as int) + 3, '0')"))
    email = F.when(key % 4 != 0, F.concat(F.lit(" "), name, F.lit("@Example.com"))).otherwise(F.concat(name, F.lit("@@x")))
    return table(spark, d, "supplier").select(key.alias("id"), validation.international_phone(phone).alias("phone"), validation.plain_email(email).alias("email"))


@query(f"""WITH a AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem) SELECT date, CAST(date - DATE '1970-01-01' AS INTEGER) AS day, CAST(date + INTERVAL 18 YEAR AS DATE) AS later FROM a""")
def civil_days(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return rows.select("date", F.unix_date("date").alias("day"), F.add_months("date", 12 * 18).alias("later"))


@query(r"""WITH t AS (SELECT conv_id, turn, 'see ' || role || ' [email_1], 4111 1111 1111 1111 and [strange] x' || conv_id || '@example.com' AS text FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, 'card,email' AS kinds, '[strange]' AS foreign_tags FROM t""")
def scanned_answers(spark, d):
    text_ = F.concat(F.lit("see "), "role", F.lit(" [email_1], 4111 1111 1111 1111 and [strange] x"), F.col("conv_id").cast("string"), F.lit("@example.com"))
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", text_.alias("text"))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(privacy.kinds_found(F.col("text"))), ",").alias("kinds"), F.array_join(privacy.foreign_tags(F.col("text"), F.array(F.lit("[email_1]"))), ",").alias("foreign_tags"))


@query(f"""WITH k AS (SELECT doc_id AS query_id, doc_id % 50 AS doc_id, ((doc_id * 37) % 101) / 10 AS score, n_chars // 6 AS n_words, lang = 'en' AS same_section FROM documents), s AS (SELECT query_id % 20 AS query_id, doc_id, max(score * CASE WHEN same_section THEN 1.5 ELSE 1 END) AS score FROM k WHERE n_words >= 8 AND score > 0 GROUP BY 1, 2)
SELECT query_id, arg_min(doc_id, (-round(score, 6), doc_id)) AS doc_id FROM s GROUP BY 1""")
def closest_passages(spark, d):
    key = F.col("doc_id")
    rows = table(spark, d, "documents").select((key % 20).alias("query_id"), (key % 50).alias("doc_id"), (F.pmod(key * 37, F.lit(101)) / 10).alias("score"), F.floor(F.col("n_chars") / 6).alias("n_words"), (F.col("lang") == "en").alias("same_section"))
    return text.closest(rows)


@query("SELECT patient_id, count(*) AS open FROM tasks WHERE done_on IS NULL AND patient_id IN (SELECT id FROM patients WHERE status = 'active') GROUP BY 1")
def open_task_counts(spark, d):
    active = patients(spark, d).where("status = 'active'").select(F.col("id").alias("patient_id"))
    return tasks(spark, d).where("done_on is null").join(active, "patient_id", "left_semi").groupBy("patient_id").agg(F.count(F.lit(1)).alias("open"))


@query(r"""SELECT conv_id, turn, array_to_string(list_transform([CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), coalesce(role, ''), CASE WHEN regexp_matches(coalesce(text, ''), '^[=+\-@\t\r]') THEN chr(39) || text ELSE coalesce(text, '') END], lambda t: CASE WHEN regexp_matches(t, '[,"\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END), ',') AS line FROM conversations""")
def csv_lines(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", csv.line_of(c.columns).alias("line"))
