"""Queries over ordered lists, marks, pathways, routing and normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import lists, privacy, schedule, style
from quillspark.operators.text import words
from quillspark.plans.registry import STYLED, WORDS, _styled, query
from quillspark.sources.records import charges, notes, payments, reports, table, tasks, visits


@query("SELECT o_orderkey AS id, case_id, o_orderdate AS updated FROM (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS case_id FROM orders) WHERE case_id IS NULL OR case_id IN (SELECT c_custkey FROM customer WHERE c_nationkey % 4 <> 1)")
def consultations(spark, d):
    talks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("case_id"), F.col("o_orderdate").alias("updated"))
    return lists.consultations(talks, table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_nationkey") % 4 == 1).alias("trashed")))


@query("SELECT count(*) AS n FROM events JOIN customer ON c_custkey = user_id WHERE ts >= TIMESTAMP '2024-01-10' AND c_nationkey % 4 <> 1 AND c_custkey % 13 <> 0")
def sent_since(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_nationkey") % 4 == 1).alias("trashed"), (F.col("c_custkey") % 13 == 0).alias("invented"))
    return lists.sent_since(table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("ts").alias("at")), cases, "2024-01-10 00:00:00")


@query("SELECT DISTINCT user_id AS case_id, event_type AS section FROM events WHERE event_id % 4 = 0")
def approved_sections(spark, d):
    return table(spark, d, "events").where("event_id % 4 = 0").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("section")).distinct()


@query("SELECT l_orderkey AS k, l_returnflag AS section, max(l_linenumber) + 1 AS position FROM lineitem GROUP BY 1, 2")
def next_positions(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("position"))
    return lists.next_positions(rows, ["k", "section"])


@query("SELECT case_id, id, role, '[' || role || CASE WHEN role = 'O' AND n = 1 THEN '' ELSE '_' || n END || ']' AS tag FROM (SELECT o_custkey AS case_id, o_orderkey AS id, o_orderstatus AS role, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)")
def assigned_tags(spark, d):
    people = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("role"))
    return lists.assigned_tags(people, ("O",))


@query("""WITH t AS (SELECT user_id AS key, event_id AS at_, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 7) SELECT key, at_ AS "at", CAST(row_number() OVER (PARTITION BY key ORDER BY at_) AS INTEGER) AS place FROM t""")
def best_in_order(spark, d):
    return lists.best(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("value").alias("score")), "key", 7)


@query("SELECT p_partkey AS id, p_size % 3 = 0 AS decided, p_size AS n FROM part ORDER BY p_size % 3 = 0 DESC, p_size DESC, p_partkey LIMIT 500")
def trimmed_patterns(spark, d):
    return lists.trimmed(table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3 == 0).alias("decided"), F.col("p_size").alias("n")), 500)


MARKS = [("the of", "of the", 0.9), ("and", "", 0.8), ("with the", "by the", 0.7), ("for", "to", 0.65), ("en les", "les", 0.6), ("la", "le", 0.55), ("und", "", 0.5), ("der", "", 0.45), ("la", "x", 0.1)]


@query(f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in MARKS[:-1])}) v(phrase, instead, sure)), w AS (SELECT conv_id * 100 + turn AS id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS line FROM conversations)
SELECT id, phrase, instead, CAST(r AS INTEGER) AS rank FROM (SELECT id, phrase, instead, row_number() OVER (PARTITION BY id ORDER BY sure DESC, phrase) AS r FROM w JOIN p ON contains(line, ' ' || phrase || ' ')) WHERE r <= 5""")
def edit_marks(spark, d):
    texts = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return lists.marks(texts, spark.createDataFrame(MARKS, "phrase string, instead string, sure double"))


@query(f"""WITH p AS (SELECT DISTINCT phrase FROM (VALUES {", ".join(f"('{a}')" for a, _, _ in MARKS)}) v(phrase)), w AS (SELECT conv_id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS line FROM conversations) SELECT phrase, count(*) FILTER (conv_id % 3 = 0) AS exposed, count(*) AS "all" FROM w JOIN p ON contains(line, ' ' || phrase || ' ') GROUP BY 1""")
def pattern_exposures(spark, d):
    texts = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", (F.col("conv_id") % 3 == 0).alias("approved"))
    return lists.exposures(texts, spark.createDataFrame(MARKS, "phrase string, instead string, sure double"))


@query("SELECT conv_id AS id, string_agg(coalesce(text, ''), chr(10) || '--' || chr(10) ORDER BY turn) AS text, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS found FROM conversations GROUP BY 1")
def joined_outcomes(spark, d):
    body = F.coalesce("text", F.lit(""))
    return lists.joined(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), body.alias("text"), F.length(body).cast("long").alias("found")), "\n--\n")


@query(""", days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1999-05-01', TIMESTAMP '1999-08-31', INTERVAL 1 DAY)) AS DATE) AS date), grid AS (SELECT date, CAST(s AS INTEGER) AS start FROM days, (SELECT unnest(range(480, 1021, 15)) AS s) WHERE dayofweek(date) <= 4),
free AS (SELECT date, min(start) AS start FROM grid g WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.status <> 'cancelled' AND v.date = g.date AND g.start < v.start + v.minutes AND v.start < g.start + 60) GROUP BY 1),
p AS (SELECT id, DATE '1999-05-01' + CAST(id % 60 AS INTEGER) AS d FROM patients), a AS (SELECT id, (SELECT min(date) FROM free WHERE date >= d) AS d0 FROM p), b AS (SELECT *, (SELECT min(date) FROM free WHERE date >= d0 + 7) AS d1 FROM a), c AS (SELECT *, (SELECT min(date) FROM free WHERE date >= d1 + 14) AS d2 FROM b)
SELECT id, step, x.date AS date, start FROM (SELECT id, 0 AS step, d0 AS date FROM c UNION ALL SELECT id, 1, d1 FROM c UNION ALL SELECT id, 2, d2 FROM c) x LEFT JOIN free f ON f.date = x.date""")
def proposed_pathways(spark, d):
    free = schedule.free_on_grid(schedule.working_days(spark, "1999-05-01", "1999-08-31", (1, 2, 3, 4, 5)), visits(spark, d), 480, 1080, 60)
    starts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.date_add(F.lit("1999-05-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).alias("date"))
    return lists.pathways(starts, free, (0, 7, 14))


@query("""WITH i AS (SELECT p_partkey AS id, p_brand AS scope, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'x' || (p_partkey % 7) END AS pattern, p_retailprice AS score FROM part) SELECT id, scope, kind, CAST(row_number() OVER (PARTITION BY scope, kind ORDER BY score DESC, id) AS INTEGER) AS rank FROM i WHERE pattern IS NULL OR pattern IN ('x1', 'x4') QUALIFY rank <= 4""")
def focused_items(spark, d):
    key = F.col("p_partkey")
    items = table(spark, d, "part").select(key.alias("id"), F.col("p_brand").alias("scope"), F.col("p_type").alias("kind"), F.when(key % 3 == 0, F.concat(F.lit("x"), (key % 7).cast("string"))).alias("pattern"), F.col("p_retailprice").alias("score"))
    return lists.focus(items, spark.createDataFrame([("x1",), ("x4",)], "pattern string"), 4)


@query(f"""WITH s AS (SELECT doc_id AS id, unnest(string_split_regex(text, '[.!?\\n]+')) AS raw, unnest(range(0, len(string_split_regex(text, '[.!?\\n]+')))) AS at_ FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), t AS (SELECT id, at_, trim(raw) AS sentence, {WORDS.replace("text", "raw")} AS w FROM s),
g AS (SELECT m AS measure, sentence, min((id, at_)) AS x FROM t, (SELECT unnest([{{'m': 'a', 'word': 'the'}}, {{'m': 'b', 'word': 'und'}}], recursive := true)) WHERE list_contains(w, word) GROUP BY 1, 2) SELECT measure, sentence, CAST(row_number() OVER (PARTITION BY measure ORDER BY x, sentence) AS INTEGER) AS rank FROM g QUALIFY rank <= 8""")
def grouped_sentences(spark, d):
    return lists.sentences_of(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), {"a": "the", "b": "und"})


@query(f"""WITH a AS (SELECT item_id AS id, unnest(list_distinct({WORDS})) AS word FROM benchmark), b AS (SELECT conv_id * 100 + turn AS at_, unnest(list_distinct({WORDS})) AS word FROM conversations), s AS (SELECT id, at_, count(*) AS shared FROM a JOIN b USING (word) GROUP BY 1, 2)
SELECT id, at_ AS "at", shared, CAST(row_number() OVER (PARTITION BY id ORDER BY shared DESC, at_) AS INTEGER) AS rank FROM s""")
def ranked_candidates(spark, d):
    b = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("at"), "text")
    return lists.ranked(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), b)


@query("""WITH p AS (SELECT l_orderkey AS material, l_linenumber AS at_ FROM lineitem GROUP BY ALL), a AS (SELECT DISTINCT l_orderkey AS material, l_linenumber AS at_, l_returnflag AS section FROM lineitem WHERE l_suppkey % 3 = 0), g AS (SELECT material, section, string_agg(DISTINCT at_, ',' ORDER BY at_) AS passages FROM a GROUP BY 1, 2)
SELECT n.material, section, passages, section IS NULL AND n.n >= 3 AS needs_sorting FROM (SELECT material, count(*) AS n FROM p GROUP BY 1) n LEFT JOIN g ON g.material = n.material""")
def material_routing(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("material"), F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("section"), "l_suppkey")
    return lists.routing(line.select("material", "at").distinct(), line.where("l_suppkey % 3 = 0").select("material", "at", "section"), 3)


@query("""SELECT patient_id, count(*) FILTER (k = 'v') AS visits, count(*) FILTER (k = 'c') AS charges, count(*) FILTER (k = 'p') AS payments, count(*) FILTER (k = 'n') AS notes, count(*) FILTER (k = 't') AS tasks, count(*) FILTER (k = 'r') AS reports FROM (SELECT patient_id, 'v' AS k FROM visits UNION ALL SELECT patient_id, 'c' FROM charges UNION ALL SELECT patient_id, 'p' FROM payments
UNION ALL SELECT patient_id, 'n' FROM notes UNION ALL SELECT patient_id, 't' FROM tasks UNION ALL SELECT patient_id, 'r' FROM reports) WHERE patient_id IS NOT NULL GROUP BY 1""")
def records_by_patient(spark, d):
    return lists.record_counts(visits=visits(spark, d), charges=charges(spark, d), payments=payments(spark, d), notes=notes(spark, d), tasks=tasks(spark, d), reports=reports(spark, d))


@query("SELECT count(DISTINCT l_orderkey) AS reports, count(*) AS scores, count(*) FILTER (l_suppkey % 12 = 0) >= 0.1 * count(*) AS prints FROM lineitem")
def sheet_habits(spark, d):
    return lists.sheet_habits(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), (F.col("l_suppkey") % 12 == 0).alias("near")))


@query(f"""{STYLED}, e AS (SELECT feature, sum(n * mean) / sum(n) AS am, sum(n * sd) / sum(n) AS asd FROM m GROUP BY 1), b AS (SELECT section, feature, (n * mean + 8 * am) / (n + 8) AS mm, (n * sd + 8 * asd) / (n + 8) AS ss FROM m JOIN e USING (feature))
SELECT id, feature, round(z, 3) AS z FROM (SELECT id, feature, (x - mm) / greatest(ss, 0.5) AS z FROM f JOIN b USING (section, feature)) WHERE abs(z) >= 2""")
def style_outliers(spark, d):
    measured = _styled(spark, d)
    return lists.outliers(measured, style.moments(measured), 2.0).withColumn("z", F.round("z", 3))


@query(r"""SELECT p_partkey AS id, trim(regexp_replace(translate('mr "' || lower(p_name) || '" – ete', '–', '-'), '[ \t\r\n-]+', ' ', 'g')) AS text FROM part""")
def normal_forms(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), lists.normal(F.concat(F.lit("Мr “"), "p_name", F.lit("” – Été"))).alias("text"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, least(levenshtein(a.s_name, b.s_name), 3) AS distance FROM supplier a JOIN supplier b ON a.s_suppkey + 7 = b.s_suppkey")
def capped_distances(spark, d):
    s = table(spark, d, "supplier")
    both = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 7).alias("b"), F.col("s_name").alias("x")).join(s.select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("y")), "b")
    return both.select("a", "b", lists.capped_distance(F.col("x"), F.col("y"), 2).alias("distance"))


@query("SELECT DISTINCT c_nationkey AS id, sha256('key' || lower(c_mktsegment)) AS hash FROM customer")
def hashed_names(spark, d):
    return lists.hashed_names(table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("name")), "key")


@query("""SELECT event_id AS id, unnest(['k', trim(regexp_extract(props, ': *([0-9]+)', 1))]) AS string FROM events WHERE event_id % 5 <> 0""")
def json_strings(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 != 0, F.col("props")).otherwise("no object").alias("json"))
    return lists.strings(e)


@query("SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'industry' WHEN 'FURNITURE' THEN 'crafts' WHEN 'HOUSEHOLD' THEN 'home' ELSE 'work' END AS field FROM customer")
def general_jobs(spark, d):
    fields = spark.createDataFrame([("MACHINERY", "industry"), ("FURNITURE", "crafts"), ("HOUSEHOLD", "home")], "job string, field string")
    return lists.generalized(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("job")), fields)


@query(f"""WITH w AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), e AS (SELECT id, unnest(w) AS word, unnest(range(0, len(w))) AS at_ FROM w), n AS (SELECT DISTINCT id, unnest(w[1:2]) AS word FROM w WHERE len(w) > 0) SELECT e.id, e.word, CAST(at_ AS INTEGER) AS "at" FROM e JOIN n ON e.id = n.id AND e.word = n.word WHERE length(e.word) >= 2""")
def recurring_names(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    names = docs.select("id", F.array_join(F.slice(words("text"), 1, 2), " ").alias("name"))
    return lists.recurring(docs, names)


@query(r"""SELECT s_suppkey AS id, s_suppkey % 3 <> 2 AS labelled FROM supplier""")
def id_labels(spark, d):
    key = F.col("s_suppkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("ID no. "), F.lpad(key.cast("string"), 9, "0"))).when(key % 3 == 1, F.concat(F.lpad(key.cast("string"), 9, "0"), F.lit(" (passport)"))).otherwise(F.concat(F.lit("idea "), F.lpad(key.cast("string"), 9, "0")))
    return table(spark, d, "supplier").select(key.alias("id"), privacy.id_label_near(text).alias("labelled"))


@query(r"""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '1998' WHEN 1 THEN '' ELSE '2005' END AS kept FROM customer""")
def years_in_context(spark, d):
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, "score 2010 in 1998").when(key % 3 == 1, "2001 cm and 1999 mg").otherwise("in 2005")
    return table(spark, d, "customer").select(key.alias("id"), F.array_join(privacy.bare_years(text), ",").alias("kept"))
