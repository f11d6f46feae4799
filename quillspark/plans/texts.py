"""Queries over texts: overlap with a corpus, checks, model answers, scores read from texts, mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import checks, mining, overlap, scores, text
from quillspark.plans.registry import SHEETS, WORDS, _sheets, query
from quillspark.sources.records import table

NUMBER = r"[0-9]+(?:[.:][0-9]+)*"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


RUNS = """list_transform(range(1, len(w) - {} + 2), lambda i: array_to_string(w[i:i + {} - 1], ' '))"""


def _runs(n: int) -> str:
    return RUNS.format(n, n)


@query(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id AS id, {WORDS} AS w FROM benchmark), g AS (SELECT DISTINCT doc_id % 300 AS child, unnest({_runs(8)}) AS run FROM d WHERE len(w) >= 8), i AS (SELECT run FROM g GROUP BY 1 HAVING count(*) < 3),
t AS (SELECT id, unnest({_runs(8)}) AS run, unnest(range(0, len(w) - 7)) AS at_ FROM b WHERE len(w) >= 8) SELECT id, arg_min(run, at_) AS run FROM t WHERE run IN (SELECT run FROM i) GROUP BY 1""")
def overlap_warnings(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    reports = table(spark, d, "documents").select((F.col("doc_id") % 300).alias("child"), "text")
    return overlap.overlap_warnings(items, reports)


@query(f"""WITH d AS (SELECT conv_id AS child, {WORDS} AS w FROM conversations), g AS (SELECT DISTINCT child, unnest({_runs(4)}) AS run FROM d WHERE len(w) >= 4) SELECT run FROM g GROUP BY 1 HAVING count(*) < 3""")
def source_index(spark, d):
    return overlap.source_index(table(spark, d, "conversations").select(F.col("conv_id").alias("child"), "text"), 4)


@query(f"""WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), b AS (SELECT {WORDS} AS w FROM benchmark), i AS (SELECT DISTINCT unnest({_runs(5)}) AS run FROM b WHERE len(w) >= 5), t AS (SELECT id, unnest({_runs(5)}) AS run, unnest(range(0, len(w) - 4)) AS at_ FROM d WHERE len(w) >= 5)
SELECT id, CAST(min(at_) AS INTEGER) AS "at", arg_min(run, at_) AS run FROM t WHERE run IN (SELECT run FROM i) GROUP BY 1""")
def shared_runs(spark, d):
    index = overlap.runs(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 5).select("run").distinct()
    return overlap.shared_runs(_docs(spark, d), index, 5)


ITEMS = f"""items AS (SELECT conv_id * 100 + turn AS id, role AS kind, list_sort(list_distinct({WORDS})) AS w FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id + 100000, turn, role, text || ' ' || role || ' added' FROM conversations WHERE conv_id % 3 = 0))"""


@query(f"""WITH {ITEMS} SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.kind = b.kind AND a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9""")
def similar_items(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    more = c.where("conv_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" "), "role", F.lit(" added"))).withColumn("conv_id", F.col("conv_id") + 100_000)
    items = c.unionByName(more).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("kind"), "text")
    return overlap.similar_items(items)


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment IS NULL OR c_custkey % 5 = 0 THEN c_custkey ELSE min(c_custkey) FILTER (c_custkey % 5 <> 0) OVER (PARTITION BY c_mktsegment || c_nationkey) END AS \"group\" FROM customer")
def child_groups(spark, d):
    child = F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    return overlap.child_groups(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), child.alias("child")))


HEADINGS = {"background": ["the", "le"], "results": ["and", "und", "et"], "summary": ["of", "de"]}
LINES = f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS at_ FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
k AS (SELECT id, at_, line, CASE WHEN length(trim(line)) BETWEEN 2 AND 70 AND NOT ends_with(trim(line), '.') AND len(string_split_regex(trim(line), '[ \\t]+')) <= CASE WHEN ends_with(trim(line), ':') THEN 9 ELSE 6 END
  THEN coalesce({"".join(f"CASE WHEN list_has_any({WORDS.replace('text', 'line')}, {some}) THEN '{key}' END, " for key, some in HEADINGS.items())}CASE WHEN ends_with(trim(line), ':') THEN 'other' END) END AS key FROM l)"""


@query(f"{LINES} SELECT id, CAST(at_ AS INTEGER) AS \"at\", key FROM k WHERE key IS NOT NULL")
def heading_keys(spark, d):
    lines = _docs(spark, d).select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return lines.withColumn("key", overlap.heading(F.col("line"), HEADINGS)).where("key is not null").select("id", "at", "key")


@query(f"""{LINES}, c AS (SELECT *, sum(CAST(key IS NOT NULL AS INTEGER)) OVER (PARTITION BY id ORDER BY at_) AS cut FROM k), b AS (SELECT id, cut, nullif(max(key), 'other') AS section, string_agg(line, chr(10) ORDER BY at_) FILTER (key IS NULL) AS text FROM c GROUP BY 1, 2), f AS (SELECT * FROM b WHERE trim(regexp_replace(text, '[\\n\\t\\r]+', ' ', 'g')) <> ''),
n AS (SELECT *, CASE WHEN section IS NOT NULL AND lag(section) OVER (PARTITION BY id ORDER BY cut) = section THEN 0 ELSE 1 END AS new FROM f), p AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY cut ROWS UNBOUNDED PRECEDING) - 1 AS part FROM n)
SELECT id, CAST(part AS BIGINT) AS part, arg_min(section, cut) AS section, trim(string_agg(text, chr(10) ORDER BY cut)) AS text FROM p GROUP BY id, part""")
def heading_sections(spark, d):
    return overlap.parts(_docs(spark, d), HEADINGS)


FEATURES = "list_distinct([c_mktsegment, 'n' || c_nationkey, 'k' || (c_custkey % 23)])"


@query(f"""WITH f AS (SELECT c_custkey AS id, {FEATURES} AS f FROM customer), p AS (SELECT a.id AS case_id, b.id AS report_id, round(len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f))), 6) AS score, array_to_string(list_sort(list_intersect(a.f, b.f)), ',') AS shared FROM f a JOIN f b ON a.id % 20 = 0 AND b.id % 20 <> 0 AND list_has_any(a.f, b.f))
SELECT case_id, report_id, CAST(rank AS INTEGER) AS rank, score, score >= 0.3 AS similar, shared FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, report_id) AS rank FROM p) WHERE rank <= 3""")
def section_library(spark, d):
    key = F.col("c_custkey")
    f = F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("k"), (key % 23).cast("string")))
    rows = table(spark, d, "customer").select(key.alias("id"), f.alias("features"))
    return overlap.library(rows.where("id % 20 = 0"), rows.where("id % 20 <> 0"))


@query(f"""WITH a AS (SELECT item_id AS id, unnest(list_distinct({WORDS})) AS word FROM benchmark), b AS (SELECT conv_id AS source, turn AS at_, unnest(list_distinct({WORDS})) AS word FROM conversations), s AS (SELECT id, source, at_, count(*) AS shared FROM a JOIN b USING (word) GROUP BY ALL),
n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY shared DESC, at_) <= 3), m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, source, at_) <= 6)
SELECT id, source, at_ AS "at", shared FROM m UNION ALL SELECT item_id, (SELECT min((conv_id, turn)) FROM conversations)[1], (SELECT min((conv_id, turn)) FROM conversations)[2], 0 FROM benchmark WHERE item_id NOT IN (SELECT id FROM m)""")
def paragraph_sources(spark, d):
    passages = table(spark, d, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("at"), "text")
    return overlap.sources(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), passages)


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS at_, CAST(l_quantity AS BIGINT) AS n, CASE WHEN l_returnflag = 'A' THEN 0 ELSE round(l_extendedprice, 2) END AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
g AS (SELECT id, list({'s': -score, 'p': at_, 'n': n} ORDER BY -score, at_) FILTER (score > 0) AS o, list(at_) AS every_ FROM s GROUP BY 1),
r AS (SELECT id, every_, o, list_reduce(list_transform(o, lambda x: {'used': x.n, 'out': [x.p], 'n': x.n, 'p': x.p}), lambda a, x: CASE WHEN a.used + x.n <= 60 THEN {'used': a.used + x.n, 'out': list_append(a.out, x.p), 'n': x.n, 'p': x.p} ELSE a END) AS z FROM g)
SELECT id, unnest(CASE WHEN o IS NULL THEN every_ ELSE z.out END)::BIGINT AS "at" FROM r""")
def within_words(spark, d):
    line = table(spark, d, "lineitem")
    first = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_extendedprice")).alias("x"))
    score = F.when(F.col("x.l_returnflag") == "A", 0.0).otherwise(F.round("x.l_extendedprice", 2))
    rows = first.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), F.col("x.l_quantity").cast("long").alias("n"), score.alias("score"))
    return overlap.within_words(rows, 60)


@query("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS at_ FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
c AS (SELECT *, trim(line) = '' AS blank, sum(CAST(coalesce(ends, true) AS INTEGER)) OVER (PARTITION BY id ORDER BY at_) AS cut FROM (SELECT *, lag(trim(line) = '' OR regexp_matches(rtrim(line), '[.!?:]$')) OVER (PARTITION BY id ORDER BY at_) AS ends FROM l)),
n AS (SELECT *, (row_number() OVER (PARTITION BY id, cut ORDER BY at_) - 1) // 12 AS nth FROM c WHERE NOT blank), g AS (SELECT id, min(at_) AS first, max(at_) AS last, string_agg(line, chr(10) ORDER BY at_) AS text FROM n GROUP BY id, cut, nth)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY first) - 1 AS INTEGER) AS passage, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, text FROM g""")
def passages(spark, d):
    return overlap.passages(_docs(spark, d))


@query("""SELECT id, CAST(at_ AS INTEGER) AS "at", line FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS at_ FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) WHERE len(list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda x: x <> '')) >= 12""")
def paragraphs(spark, d):
    return overlap.paragraphs(_docs(spark, d))


# ---------------------------------------------------------------- checks
DATED = r"""x AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || chr(10) || 'seen 3.9.2020 and 12/11/2019' || chr(10) || 'born 5.6.2030' WHEN 1 THEN 'on 2021-02-28, 2021-02-30' || chr(10) || coalesce(text, '') ELSE text END AS text FROM documents)"""


def _dated(spark, d):
    body, k = F.coalesce("text", F.lit("")), F.col("id") % 4
    return _docs(spark, d).withColumn("text", F.when(k == 0, F.concat(body, F.lit("\nseen 3.9.2020 and 12/11/2019\nborn 5.6.2030"))).when(k == 1, F.concat(F.lit("on 2021-02-28, 2021-02-30\n"), body)).otherwise(F.col("text")))


@query(rf"""WITH {DATED}, l AS (SELECT id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(lower(x), 'born|birth|dob')), chr(10)) AS t FROM x),
e AS (SELECT id, try_strptime(replace(m, '/', '.'), '%d.%m.%Y') AS day FROM (SELECT id, unnest(regexp_extract_all(t, '(?:^|[^0-9.])([0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}})', 1)) AS m FROM l) UNION ALL SELECT id, try_strptime(m, '%Y-%m-%d') FROM (SELECT id, unnest(regexp_extract_all(t, '(?:^|[^0-9-])([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1)) AS m FROM l))
SELECT id, CAST(max(day) FILTER (year(day) BETWEEN 1900 AND 2100) AS DATE) AS date FROM (SELECT id, NULL AS day FROM x UNION ALL SELECT id, day FROM e) GROUP BY id""")
def document_dates(spark, d):
    return _dated(spark, d).select("id", checks.document_date(F.col("text")).alias("date"))


KINDS = {"report": ["that", "nicht"], "letter": ["with", "pour"]}


@query(f"""WITH h AS (SELECT doc_id AS id, lower(left(coalesce(text, ''), 800)) AS s FROM documents), t AS (SELECT id, list_filter(string_split_regex(s, '[^a-zà-ÿ]+'), lambda x: x <> '') AS w, list_filter(string_split_regex(s, '[ \\t\\r\\n]+'), lambda x: x <> '') AS k FROM h)
SELECT id, CASE WHEN list_has_any(w, ['that', 'nicht']) THEN 'report' WHEN list_has_any(w, ['with', 'pour']) THEN 'letter' WHEN len(list_filter(k, lambda x: regexp_matches(x, '^[0-9.,:/%-]+$'))) * 5 > len(k) THEN 'table' ELSE 'other' END AS kind FROM t""")
def guessed_kinds(spark, d):
    return _docs(spark, d).select("id", checks.guess(F.col("text"), KINDS).alias("kind"))


SLIPPED = """x AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN coalesce(text, '') || ' the the end (a) (b' WHEN 1 THEN 'TODO ' || coalesce(text, '') || ' x)' WHEN 2 THEN 'this  is it , so {name} there' WHEN 3 THEN 'a line without a mark' ELSE coalesce(text, '') END AS t FROM conversations)"""


@query(rf"""WITH {SLIPPED}, k AS (SELECT *, list_filter(string_split_regex(t, '[ \t\r\n]+'), lambda x: x <> '') AS w, regexp_extract_all(t, '[()]') AS b, string_split_regex(regexp_replace(t, '([0-9])\.([0-9])', '\1,\2', 'g'), '[.!?\n]') AS s FROM x),
d AS (SELECT *, len(list_filter(range(1, len(w)), lambda i: lower(w[i]) = lower(w[i + 1]) AND regexp_matches(w[i], '^[A-Za-z]+$'))) > 0 AS doubled, list_reduce(list_prepend({{'o': 0, 's': 0, 'x': ''}}, list_transform(b, lambda y: {{'o': 0, 's': 0, 'x': y}})), lambda a, y: {{'o': a.o + CASE WHEN y.x = '(' THEN 1 WHEN a.o > 0 THEN -1 ELSE 0 END, 's': a.s + CASE WHEN y.x = ')' AND a.o = 0 THEN 1 ELSE 0 END, 'x': ''}}) AS z FROM k)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(t, '\{{[^{{}}\n]*\}}|(^|[^A-Za-z])(X{{3,}}|x{{3,}}|TODO)([^A-Za-z]|$)|\?\?\?') THEN 'placeholder' END, CASE WHEN doubled THEN 'doubled_word' END, CASE WHEN regexp_matches(t, '[A-Za-z,;]  +[A-Za-z]| [,;.!?]( |$)') THEN 'spacing' END,
  CASE WHEN z.o > 0 THEN 'bracket_open' END, CASE WHEN z.s > 0 THEN 'bracket_closed' END, CASE WHEN len(list_filter(s, lambda y: len(list_filter(string_split_regex(y, '[ \t\r\n]+'), lambda v: regexp_matches(v, '[A-Za-z0-9]'))) > 45)) > 0 THEN 'long_sentence' END,
  CASE WHEN NOT contains(trim(t), chr(10)) AND len(list_filter(string_split_regex(trim(t), '[ \t\r\n]+'), lambda y: y <> '')) >= 4 AND NOT regexp_matches(trim(t), '[.:?!)\]"''»…]$') AND NOT regexp_matches(trim(t), '^([-–•*]|[0-9]{{1,2}}[.)]) ') THEN 'unfinished' END], lambda y: y IS NOT NULL), ',') AS notes FROM d""")
def polish_notes(spark, d):
    k, body = F.col("conv_id") % 5, F.coalesce("text", F.lit(""))
    t = F.when(k == 0, F.concat(body, F.lit(" the the end (a) (b"))).when(k == 1, F.concat(F.lit("TODO "), body, F.lit(" x)"))).when(k == 2, "this  is it , so {name} there").when(k == 3, "a line without a mark").otherwise(body)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(checks.polish_notes(t), ",").alias("notes"))


@query("""SELECT e.event_id AS id, CAST(n AS INTEGER) AS nth, CASE WHEN n = 0 AND e.event_id % 7 < 5 THEN 1 ELSE 0 END AS cited, CASE WHEN n = 0 AND e.event_id % 7 >= 5 THEN 's' || (e.event_id % 7) ELSE '' END AS unknown, CASE WHEN n = 0 THEN '12' ELSE CASE WHEN e.event_id % 3 = 0 THEN '' ELSE '5:4' END END AS uncited FROM events e, (SELECT unnest([0, 1]) AS n) WHERE e.event_id % 11 <> 0""")
def cited_paragraphs(spark, d):
    key = F.col("event_id")
    good = F.concat(F.lit('{"paragraphs":[{"text":"p 12","sources":["s'), (key % 7).cast("string"), F.lit('"]},{"text":"q 5:4","sources":[]}]}'))
    answers = table(spark, d, "events").select(key.alias("id"), F.when(key % 11 == 0, "no json").otherwise(good).alias("json"))
    told = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("s"), i.cast("string"))))
    sources = table(spark, d, "events").select(key.alias("id"), told.alias("source")).withColumn("text", F.when(F.col("id") % 3 == 0, "mean 5:4").otherwise("none"))
    return checks.cited_paragraphs(answers, sources)


@query("""WITH a AS (SELECT l_orderkey AS material, l_linenumber AS passage, l_returnflag AS section FROM lineitem) SELECT material, CAST(count(DISTINCT (passage, section)) FILTER (passage < material % 5 AND section <> 'N') AS BIGINT) AS kept, CAST(count(*) FILTER (NOT (passage < material % 5 AND section <> 'N')) AS BIGINT) AS ignored FROM a GROUP BY 1""")
def sorted_passages(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("material"), F.col("l_linenumber").alias("passage"), F.col("l_returnflag").alias("section"))
    materials = a.select("material").distinct().withColumn("n_passages", (F.col("material") % 5).cast("int"))
    kept, ignored = checks.sorted_passages(a, materials, spark.createDataFrame([("A",), ("R",)], "section string"))
    n = kept.groupBy("material").agg(F.count(F.lit(1)).alias("kept"))
    return ignored.join(n, "material", "left").select("material", F.coalesce("kept", F.lit(0)).alias("kept"), "ignored")


@query("""WITH s AS (SELECT CAST(o_orderkey AS INTEGER) AS nth, o_orderkey AS paragraph FROM orders), a AS (SELECT o_orderkey AS paragraph, CASE o_orderkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' ELSE 'maybe' END AS verdict, ['s' || (o_orderkey % 9), 's1'] AS src FROM orders WHERE o_orderkey % 5 <> 0)
SELECT nth, s.paragraph, CASE WHEN verdict IN ('supported', 'unsupported') THEN verdict ELSE 'unchecked' END AS verdict, coalesce(array_to_string(list_sort(list_distinct(list_filter(src, lambda x: x IN ('s1', 's2', 's3')))), ','), '') AS sources FROM s LEFT JOIN a USING (paragraph)""")
def verdicts(spark, d):
    key = F.col("o_orderkey")
    o = table(spark, d, "orders")
    sent = o.select(key.cast("int").alias("nth"), key.alias("paragraph"))
    verdict = F.when(key % 4 == 0, "supported").when(key % 4 == 1, "unsupported").otherwise("maybe")
    answers = o.where("o_orderkey % 5 <> 0").select(key.alias("paragraph"), verdict.alias("verdict"), F.array(F.concat(F.lit("s"), (key % 9).cast("string")), F.lit("s1")).alias("sources"))
    return checks.verdicts(sent, answers, spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source string"), ("supported", "unsupported"))


@query("""SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, v) - 1 AS INTEGER) AS nth, 'test' || l_linenumber AS instrument, 'm_1' AS measure, v AS value FROM (SELECT l_orderkey, l_linenumber, l_quantity / 2 AS v FROM lineitem)""")
def tagged_scores(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2).alias("v"))
    tags = line.withColumn("tag", checks.score_tag(F.concat(F.lit("test"), F.col("l_linenumber").cast("string")), F.lit("m_1"), F.col("v")))
    texts = tags.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "v", "tag"))), lambda x: x["tag"]), " said ").alias("text"))
    return checks.tagged_scores(texts)


# ---------------------------------------------------------------- scores
@query(f"""{SHEETS} SELECT DISTINCT value, CASE WHEN CAST(value AS INTEGER) % 5 = 0 THEN 0.5 ELSE 1.0 END AS step, CASE CAST(value AS INTEGER) % 3 WHEN 0 THEN abs(value - 100) >= 10 WHEN 1 THEN abs(value - 100) >= 3 ELSE false END AS notable FROM sheets""")
def score_steps(spark, d):
    v = F.col("value").cast("int")
    rows = _sheets(spark, d).select("value").distinct()
    scale = F.when(v % 3 == 0, "standard").when(v % 3 == 1, "scaled").otherwise("raw")
    return rows.select("value", scores.score_step(F.when(v % 5 == 0, "cars").otherwise("standard")).alias("step"), scores.notable(scale, F.col("value") - 100).alias("notable"))


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'set' || (l_suppkey % 4) AS s, 'm' || (l_partkey % 50) AS m, l_discount * 30 - 0.5 + CASE WHEN l_linenumber = 3 THEN 0.001 ELSE 0 END AS value FROM lineitem), f AS (SELECT s, m, min(id) AS first FROM v GROUP BY ALL)
SELECT id, reason FROM (SELECT id, CASE WHEN s = 'set3' THEN 'unknown_set' WHEN CAST(m[2:] AS INTEGER) >= 40 THEN 'unknown_measure' WHEN id <> first THEN 'twice' WHEN value <= 0 OR value > 2 OR abs(round(value * 100) - value * 100) > 1e-6 THEN 'bad_value' END AS reason FROM v JOIN f USING (s, m)) WHERE reason IS NOT NULL""")
def critical_values(spark, d):
    line = table(spark, d, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    value = F.col("l_discount") * 30 - 0.5 + F.when(F.col("l_linenumber") == 3, 0.001).otherwise(0.0)
    values = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name("set", F.col("l_suppkey") % 4).alias("set"), name("m", F.col("l_partkey") % 50).alias("measure"), value.alias("value"))
    known = spark.range(120).select(name("set", F.col("id") % 3).alias("set"), name("m", F.floor(F.col("id") / 3)).alias("measure"))
    return scores.critical_value_reasons(values, known, 2.0)


PAIRED = """s AS (SELECT o_custkey AS person, l_orderkey AS sheet, 'i' || (l_suppkey % 3) AS instrument, 'mod' || (l_partkey % 2) AS module, 'm' || l_linenumber AS measure, CASE WHEN l_linenumber % 2 = 0 THEN 'scaled' ELSE 'standard' END AS scale, CAST((l_partkey * 31 + l_suppkey) % 121 + 40 AS DOUBLE) AS value, o_orderdate >= TIMESTAMP '1999-01-01' AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {PAIRED}, a AS (SELECT person, instrument, module, measure, min((sheet, scale, value)) AS x FROM s WHERE late GROUP BY 1, 2, 3, 4), b AS (SELECT * FROM s WHERE NOT late),
m AS (SELECT a.person, a.instrument, a.module, a.measure, x[2] AS scale, x[3] AS after, min((CASE WHEN b.instrument = a.instrument AND b.module = a.module THEN 0 ELSE 1 END, b.sheet, b.instrument, b.value)) AS y FROM a JOIN b ON a.person = b.person AND a.measure = b.measure AND b.scale = x[2] AND ((b.instrument = a.instrument AND b.module = a.module) OR (b.instrument <> a.instrument AND a.instrument IN ('i0', 'i1') AND b.instrument IN ('i0', 'i1'))) GROUP BY ALL)
SELECT person, instrument, module, measure, y[3] AS before_instrument, y[4] AS before, after, after - y[4] AS change, abs(after - y[4]) >= CASE scale WHEN 'scaled' THEN 3 ELSE 10 END AS notable FROM m""")
def score_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = table(spark, d, "lineitem").join(o, "l_orderkey").select(
        F.col("o_custkey").alias("person"), F.col("l_orderkey").alias("sheet"), name("i", F.col("l_suppkey") % 3).alias("instrument"), name("mod", F.col("l_partkey") % 2).alias("module"), name("m", F.col("l_linenumber")).alias("measure"),
        F.when(F.col("l_linenumber") % 2 == 0, "scaled").otherwise("standard").alias("scale"), (F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey"), F.lit(121)) + 40).cast("double").alias("value"), (F.to_date("o_orderdate") >= F.lit("1999-01-01").cast("date")).alias("late"),
    )
    return scores.compare(rows.where("not late").drop("late"), rows.where("late").drop("late"), ("i0", "i1"))


@query(f"""{SHEETS}, s AS (SELECT sheet, 'i' || (sheet % 2) AS instrument, 'm' || measure AS measure, value, CASE WHEN measure <= 4 THEN 'index' WHEN measure <= 6 THEN 'subtest' END AS kind FROM sheets), f AS (SELECT sheet, instrument, measure, kind, min(value) AS value FROM s WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4),
g AS (SELECT sheet, instrument, max(value) FILTER (kind = 'index') - min(value) FILTER (kind = 'index') AS spread, count(*) FILTER (kind = 'index') AS n, min((value, measure)) FILTER (kind = 'index') AS lo, max((value, measure)) FILTER (kind = 'index') AS hi, max(value) FILTER (kind = 'subtest') - min(value) FILTER (kind = 'subtest') AS scatter, count(*) FILTER (kind = 'subtest') AS m FROM f GROUP BY 1, 2)
SELECT sheet, instrument, unnest(list_filter([CASE WHEN spread >= 15 THEN 'index_gap' END, CASE WHEN spread >= 15 THEN 'lowest_index:' || lo[2] END, CASE WHEN spread >= 15 THEN 'highest_index:' || hi[2] END, CASE WHEN instrument = 'i0' AND spread >= 23 THEN 'index_spread_wide' END, CASE WHEN n >= 3 AND spread <= 9 THEN 'flat_profile' END, CASE WHEN m >= 3 AND scatter >= 6 THEN 'subtest_scatter' END], lambda x: x IS NOT NULL)) AS pattern FROM g""")
def profile_patterns(spark, d):
    s = _sheets(spark, d).select("sheet", F.concat(F.lit("i"), (F.col("sheet") % 2).cast("string")).alias("instrument"), F.concat(F.lit("m"), F.col("measure").cast("string")).alias("measure"), F.col("value").alias("nth"), "value")
    known = spark.createDataFrame([(f"i{i}", f"m{m}", "index" if m <= 4 else "subtest") for i in range(2) for m in range(1, 7)], "instrument string, measure string, kind string")
    return scores.patterns(s, known, ("i0",))


@query(f"""{SHEETS}, f AS (SELECT sheet, CAST(measure AS INTEGER) AS measure, min(value) AS value FROM sheets WHERE measure <= 4 GROUP BY 1, 2), g AS (SELECT *, count(*) OVER (PARTITION BY sheet) AS k, avg(value) OVER (PARTITION BY sheet) AS mean FROM f)
SELECT sheet, 'set1' AS "set", 'm' || measure AS measure, CASE WHEN value - mean >= 2.5 + measure THEN 'strength' ELSE 'weakness' END AS place FROM g WHERE k = 4 AND abs(value - mean) >= 2.5 + measure""")
def publisher_places(spark, d):
    s = _sheets(spark, d).where("measure <= 4").groupBy("sheet", "measure").agg(F.min("value").alias("value")).select("sheet", F.lit("i0").alias("instrument"), F.concat(F.lit("m"), F.col("measure").cast("string")).alias("measure"), "value")
    sets = spark.createDataFrame([("set1", "i0", f"m{m}") for m in range(1, 5)] + [("set2", "i0", "m1"), ("set2", "i0", "m9")], "set string, instrument string, measure string")
    critical = spark.createDataFrame([(x, f"m{m}", 2.5 + m) for x in ("set1", "set2") for m in range(1, 5)], "set string, measure string, value double")
    return scores.by_publisher(s, sets, critical)


# ---------------------------------------------------------------- mining
@query(f"""WITH d AS (SELECT doc_id AS id, source AS section, {WORDS} AS w FROM documents), g AS (SELECT DISTINCT id, unnest(list_concat({_runs(2)}, {_runs(3)})) AS phrase FROM d WHERE len(w) >= 3), c AS (SELECT phrase, count(*) AS reports FROM g GROUP BY 1 HAVING count(*) >= 12)
SELECT phrase, reports FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.phrase <> a.phrase AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ') AND b.reports >= 0.8 * a.reports)""")
def widest_phrases(spark, d):
    return mining.widest_phrases(_docs(spark, d).where(F.size(text.words("text")) >= 3), (2, 3), 12, 0.8)


@query(f"""WITH s AS (SELECT doc_id AS id, source AS section, list_filter(string_split_regex(coalesce(text, ''), '[.!?;\\n]+'), lambda x: trim(x) <> '') AS s FROM documents), p AS (SELECT id, section, 'opening' AS place, s[1] AS text FROM s WHERE len(s) > 0 UNION ALL SELECT id, section, 'closing', s[len(s)] FROM s WHERE len(s) > 1),
w AS (SELECT id, section, place, {WORDS} AS w FROM p), b AS (SELECT DISTINCT id, section, place, array_to_string(w[1:n], ' ') AS phrase FROM w, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE len(w) >= n), c AS (SELECT section, place, phrase, count(*) AS reports FROM b GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.section = a.section AND o.place = a.place AND starts_with(o.phrase, a.phrase || ' ') AND o.reports >= 0.8 * a.reports) QUALIFY row_number() OVER (PARTITION BY section, place ORDER BY reports DESC, phrase) <= 2""")
def recurring_shapes(spark, d):
    return mining.shapes(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"), "text"), 2, 0.8, 2)


GROUPS = {"join": ["and", "with", "und"], "place": ["in", "at", "from"], "aim": ["for", "pour", "zu"]}


@query(f"""WITH w AS (SELECT unnest({WORDS}) AS word FROM documents), g AS (SELECT unnest({[{'g': g, 'v': v} for g, vs in GROUPS.items() for v in vs]}, recursive := true)), c AS (SELECT g, v, count(*) AS n FROM w JOIN g ON word = v GROUP BY 1, 2)
SELECT g AS "group", v AS variant, n FROM c a WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.g = a.g AND b.v <> a.v AND b.n >= a.n)""")
def usual_terms(spark, d):
    return mining.usual(_docs(spark, d), GROUPS, 5)


@query("""WITH e AS (SELECT event_type AS pattern, user_id % 40 AS p, event_id % 3 <> 0 AS changed FROM events), c AS (SELECT pattern || p AS pattern, count(*) FILTER (changed) AS k, count(*) AS n FROM e GROUP BY 1), w AS (SELECT *, (k / n + 2.706025 / (2 * n) - 1.645 * sqrt((k / n * (1 - k / n) + 2.706025 / (4 * n)) / n)) / (1 + 2.706025 / n) AS lower FROM c)
SELECT pattern, k, n, round(lower, 6) AS lower, CAST(row_number() OVER (ORDER BY round(lower * ln(1 + n), 6) DESC, pattern) AS INTEGER) AS rank FROM w WHERE k >= 3 AND lower >= 0.5 QUALIFY rank <= 50""")
def edit_suggestions(spark, d):
    e = table(spark, d, "events").select(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("pattern"), (F.col("event_id") % 3 != 0).alias("changed"))
    return mining.suggestions(e, 50).withColumn("lower", F.round("lower", 6))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE word IN ('the', 'and', 'of', 'with', 'und', 'der', 'for', 'that', 'et', 'les', 'pour', 'by') GROUP BY 1), r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS r, max(n) OVER () AS top FROM c)
SELECT word, n, CASE WHEN r <= 4 THEN 'used' ELSE 'rare' END AS habit FROM r WHERE r <= 4 OR n < 0.1 * top""")
def connector_habits(spark, d):
    return mining.connector_habits(_docs(spark, d), ["the", "and", "of", "with", "und", "der", "for", "that", "et", "les", "pour", "by"])


@query(f"""WITH l AS (SELECT conv_id AS id, regexp_replace(trim(line), '^([-–•*]|[0-9]{{1,2}}[.)]) *', '') AS text FROM (SELECT conv_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations)) SELECT text AS line, count(DISTINCT id) AS reports FROM l WHERE len(list_distinct({WORDS})) >= 2 GROUP BY 1 HAVING count(DISTINCT id) >= 2""")
def recurring_lines(spark, d):
    return mining.recurring_lines(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text"), 2)


@query("""WITH v AS (SELECT user_id AS key, event_id AS at_, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), l AS (SELECT key, list(x ORDER BY i) AS xs FROM v GROUP BY 1)
SELECT key, round(list_reduce(list_transform(range(1, len(xs) + 1), lambda i: {'i': i, 'm': xs[i]}), lambda a, x: {'i': x.i, 'm': CASE WHEN x.i <= 10 THEN a.m + (x.m - a.m) / x.i ELSE a.m + 0.2 * (x.m - a.m) END}).m, 6) AS fit FROM l""")
def fit_trend(spark, d):
    return mining.trend(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("value").alias("x"))).withColumn("fit", F.round("fit", 6))


@query("""WITH m AS (SELECT user_id AS key, strftime(ts, '%Y-%m-%d') AS month, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT key, round(avg(x) FILTER (r <= 30), 4) AS latest, round(avg(x) FILTER (r BETWEEN 31 AND 60), 4) AS before FROM m WHERE r <= 120 GROUP BY 1""")
def learned_trend(spark, d):
    return mining.learned(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("value").alias("x")))
