"""Queries over personal details: what is found, hidden, let out and put back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import edits, privacy, spans
from quillspark.operators.text import words
from quillspark.plans.registry import TODAY, WORDS, query
from quillspark.sources.records import table

DAY = f"DATE '{TODAY}'"


def _rule(rule: str) -> str:
    """For the oracle's engine, whose borders of words are those of ASCII."""
    return rule.replace(privacy.A, r"\b").replace(privacy.Z, r"\b").replace("'", "''")


def _chain(text: str, put: str) -> tuple[str, list[tuple[str, str]]]:
    """CTEs that replace kind by kind, and of each kind the column that its rule reads."""
    ctes, seen = [f"t0 AS ({text})"], []
    for i, (kind, rule) in enumerate(privacy.RULES.items()):
        seen.append((kind, f"t{i}"))
        ctes.append(f"t{i + 1} AS (SELECT * EXCLUDE (text), regexp_replace(text, '{_rule(rule)}', '{put.format(kind)}', 'g') AS text FROM t{i})")
    return ", ".join(ctes), seen


def _fold(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{privacy.DIGITS}', '{'0123456789' * 4}')"


DETAILED = """SELECT doc_id, text || ' Call (415) 555-0100 or 212-555-0199, id 123-45-6789, born 3.9.2004 and 12 March 2010, 2004-05-06, since 1998; card 4111 1111 1111 1111, IBAN DE44 5001 0517 5407 3249 31, file 77/1234-5.' AS text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0"""


def _detailed(spark, d):
    """The documents, every third with a line of details at its end."""
    more = " Call (415) 555-0100 or 212-555-0199, id 123-45-6789, born 3.9.2004 and 12 March 2010, 2004-05-06, since 1998; card 4111 1111 1111 1111, IBAN DE44 5001 0517 5407 3249 31, file 77/1234-5."
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(more))).otherwise(F.col("text")).alias("text"))


CHAIN, SEEN = _chain(f"SELECT doc_id, {_fold('text')} AS text FROM x", "[{}]")


@query(f"WITH x AS ({DETAILED}), {CHAIN}, n AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(regexp_extract_all(text, '{_rule(privacy.RULES[k])}')) AS n FROM {t}" for k, t in SEEN) + ") SELECT kind, CAST(sum(n) AS BIGINT) AS places, count(*) FILTER (n > 0) AS documents FROM n GROUP BY kind")
def pii_counts(spark, d):
    return privacy.counts(_detailed(spark, d))


@query(f"WITH x AS ({DETAILED}), {CHAIN} SELECT doc_id, text FROM t{len(SEEN)}")
def pii_hidden(spark, d):
    return _detailed(spark, d).select("doc_id", privacy.hidden(F.col("text")).alias("text"))


BLANKED, BLANK_SEEN = _chain(f"SELECT doc_id AS id, body, array_to_string(list_transform(regexp_extract_all({_fold('body')}, '{privacy.PIECES}'), lambda x: CASE WHEN regexp_matches(x, '^{privacy.TAG}$') THEN repeat(' ', length(x)) ELSE x END), '') AS text FROM y", " ")
OWN = "['[email]', '[role_1]']"


@query(f"""WITH x AS ({DETAILED}), y AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN coalesce(text, '') || ' [role_1] [other_2] 1234567' WHEN doc_id % 5 = 2 THEN '[email] ZEBRAFISH ' || coalesce(text, '') ELSE coalesce(text, '') END AS body FROM x), {BLANKED},
k AS (SELECT id, body, [{", ".join(f"CASE WHEN regexp_matches({t}.text, '{_rule(privacy.RULES[k])}') THEN 'pattern:{k}' END" for k, t in BLANK_SEEN)}] AS kinds FROM {" JOIN ".join(["t0"] + [f"(SELECT id, text FROM {t}) {t} USING (id)" for _, t in BLANK_SEEN[1:]])}),
r AS (SELECT id, body, list_filter(list_concat(list_concat([CASE WHEN strlen(body) > 4000 THEN 'too_large' END], kinds), [CASE WHEN len(list_filter(regexp_extract_all(body, '{privacy.TAG}'), lambda x: NOT list_contains({OWN}, x))) > 0 THEN 'foreign_tag' END, CASE WHEN contains(lower(body), 'zebrafish') THEN 'canary' END]), lambda x: x IS NOT NULL) AS reasons FROM k)
SELECT id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN sha256(body) END AS sha256 FROM r""")
def gate_clear(spark, d):
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    body = F.when(k == 1, F.concat(text, F.lit(" [role_1] [other_2] 1234567"))).when(k == 2, F.concat(F.lit("[email] ZEBRAFISH "), text)).otherwise(text)
    return privacy.gate(_detailed(spark, d).select(F.col("doc_id").alias("id"), body.alias("text")), ["[email]", "[role_1]"], ["zebrafish"], 4000)


_WORD = edits.WORD.replace("'", "''")


@query(rf"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '{_WORD}'), lambda x: lower(x)) AS l FROM documents),
n AS (SELECT DISTINCT list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x))[1:2 + item_id % 3] AS nw FROM benchmark), h AS (SELECT DISTINCT lower(list_last(regexp_extract_all(text, '{_WORD}'))) AS w FROM benchmark WHERE item_id % 10 = 0),
e AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM d), a AS (SELECT DISTINCT id FROM e JOIN n ON l[i] = nw[1] WHERE l[i:i + len(nw) - 2] = nw[1:len(nw) - 1] AND regexp_replace(l[i + len(nw) - 1], '[''’][sס]$', '') = nw[len(nw)]),
b AS (SELECT DISTINCT id FROM d WHERE id % 11 = 3 AND id % 22 <> 3 AND list_contains(l, 'the')), c AS (SELECT DISTINCT id FROM e JOIN h ON l[i] = w), s AS (SELECT id, 'identity' AS r FROM a UNION ALL SELECT id, 'suspect' FROM b UNION ALL SELECT id, 'past_name' FROM c),
m AS (SELECT id, string_agg(r, ',' ORDER BY r) AS more FROM s GROUP BY id), g AS (SELECT id, text, CASE WHEN strlen(text) > 3000 THEN 'too_large' ELSE '' END AS reasons FROM d)
SELECT id, CASE WHEN more IS NULL THEN reasons WHEN reasons = '' THEN more ELSE reasons || ',' || more END AS reasons, CASE WHEN more IS NULL AND reasons = '' THEN sha256(text) END AS sha256 FROM g LEFT JOIN m USING (id)""")
def gate_names(spark, d):
    """What stops each document beyond patterns: declared names, suspects that nobody resolved, names of erased people; and its size."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    bodies = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    w = edits.raw_words(F.col("text"))
    known = items.select(F.array_join(F.slice(w, F.lit(1), (2 + F.col("item_id") % 3).cast("int")), " ").alias("name"), F.lit("x").alias("payload"), F.col("item_id").alias("rank"))
    suspects = docs.where("doc_id % 11 = 3").select(F.col("doc_id").alias("id"), F.lit("The").alias("word"), (F.col("doc_id") % 22 == 3).alias("resolved"))
    past = items.where("item_id % 10 = 0").select(privacy.past_hash(F.element_at(w, -1), "k").alias("hash"))
    large = F.octet_length("text") > 3000
    sized = bodies.select("id", F.when(large, "too_large").otherwise("").alias("reasons"), F.when(~large, F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"))
    return privacy.gate_with_names(bodies, sized, known, suspects, past, "k")


@query("""WITH n AS (SELECT o_orderkey AS id, lpad(CAST((o_orderkey * 104729 + 17) % 1000000000 AS VARCHAR), 9, '0') AS digits FROM orders), s AS (SELECT *, list_transform(range(1, 10), lambda i: CAST(digits[i] AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) AS v FROM n)
SELECT id, digits, list_sum(list_transform(v, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0 AS valid FROM s""")
def id_checksum(spark, d):
    digits = F.lpad(F.pmod(F.col("o_orderkey") * 104729 + 17, F.lit(1_000_000_000)).cast("string"), 9, "0")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), digits.alias("digits")).withColumn("valid", privacy.valid_id(F.col("digits")))


@query(f"""WITH r AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), p AS (SELECT date, abs({DAY} - date) AS days, date <= {DAY} AS past FROM r),
a AS (SELECT *, CASE WHEN days <= 10 THEN 'about a week' WHEN days <= 17 THEN 'about two weeks' WHEN days <= 25 THEN 'about three weeks' WHEN days <= 45 THEN 'about a month' WHEN days <= 75 THEN 'about two months' WHEN days <= 334 THEN 'about ' || (days + 15) // 30 || ' months' WHEN days <= 547 THEN 'about a year' WHEN days <= 912 THEN 'about two years' ELSE 'about ' || (days + 182) // 365 || ' years' END AS amount FROM p)
SELECT date, CASE WHEN days <= 3 THEN CASE WHEN past THEN 'recently' ELSE 'in the coming days' END WHEN past THEN amount || ' ago' ELSE 'in ' || amount END AS phrase FROM a""")
def relative_dates(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return rows.withColumn("phrase", privacy.relative_date(F.col("date"), F.lit(TODAY).cast("date")))


@query(f"""WITH r AS (SELECT DISTINCT year(o_orderdate) % 100 AS yy, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders) SELECT yy, m, d, CASE WHEN 2000 + yy <= year({DAY}) + 1 THEN 2000 + yy ELSE 1900 + yy END AS full_year, year({DAY}) - CASE WHEN m > month({DAY}) OR (m = month({DAY}) AND d > day({DAY})) THEN 1 ELSE 0 END AS latest_year FROM r""")
def guessed_years(spark, d):
    day = F.lit(TODAY).cast("date")
    rows = table(spark, d, "orders").select((F.year("o_orderdate") % 100).alias("yy"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")).distinct()
    return rows.withColumn("full_year", privacy.expand_year(F.col("yy"), day)).withColumn("latest_year", privacy.infer_year(F.col("m"), F.col("d"), day))


def _spans(source: str, rules: dict[str, str]) -> str:
    """CTEs up to `spans` (doc_id, start, stop, kind, value) of x(doc_id, text): kind by kind what is found is overwritten, letter for letter."""
    ctes, any_mark = [source, f"t0 AS (SELECT *, {_fold('text')} AS m FROM x)"], f"[{chr(spans.MARK)}-{chr(spans.MARK + 0xFF)}]{spans.FILL}*"
    for i, rule in enumerate(rules.values()):
        r = _rule(spans._own(rule))
        put = f"p[i] || CASE WHEN i <= len(h) THEN '{chr(spans.MARK + i)}' || repeat('{spans.FILL}', length(h[i]) - 1) ELSE '' END"
        ctes.append(f"t{i + 1} AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(p) + 1), lambda i: {put}), '') AS m FROM (SELECT doc_id, text, regexp_split_to_array(m, '{r}') AS p, regexp_extract_all(m, '{r}') AS h FROM t{i}))")
    ctes.append(f"cut AS (SELECT doc_id, text, regexp_split_to_array(m, '{any_mark}') AS g, regexp_extract_all(m, '{any_mark}') AS k FROM t{len(rules)})")
    ctes.append("each AS (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM cut)")
    ctes.append("at_ AS (SELECT *, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(k[1:i - 1], lambda v: length(v))), 0) AS s FROM each)")
    ctes.append(f"spans AS (SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(s + length(k[i]) AS INTEGER) AS stop, {list(rules)!r}[unicode(k[i]) - {spans.MARK} + 1] AS kind, substring(text, CAST(s AS INTEGER) + 1, length(k[i])) AS value FROM at_)")
    return "WITH " + ", ".join(ctes)


BOOK = "book AS (SELECT kind, value, '[' || kind || '_' || row_number() OVER (PARTITION BY kind ORDER BY min((doc_id, start)), value) || ']' AS tag FROM spans GROUP BY kind, value)"


@query(f"{_spans(f'x AS ({DETAILED})', privacy.RULES)} SELECT doc_id, start, stop AS \"end\", kind, value FROM spans")
def detail_spans(spark, d):
    """Every personal detail with its place and its text as written."""
    return spans.listed(spans.found(_detailed(spark, d)))


@query(f"{_spans(f'x AS ({DETAILED})', privacy.RULES)}, o AS (SELECT doc_id, string_agg('[' || kind || ']', ' ' ORDER BY start) AS tags, CAST(sum(stop - start) AS BIGINT) AS letters FROM spans GROUP BY doc_id) SELECT x.doc_id, coalesce(tags, '') AS tags, length(coalesce(text, '')) - coalesce(letters, 0) + coalesce(length(replace(tags, ' ', '')), 0) AS letters FROM x LEFT JOIN o USING (doc_id)")
def details_tagged(spark, d):
    """The tags that stand in each text once its details are hidden, and how long it is then."""
    text = F.col("text")
    tags = F.regexp_extract_all(text, F.lit(r"\[(?:" + "|".join(privacy.RULES) + r")\]"), F.lit(0))
    return spans.hidden(_detailed(spark, d)).select("doc_id", F.array_join(tags, " ").alias("tags"), F.length(text).alias("letters"))


@query(f"{_spans(f'x AS ({DETAILED})', spans.MASKED)}, {BOOK} SELECT * FROM book")
def mask_numbers(spark, d):
    """The book of all kinds: each detail's number."""
    return spans.masked(_detailed(spark, d))[1]


@query(f"WITH x AS ({DETAILED}) SELECT doc_id, coalesce(text, '') AS text FROM x")
def masks_put_and_restored(spark, d):
    """Details of every kind become numbered tags and come back: the round trip gives the texts as they were."""
    return privacy.restored(*spans.masked(_detailed(spark, d)))


@query(f"{_spans(f'x AS ({DETAILED})', spans.MASKED)}, {BOOK}, g AS (SELECT doc_id, list(DISTINCT tag) AS tags FROM spans JOIN book USING (kind, value) GROUP BY 1) SELECT doc_id, array_to_string(list_sort(tags), ',') AS tags FROM g")
def mask_tags_used(spark, d):
    texts, _ = spans.masked(_detailed(spark, d))
    return texts.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(privacy.remaining_tags(F.col("text")), privacy.is_mask_tag))), ",").alias("tags")).where("tags <> ''")


@query(f"""WITH t AS (SELECT conv_id, turn, '[note] ' || coalesce(text, '') || ' [email_3] [' || role || '] [' AS text FROM conversations), p AS (SELECT conv_id, turn, regexp_extract_all(text, '{privacy.PIECES}') AS p FROM t)
SELECT conv_id, turn, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^{privacy.TAG}$') AND NOT regexp_matches(x, '^{privacy.OWN_TAG}$') THEN '(' || x[2:-2] || ')' ELSE x END), '') AS plain,
array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^{privacy.TAG}$') THEN repeat(' ', length(x)) ELSE x END), '') AS blanked, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^{privacy.TAG}$') AND x <> '[email_3]' THEN '(removed)' ELSE x END), '') AS own FROM p""")
def brackets_and_tags(spark, d):
    text = F.concat(F.lit("[note] "), F.coalesce("text", F.lit("")), F.lit(" [email_3] ["), "role", F.lit("] ["))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    return rows.select("conv_id", "turn", privacy.plain_brackets(F.col("text")).alias("plain"), privacy.blank_tags(F.col("text")).alias("blanked"), privacy.without_foreign_tags(F.col("text"), F.array(F.lit("[email_3]"))).alias("own"))


@query("""WITH t AS (SELECT unnest(['[email]', '[email_1]', '[email_0]', '[other]', '[missing]', '[missing: the report]', '[missing:x]', '[year]', 'email', '[missing:  ]']) AS tag) SELECT tag, CASE WHEN tag IN ('[email]', '[year]') THEN tag[2:-2] END AS base, tag = '[email_1]' AS numbered, tag IN ('[missing]', '[missing: the report]') AS note FROM t""")
def tag_grammar(spark, d):
    tags = ["[email]", "[email_1]", "[email_0]", "[other]", "[missing]", "[missing: the report]", "[missing:x]", "[year]", "email", "[missing:  ]"]
    t = F.col("tag")
    return spark.createDataFrame([(x,) for x in tags], "tag string").select("tag", privacy.mask_base(t).alias("base"), privacy.is_mask_tag(t).alias("numbered"), privacy.is_missing_note(t).alias("note"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches({_fold('x')}, '{"|".join(_rule(r) for r in privacy.RULES.values())}')) AS l FROM ({DETAILED})) SELECT doc_id, array_to_string(l, chr(10)) AS text FROM l""")
def lines_let_out(spark, d):
    return _detailed(spark, d).select("doc_id", privacy.without_refused_lines(F.col("text")).alias("text"))


@query(r"""WITH t AS (SELECT s_suppkey AS id, 'Name: x' || chr(10) || 'Address: ' || s_name || ', ' || s_nationkey || ' Road,, Town  tel 5' || chr(10) || 'Address:y' AS text FROM supplier), v AS (SELECT id, unnest(regexp_extract_all(text, 'Address: *([^\n\t|]*)', 1)) AS v FROM t),
p AS (SELECT id, trim(unnest(string_split(regexp_extract(v, '^(.*?)(?:  .*)?$', 1), ','))) AS part FROM v) SELECT id, part FROM p WHERE part <> ''""")
def address_fields(spark, d):
    text = F.concat(F.lit("Name: x\nAddress: "), "s_name", F.lit(", "), F.col("s_nationkey").cast("string"), F.lit(" Road,, Town  tel 5\nAddress:y"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(privacy.address_fields(text)).alias("part"))


@query("SELECT c_custkey AS id, 'Dear ' || c_name || ' {name}, see you  at ' || c_mktsegment || '.' AS text FROM customer")
def filled_messages(spark, d):
    values = F.create_map(F.lit("name"), F.concat("c_name", F.lit(" {name}")), F.lit("place"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), privacy.filled(F.lit("Dear {name}, see you {when} at {place}."), values).alias("text"))


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS "at", CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN 'I' ELSE 'O' END AS label, l_quantity AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY label, score DESC) = 1),
s AS (SELECT *, CASE WHEN label = 'B' OR (label = 'I' AND (coalesce(lag(label) OVER w, 'O') = 'O' OR "at" <> lag("at") OVER w + 1)) THEN 1 ELSE 0 END AS starts FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY "at")), r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT doc_id, min("at") AS first, max("at") AS last, round(avg(score), 4) AS score FROM r WHERE label <> 'O' GROUP BY doc_id, run""")
def merged_labels(spark, d):
    label = F.when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "R", "I").otherwise("O")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("at")).agg(F.min(F.struct(label.alias("label"), (-F.col("l_quantity")).alias("less"))).alias("x"))
    return privacy.merged_labels(rows.select("doc_id", "at", "x.label", (-F.col("x.less")).alias("score"))).withColumn("score", F.round("score", 4))


SPANS = """gold AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 40 AS start, l_linenumber * 40 + CAST(l_quantity AS INTEGER) AS stop, l_returnflag AS category FROM lineitem), found AS (SELECT l_orderkey AS doc_id, l_linenumber * 40 + CAST(l_partkey % 60 AS INTEGER) AS start, l_linenumber * 40 + CAST(l_partkey % 60 AS INTEGER) + 5 AS stop FROM lineitem WHERE l_suppkey % 2 = 0)"""


@query(f"""WITH {SPANS} SELECT category, count(*) AS n, CAST(sum(CAST(h AS INTEGER)) AS BIGINT) AS hit FROM (SELECT g.*, EXISTS (SELECT 1 FROM found f WHERE f.doc_id = g.doc_id AND g.start < f.stop AND f.start < g.stop) AS h FROM gold g) GROUP BY 1""")
def span_recall(spark, d):
    line, at = table(spark, d, "lineitem"), F.col("l_linenumber") * 40
    gold = line.select(F.col("l_orderkey").alias("doc_id"), at.alias("start"), (at + F.col("l_quantity").cast("int")).alias("end"), F.col("l_returnflag").alias("category"))
    shift = (F.col("l_partkey") % 60).cast("int")
    found = line.where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), (at + shift).alias("start"), (at + shift + 5).alias("end"))
    return privacy.span_quality(gold, found)


@query(f"""WITH a AS (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark), b AS (SELECT DISTINCT unnest({WORDS}) AS name FROM conversations) SELECT word, name FROM a, b WHERE regexp_full_match(word, '[a-z]+') AND regexp_full_match(name, '[a-z]+') AND abs(length(word) - length(name)) <= 1 AND word <> name AND levenshtein(word, name) = 1""")
def misreads(spark, d):
    a = table(spark, d, "benchmark").select(F.explode(words("text")).alias("word"))
    b = table(spark, d, "conversations").select(F.explode(words("text")).alias("name"))
    return privacy.misreads(a.where("word rlike '^[a-z]+$'"), b.where("name rlike '^[a-z]+$'"))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS doc_id, {WORDS} AS w FROM conversations), ph AS (SELECT unnest(['the of', 'of and the', 'en les', 'der und', 'und', 'la', 'and']) AS phrase),
r AS (SELECT doc_id, unnest(list_concat(list_concat(list_transform(range(0, len(w)), lambda i: {{'at': i, 'n': 1, 'phrase': w[i + 1]}}), list_transform(range(0, len(w) - 1), lambda i: {{'at': i, 'n': 2, 'phrase': w[i + 1] || ' ' || w[i + 2]}})), list_transform(range(0, len(w) - 2), lambda i: {{'at': i, 'n': 3, 'phrase': w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]}})), recursive := true) FROM w),
f AS (SELECT doc_id, list({{'at': "at", 'n': n, 'phrase': phrase}} ORDER BY "at", n DESC) AS l FROM r WHERE phrase IN (SELECT phrase FROM ph) GROUP BY 1),
g AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1]."at" >= a[len(a)]."at" + a[len(a)].n THEN list_concat(a, x) ELSE a END) AS p FROM f) SELECT doc_id, CAST("at" AS INTEGER) AS "at", n, phrase FROM (SELECT doc_id, unnest(p, recursive := true) FROM g)""")
def phrase_matches(spark, d):
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), words("text").alias("words"))
    known = spark.createDataFrame([(x,) for x in ("the of", "of and the", "en les", "der und", "und", "la", "and")], "phrase string")
    return privacy.phrase_matches(docs, known)
