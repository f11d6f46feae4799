"""Queries over wordings: what edits changed, and declared names in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import checks, edits, mining, names
from quillspark.operators.text import NOT_WORD, small
from quillspark.plans.registry import query
from quillspark.sources.records import table

WORD = edits.WORD.replace("'", "''")
#: Letters that two texts share at their beginning to count as wordings of one.
SHARED = 60


def versions(spark, d) -> DataFrame:
    """id, before, after: documents that begin alike, in order of id, each beside the one before it where that differs."""
    docs = table(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").alias("id"), F.col("text").alias("after"), F.xxhash64(F.left("text", F.lit(SHARED))).alias("begins"))
    rows = docs.withColumn("before", F.lag("after").over(Window.partitionBy("begins").orderBy("id", "after")))
    return rows.where("before <> after and left(before, 60) = left(after, 60)").select("id", "before", "after")


@query()
def edit_changes(spark, d):
    """Every change worth learning between consecutive wordings of a text."""
    return edits.changes(edits.aligned(versions(spark, d)))


@query()
def edit_kept(spark, d):
    """The share of words that each wording keeps of the one before it."""
    return edits.kept_shares(edits.aligned(versions(spark, d)))


@query()
def edit_learned(spark, d):
    """Changes over all edits, how often they could have been made, and the lower bound of their share."""
    both = versions(spark, d)
    return edits.learned(edits.changes(edits.aligned(both)), both, small)


@query(rf"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, * FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
w AS (SELECT rid, doc_id, regexp_extract_all(text, '{WORD}') AS w, list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x)) AS l, regexp_split_to_array(text, '{WORD}') AS gap FROM t),
n AS (SELECT nw, min(rank) AS rank FROM (SELECT list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x))[1:1 + item_id % 6] AS nw, item_id AS rank FROM benchmark) WHERE len(nw) > 0 GROUP BY nw),
e AS (SELECT rid, w, l, gap, unnest(range(1, len(l) + 1)) AS i FROM w),
f AS (SELECT e.*, l[i] AS lw, regexp_replace(l[i], '[''’][sס]$', '') AS bare FROM e),
c AS (SELECT rid, i, len(nw) AS n, length(CASE WHEN len(nw) = 1 THEN lw ELSE l[i + len(nw) - 1] END) - length(nw[len(nw)]) AS tail, rank FROM f JOIN n ON nw[1] = lw OR (nw[1] = bare AND len(nw) = 1)
  WHERE len(nw) = 1 OR (l[i:i + len(nw) - 2] = nw[1:len(nw) - 1] AND (l[i + len(nw) - 1] = nw[len(nw)] OR regexp_replace(l[i + len(nw) - 1], '[''’][sס]$', '') = nw[len(nw)]))),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY rid, i ORDER BY n DESC, tail, rank) = 1),
g AS MATERIALIZED (SELECT a.*, x.i AS nxt FROM (SELECT *, i + n AS stop FROM b) a ASOF LEFT JOIN b x ON a.rid = x.rid AND a.stop <= x.i),
r AS (SELECT rid, min(i) AS i FROM b GROUP BY rid UNION ALL SELECT g.rid, g.nxt FROM r JOIN g ON r.rid = g.rid AND r.i = g.i WHERE nxt IS NOT NULL)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS "at", CAST(n AS INTEGER) AS n, 0 AS prefix, CAST(list_sum(list_transform(gap[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(w.w[1:i - 1], lambda v: length(v))), 0) AS INTEGER) AS start,
CAST(list_sum(list_transform(gap[1:i + n - 1], lambda v: length(v))) + list_sum(list_transform(w.w[1:i + n - 1], lambda v: length(v))) - tail AS INTEGER) AS "end", 'item_' || rank AS payload FROM r JOIN b USING (rid, i) JOIN w USING (rid)""")
def declared_names(spark, d):
    """Names of one to six words, the first words of benchmark items, in all documents."""
    words = edits.raw_words(F.col("text"))
    rows = table(spark, d, "benchmark").select(F.array_join(F.slice(words, F.lit(1), (1 + F.col("item_id") % 6).cast("int")), " ").alias("name"), F.concat(F.lit("item_"), "item_id").alias("payload"), F.col("item_id").alias("rank"))
    return names.declared(table(spark, d, "documents"), rows)


_DATED = """SELECT doc_id AS id, coalesce(text, '') || chr(10) || 'Born 1.1.2050' || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'seen ' || (doc_id % 28 + 1) || '-' || (doc_id % 12 + 1) || '-' || (1990 + doc_id % 40) WHEN 1 THEN (doc_id % 31 + 1) || '.' || (doc_id % 14) || '.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')
  WHEN 2 THEN 'of March, ' || (1985 + doc_id % 30) WHEN 3 THEN (doc_id % 12 + 1) || '/' || (2000 + doc_id % 20) || ' and 40/1/2001' WHEN 4 THEN 'in May 20011 or 1.2.3.2004' ELSE 'no date 12/5/85' END AS text FROM documents"""
_RUN, _NAMED = checks.DATE_RUN, checks.MONTH_RUN


@query(f"""WITH d AS ({_DATED}), k AS (SELECT id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(x), 'born|birth|dob')), chr(10)) AS text FROM d),
r AS (SELECT id, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM k), p AS (SELECT id, regexp_split_to_array(run, '[./\\-]') AS p FROM r),
n AS (SELECT id, CASE len(p) WHEN 3 THEN CASE WHEN try_cast(p[1] AS INTEGER) BETWEEN 1 AND 31 THEN try_cast(p[2] AS INTEGER) END WHEN 2 THEN CASE WHEN length(p[2]) = 4 THEN try_cast(p[1] AS INTEGER) END END AS m,
  CASE len(p) WHEN 3 THEN CASE length(p[3]) WHEN 4 THEN try_cast(p[3] AS INTEGER) WHEN 2 THEN try_cast(p[3] AS INTEGER) + CASE WHEN try_cast(p[3] AS INTEGER) < 50 THEN 2000 ELSE 1900 END END WHEN 2 THEN try_cast(p[2] AS INTEGER) END AS y FROM p
  UNION ALL SELECT id, list_position({list(checks.MONTHS)!r}, regexp_extract(x, '^[A-Za-z]+')), CASE WHEN length(regexp_extract(x, '[0-9]+$')) = 4 THEN try_cast(regexp_extract(x, '[0-9]+$') AS INTEGER) END FROM (SELECT id, unnest(regexp_extract_all(text, '{_NAMED}')) AS x FROM k)),
b AS (SELECT id, max(y * 100 + m) AS v FROM n WHERE m BETWEEN 1 AND 12 AND y BETWEEN 1990 AND 2099 GROUP BY id) SELECT d.id, CASE WHEN v IS NOT NULL THEN CAST(v // 100 AS VARCHAR) || '-' || lpad(CAST(v % 100 AS VARCHAR), 2, '0') END AS month FROM d LEFT JOIN b USING (id)""")
def document_months(spark, d):
    """The month of the latest date in each document, with a line of dates of every form added."""
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    form = i % 6
    line = (
        F.when(form == 0, F.concat(F.lit("seen "), s(i % 28 + 1), F.lit("-"), s(i % 12 + 1), F.lit("-"), s(1990 + i % 40)))
        .when(form == 1, F.concat(s(i % 31 + 1), F.lit("."), s(i % 14), F.lit("."), F.lpad(s(i % 100), 2, "0")))
        .when(form == 2, F.concat(F.lit("of March, "), s(1985 + i % 30)))
        .when(form == 3, F.concat(s(i % 12 + 1), F.lit("/"), s(2000 + i % 20), F.lit(" and 40/1/2001")))
        .when(form == 4, "in May 20011 or 1.2.3.2004")
        .otherwise("no date 12/5/85")
    )
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nBorn 1.1.2050\n"), line)
    return table(spark, d, "documents").select(i.alias("id"), checks.document_month(text).alias("month"))


@query(rf"""WITH RECURSIVE r AS (SELECT conv_id * 100 + turn AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations), x AS (SELECT id, i - 1 AS place, trim(regexp_replace(trim(regexp_replace(trim(l[i]), '^([-–•*]|[0-9]{{1,2}}[.)]) *', '')), '[.,;]+$', '')) AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM r)),
y AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '{NOT_WORD}'), lambda v: v <> ''))), ' ') AS w FROM x WHERE len(regexp_extract_all(line, '\S+')) >= 2 AND length(line) <= 160 AND NOT regexp_matches(line, '[\[\]0-9]')), z AS (SELECT * FROM y WHERE w <> ''),
s AS (SELECT w, string_split(w, ' ') AS l, row_number() OVER (ORDER BY w) AS n FROM (SELECT DISTINCT w FROM z)), p AS (SELECT a.n AS a, b.n AS b FROM s a JOIN s b ON a.n <> b.n WHERE len(list_intersect(a.l, b.l)) >= 0.6 * (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l))) - 1e-9),
c AS (SELECT n, n AS root FROM s UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.n), g AS (SELECT n, min(root) AS g FROM c GROUP BY n), o AS (SELECT z.*, g.g FROM z JOIN s USING (w) JOIN g USING (n)),
k AS (SELECT g, line, count(DISTINCT id) AS n FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY count(DISTINCT id) DESC, line) = 1), f AS (SELECT g, id, min(place) AS place FROM o GROUP BY 1, 2), u AS (SELECT count(DISTINCT id) AS total FROM z),
m AS (SELECT g, count(*) AS reports, quantile_cont(place, 0.5) AS place FROM f GROUP BY 1 HAVING count(*) >= 2) SELECT line AS item, reports, reports / total AS share, place, row_number() OVER (ORDER BY place, line) AS nth FROM m JOIN k USING (g), u""")
def list_items(spark, d):
    """Lines that turns of conversations share, wordings that are alike as one."""
    c = table(spark, d, "conversations")
    return mining.list_items(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), 2, 0.6)
