"""Queries that look for the closest passage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import retrieval
from quillspark.plans.registry import query
from quillspark.sources.records import table

_W = r"list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
LANGUAGES = ("de", "en", "es", "fr")


def _both(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    passages = docs.select((F.col("doc_id") * 100_000 + F.col("at")).alias("id"), F.col("lang").alias("section"), "text")
    items = table(spark, d, "benchmark")
    section = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("item_id") % 4 + 1).cast("int"))
    return passages, items.select(F.col("item_id").alias("id"), section.alias("section"), "text")


@query(rf"""WITH l AS (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), p AS (SELECT doc_id * 100000 + i - 1 AS id, lang AS section, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)),
d AS (SELECT id, section, {_W} AS w FROM p), s AS (SELECT count(*) AS docs, greatest(avg(len(w)), 1.0) AS mean FROM d),
q AS (SELECT item_id AS query_id, ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS own, unnest(list_distinct({_W})) AS word FROM benchmark),
t AS (SELECT id, section, n, word, count(*) AS tf FROM (SELECT id, section, len(w) AS n, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
x AS (SELECT id, section, n, word, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(n, 1) / mean)) AS w FROM t JOIN f USING (word), s),
r AS (SELECT query_id, id, round(sum(w * CASE WHEN section = own THEN 1.5 ELSE 1 END), 6) AS score FROM q JOIN x USING (word) WHERE n >= 8 GROUP BY 1, 2)
SELECT query_id, id AS doc_id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""")
def similar_paragraph(spark, d):
    """The paragraph of all documents that is closest to each benchmark item."""
    return retrieval.closest(*_both(spark, d))[0]


@query()
def similar_paragraph_reads(spark, d):
    """How many postings each item's words have, and how many were read to find candidates."""
    return retrieval.reads(*_both(spark, d))
