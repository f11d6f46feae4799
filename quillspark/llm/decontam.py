"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of lower-case letters, digits and non-ASCII characters. A seed hashes the words that a fixed mask keeps of 8
consecutive ones and ignores the others, so a substituted word spoils few seeds. Test items' and documents' seeds are
joined; each hit gives an alignment (document position less item position), and the words around it are compared: the
document overlaps the item if any `WINDOW` consecutive item words (all of a shorter item) have at most 2 substitutions
there (1 for 10 to 12 words, none for 8 or 9).

The mask 11010011 meets every window of 13 words with 2 substitutions and of 10 to 12 with one (checked for all of them
in the tests), so the search is exact. Items of 1 to 7 words have no seed: a document overlaps them if it holds all their
words in a row. Items without a word match nothing.

A hash can collide without harm: only compared words count. Null texts have no words. Rows are told apart by doc_id and
text; repeated rows each give their own. Repeated items of one item_id and text count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import small, stored, table

WINDOW, MOST_CHANGED = 13, 2
MASKS = ("11010011",)
SPAN = 8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def seeds_of(words: Column) -> Column:
    """An array with the seeds of each place, mask by mask."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def at(h: Column, i: Column, mask: str) -> Column:
        return F.xxhash64(F.lit(mask), *(F.get(h, i + k) for k, keep in enumerate(mask) if keep == "1"))

    # the words' hashes are made once: an array of one array is walked through
    per = F.transform(F.array(hashed), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), lambda i: F.array(*(at(h, i, m) for m in MASKS)) if len(MASKS) > 1 else at(h, i, MASKS[0])))
    found = F.get(per, F.lit(0))
    found = F.flatten(found) if len(MASKS) > 1 else found
    return F.when(F.size(words) >= SPAN, found)


def once(value: Column) -> Column:
    """A generator of one row: what is built on its column doesn't compute it again, as a projection's would."""
    return F.explode(F.array(value))


def allowed(window: Column) -> Column:
    return F.when(window >= WINDOW, MOST_CHANGED).when(window >= 10, 1).otherwise(0)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), item_id, best_equal (most equal words of a window), n_places (alignments that overlap).

    One row for each document (rows of one id and text are one) and item that overlap.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    tests = items.select(items["item_id"].cast("long").alias("item_id"), words_of(items["text"]).alias("item")).distinct().where(F.size("item") >= SPAN)
    tests = tests.withColumn("test", F.xxhash64("item_id", "item"))
    asked = tests.select("test", F.posexplode(seeds_of(F.col("item"))).alias("at", "seed")).select("seed", "test", F.expr(f"at div {len(MASKS)}").alias("item_at"))
    seeds = texts.select("doc_id", "version", F.posexplode(seeds_of(words_of(F.col("text")))).alias("at", "seed")).select("seed", "doc_id", "version", F.expr(f"at div {len(MASKS)}").alias("doc_at"))
    hits = seeds.join(asked, "seed").select("doc_id", "version", "test", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    hits = stored(hits, "hits")
    # texts without a hit are left out before any text moves
    met = small(stored(hits.select(F.col("doc_id").alias("met_id"), F.col("version").alias("met_version")).distinct(), "met"))
    texts = texts.join(met, texts["doc_id"].eqNullSafe(met["met_id"]) & (texts["version"] == met["met_version"]), "left_semi")
    hits = hits.join(tests, "test").drop("test").withColumnsRenamed({"doc_id": "hit_id", "version": "hit_version"})
    both = texts.join(hits, texts["doc_id"].eqNullSafe(hits["hit_id"]) & (texts["version"] == hits["hit_version"]))
    compared = both.select("doc_id", "version", "item_id", "shift", "item", F.least(F.col("shift"), F.lit(0)).alias("skipped"), once(F.slice(words_of(F.col("text")), F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item"))).alias("there"))
    same = compared.select("doc_id", "version", "item_id", "shift", once(F.transform("item", lambda w, q: F.when(F.get("there", q + F.col("skipped")) == w, 1).otherwise(0))).alias("same"))
    width = F.least(F.lit(WINDOW), F.size("same"))
    sums = same.select("doc_id", "version", "item_id", "shift", width.alias("width"), once(F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - width + 1), lambda k: F.aggregate(F.slice("same", k, width), F.lit(0), lambda a, x: a + x)))).alias("equal"))
    return sums.where(F.col("equal") >= F.col("width") - allowed(F.col("width"))).groupBy("doc_id", "version", "item_id").agg(F.max("equal").alias("best_equal"), F.count_distinct("shift").alias("n_places"))


def short_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same columns for items of 1 to 7 words that stand whole in a document; n_places: how often.

    Only runs of the lengths that such items have are made.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    tests = items.select(items["item_id"].cast("long").alias("item_id"), words_of(items["text"]).alias("item")).distinct().where(F.size("item").between(1, SPAN - 1))
    tests = stored(tests.select("item_id", F.size("item").alias("n"), F.array_join("item", " ").alias("run")), "short")
    lengths = [r["n"] for r in tests.select("n").distinct().collect()]
    if not lengths:
        return docs.sparkSession.range(0).selectExpr("id AS doc_id", "id AS version", "id AS item_id", "CAST(id AS INT) AS best_equal", "id AS n_places")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), once(words_of(text)).alias("w"))
    none = F.array().cast("array<string>")
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).otherwise(none)
    met = texts.select("doc_id", "version", F.posexplode(F.concat(none, *map(runs, lengths))).alias("at", "run")).join(small(tests), "run")
    # rows of one id and text are one
    met = met.select("doc_id", "version", "item_id", "n", "at").distinct()
    return met.groupBy("doc_id", "version", "item_id").agg(F.max("n").alias("best_equal"), F.count(F.lit(1)).alias("n_places"))


def all_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """overlaps and short_overlaps together."""
    return overlaps(docs, items).unionByName(short_overlaps(docs, items))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that overlap no item, with all their columns."""
    found = all_overlaps(docs, items)
    bad = small(stored(found.select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct(), "bad"))
    version = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (version == bad["bad_version"]), "left_anti")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, best_equal, n_places of every overlap."""
    return all_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "best_equal", "n_places")


#: Four of a window's words stand together unchanged, so pairs of places with four equal words hold every alignment.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, len(w) AS m FROM b WHERE len(w) >= 8),
bg AS (SELECT item_id, w, m, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT *, unnest(range(1, m - 2)) AS i FROM bi)),
dg AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM d)),
al AS (SELECT DISTINCT dg.doc_id, bg.item_id, dg.i - bg.i AS shift FROM dg JOIN bg USING (g)),
eq AS (SELECT doc_id, item_id, shift, m, q, CASE WHEN q + shift BETWEEN 1 AND len(dw) AND dw[q + shift] = iw[q] THEN 1 ELSE 0 END AS same
  FROM (SELECT al.*, d.w AS dw, bi.w AS iw, bi.m, unnest(range(1, bi.m + 1)) AS q FROM al JOIN d USING (doc_id) JOIN bi USING (item_id))),
win AS (SELECT doc_id, item_id, shift, m, q, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS equal FROM eq),
ok AS (SELECT doc_id, item_id, shift, max(equal) AS equal, least(m, 13) AS width FROM win WHERE q <= greatest(m - 12, 1) GROUP BY doc_id, item_id, shift, m)
SELECT doc_id, item_id, CAST(max(equal) AS INTEGER) AS best_equal, count(DISTINCT shift) AS n_places FROM ok
WHERE equal >= width - CASE WHEN width >= 13 THEN 2 WHEN width >= 10 THEN 1 ELSE 0 END GROUP BY doc_id, item_id
UNION ALL
SELECT doc_id, item_id, CAST(max(m) AS INTEGER), count(*) FROM (SELECT doc_id, item_id, len(b.w) AS m, unnest(range(1, len(d.w) - len(b.w) + 2)) AS i, d.w AS dw, b.w AS iw FROM b JOIN d ON len(b.w) BETWEEN 1 AND least(7, len(d.w)))
WHERE dw[i:i + m - 1] = iw GROUP BY doc_id, item_id
"""
