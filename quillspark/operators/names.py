"""Declared names in running texts: an index by first word, names of any length, short prefixes and endings.

A text's words meet the index by their first word alone, in each form that a word may have (itself, or without prefix letters).
Where a name has more words, the rest is compared with the words that follow: each word carries as many as the longest name has
after its first, so a text is not moved for its names. What overlaps is settled from the left, the longest first, within stretches of matches that touch each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.edits import WORD, raw_words
from quillspark.operators.records import written
from quillspark.operators.text import small

#: Letters that are written together with the word after them, in the orders in which they may stand.
PREFIXES = "ו?(?:ש|כש|לכש|מש)?[בלכמ]?ה?"
#: Endings of a name's last word that don't belong to it.
POSSESSIVE = "['’][sס]$"


def running(sizes: Column) -> Column:
    """The running sums of an array."""

    def sums(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else v.cumsum())

    return F.pandas_udf(sums, "array<int>")(sizes)


def word_places(text: Column) -> Column:
    """An array of start and end (code points) for each word, one after the other."""
    text = F.coalesce(text, F.lit(""))
    parts = F.transform(F.arrays_zip(F.split(text, WORD, -1).alias("gap"), raw_words(text).alias("word")), lambda x: F.array(F.length(x["gap"]), F.coalesce(F.length(x["word"]), F.lit(0))))
    return running(F.flatten(parts))


def forms(word: Column) -> Column:
    """(prefix letters, rest) of a word: itself, and what is left of it without 1 to 3 letters that may be a prefix."""
    rest = lambda n: F.struct(F.lit(n).alias("prefix"), F.substring(word, F.lit(n + 1), F.length(word)).alias("head"))
    # few words begin with such a letter
    could = F.substring(word, 1, 1).isin(*"ושכלמבה")
    split = lambda n: F.when(could & (F.length(word) >= n + 2) & F.substring(word, F.lit(1), F.lit(n)).rlike(f"^{PREFIXES}$"), rest(n))
    return F.array_compact(F.array(rest(0), *(split(n) for n in (1, 2, 3))))


def index(names: DataFrame) -> DataFrame:
    """names: name, payload, rank. first, words, payload: a name's words in lower case; of equal names the least rank counts, then the least payload."""
    rows = names.select(F.transform(raw_words(F.col("name")), F.lower).alias("words"), "payload", "rank").where(F.size("words") > 0)
    best = rows.groupBy("words").agg(F.min(F.struct("rank", "payload")).alias("best"))
    return best.select(F.get("words", F.lit(0)).alias("first"), "words", "best.payload")


def _candidates(texts: DataFrame, known: DataFrame) -> DataFrame:
    """key..., at, n, prefix, tail, payload: every place where a name stands."""
    key = ["doc_id", "version"]
    ends = lambda w: F.when(w.endswith("s") | w.endswith("ס"), F.regexp_replace(w, POSSESSIVE, "")).otherwise(w)
    known = written(known)
    after = (known.agg(F.max(F.size("words"))).first()[0] or 1) - 1
    each = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"), F.slice("words", i + 2, F.lit(after)).alias("next")))
    heads = texts.select(*key, F.explode(each).alias("x")).select(*key, "x.*").select(*key, "at", "next", F.explode(forms(F.col("word"))).alias("f")).select(*key, "at", "next", "f.prefix", "f.head")
    both = heads.select(*key, "at", "next", "prefix", "head", F.explode(F.array_distinct(F.array(F.col("head"), ends(F.col("head"))))).alias("first"))
    met = both.join(small(known), "first").withColumn("n", F.size("words"))
    n, end = F.col("n"), F.element_at("words", -1)
    # longer names: the first word as it is, then the words that follow it
    last = F.get("next", n - 2)
    there = (n > 1) & (F.col("head") == F.col("first")) & (F.size("next") >= n - 1)
    same = (F.slice("next", F.lit(1), F.greatest(n - 2, F.lit(0))) == F.slice("words", F.lit(2), F.greatest(n - 2, F.lit(0)))) & ((last == end) | (ends(last) == end))
    tail = F.when(n == 1, F.length("head") - F.length("first")).otherwise(F.length(last) - F.length(end))
    return met.where((n == 1) | (there & same)).select(*key, "at", "n", "prefix", tail.alias("tail"), "payload")


def declared(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs: doc_id, text; names: name, payload, rank (see index). doc_id, at (place among the words), n, prefix, start, end, payload.

    start and end are code points, without prefix letters and without an ending that isn't the name's. Of the names at a place the
    longest counts, then the one with the fewest prefix letters, then with the shortest ending. Rows of one id and one text are one
    text. Null texts have no words; null names match nothing.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("version"), text.alias("text")).withColumn("words", F.transform(raw_words(F.col("text")), F.lower))
    key = ["doc_id", "version"]
    found = _candidates(texts.select(*key, "words"), index(names)).distinct()
    first = Window.partitionBy(*key, "at").orderBy(F.desc("n"), "prefix", "tail", "payload")
    found = found.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("at") >= F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0))
    found = found.withColumn("apart", apart.cast("int"))
    found = found.withColumn("stretch", F.sum("apart").over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    kept = found.groupBy(*key, "stretch").agg(F.array_sort(F.collect_list(F.struct("at", "n", "prefix", "tail", "payload"))).alias("x"))
    none = F.slice("x", F.lit(1), F.lit(0))
    end = lambda out: F.when(F.size(out) == 0, F.lit(0)).otherwise(F.get(out, F.size(out) - 1)["at"] + F.get(out, F.size(out) - 1)["n"])
    picked = F.aggregate("x", none, lambda out, x: F.when(x["at"] >= end(out), F.concat(out, F.array(x))).otherwise(out))
    picks = kept.select(*key, F.explode(picked).alias("p")).groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("picks"))
    # places of words are made for texts with a name only
    held = picks.join(texts.select(*(F.col(c).alias(f"t_{c}") for c in key), "text").distinct(), F.col("t_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("t_version") == F.col("version")))
    rows = held.select("doc_id", "picks", word_places(F.col("text")).alias("places"))
    spans = rows.select("doc_id", F.explode(F.transform("picks", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), p["prefix"].alias("prefix"), (F.get("places", p["at"] * 2) + p["prefix"]).alias("start"), (F.get("places", (p["at"] + p["n"] - 1) * 2 + 1) - p["tail"]).alias("end"), p["payload"].alias("payload")))).alias("p"))
    return spans.select("doc_id", "p.*")
