"""Style: features of texts, their weighted moments by section, closeness to them, sentences that recur, and the order of topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.text import NOT_WORD, clean_line, words

FEATURES = ("sentence_words", "word_chars", "commas", "questions", "brackets")


def features(docs: DataFrame) -> DataFrame:
    """docs: id, section, weight, text. id, section, weight, feature, x: counts are for 100 words; texts without words are left out."""
    text = F.coalesce("text", F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    n, chars = F.col("n_words"), F.length(F.regexp_replace(text, NOT_WORD, ""))
    rows = docs.select("id", "section", "weight", "text", F.size(words("text")).alias("n_words")).where("n_words > 0")
    x = (n / F.greatest(count("[.!?]+"), F.lit(1)), chars / n, 100 * count(",") / n, 100 * count("[?]") / n, 100 * count("[(]") / n)
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), v.cast("double").alias("x")) for k, v in zip(FEATURES, x, strict=True)))
    return rows.select("id", "section", "weight", F.explode(pairs).alias("f")).select("id", "section", "weight", "f.*")


def word_rates(docs: DataFrame, listed: list[str]) -> DataFrame:
    """docs as for features(). The same columns: each listed word's rate for 100 words of the text, 0 where it does not occur."""
    rows = docs.select("id", "section", "weight", F.explode(F.array(words("text"))).alias("words")).where(F.size("words") > 0)
    rate = lambda w: (100 * F.size(F.filter("words", lambda x: x == w)) / F.size("words")).cast("double")
    pairs = F.array(*(F.struct(F.lit(w).alias("feature"), rate(w).alias("x")) for w in listed))
    return rows.select("id", "section", "weight", F.explode(pairs).alias("f")).select("id", "section", "weight", "f.*")


def moments(measured: DataFrame) -> DataFrame:
    """section, feature, n (sum of weights), mean, sd of weighted values; sd is 0 where n is 1 or less.

    Sums by section and feature only, so that partial sums are taken before the shuffle.
    """
    w, x = F.col("weight"), F.col("x")
    sums = measured.groupBy("section", "feature").agg(F.sum(w).alias("n"), F.sum(w * x).alias("a"), F.sum(w * x * x).alias("b")).where("n > 0")
    var = F.when(F.col("n") > 1, F.greatest(F.col("b") - F.col("a") * F.col("a") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0)
    return sums.select("section", "feature", "n", (F.col("a") / F.col("n")).alias("mean"), F.sqrt(var).alias("sd"))


def closeness(measured: DataFrame, against: DataFrame, floor: float = 0.5) -> DataFrame:
    """id, delta, fidelity: the mean distance from a section's moments in deviations (at least `floor`), and it as 0 to 100."""
    z = F.abs(F.col("x") - F.col("mean")) / F.greatest("sd", F.lit(floor))
    per = measured.join(against.select("section", "feature", "mean", "sd"), ["section", "feature"]).select("id", z.alias("z"))
    return per.groupBy("id").agg(F.avg("z").alias("delta"), (100 * F.avg(F.greatest(1 - F.col("z") / 4, F.lit(0.0)))).alias("fidelity"))


def report_weight(newer: Column) -> Column:
    """Newer reports count more; none counts less than 0.4."""
    return F.greatest(F.pow(F.lit(0.9), newer), F.lit(0.4))


def formulas(reports: DataFrame, least: int = 3, most: int = 6, min_words: int = 3) -> DataFrame:
    """reports: child, section, text. section, sentence, children, rank: sentences, figures made slots, of `least` children or more; a section's top."""
    parts = reports.select("child", "section", F.explode(F.split(F.coalesce("text", F.lit("")), "[.!?]+")).alias("s"))
    said = parts.select("child", "section", clean_line(F.regexp_replace("s", "[0-9]+", "#")).alias("sentence")).where(F.regexp_count("sentence", F.lit(" ")) >= min_words - 1)
    counts = said.distinct().groupBy("section", "sentence").agg(F.count("child").alias("children")).where(F.col("children") >= least)
    order = Window.partitionBy("section").orderBy(F.desc("children"), "sentence")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def topics_read(reports: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """reports: id, section, band, text. id, section, band, t, topic, place (0: first topic, 1: last), words of each topic of a report.

    A passage is a line, or a sentence where there is but one line. It belongs to the topic (t: its number) whose words it
    has most of, the earlier one on a tie; a passage without any continues the topic before it, and is left out where there
    is none. Rows without an id are left out; rows of one id, section and band are read as one report.
    """
    text = F.coalesce("text", F.lit(""))
    full = lambda pattern: F.filter(F.split(text, pattern), lambda x: x.rlike("[^ \t\r\n]"))
    passages = F.when(F.size(full("\n")) >= 2, full("\n")).otherwise(full("[.!?]+"))
    parts = reports.where("id is not null").select("id", "section", "band", F.xxhash64("text").alias("of"), F.posexplode(passages).alias("at", "passage"))
    parts = parts.select("id", "section", "band", "of", "at", F.explode(F.array(words("passage"))).alias("w"))
    count = lambda keys: F.size(F.filter("w", lambda x: x.isin(keys)))
    parts = parts.select("id", "section", "band", "of", "at", F.size("w").alias("n"), F.array(*map(count, topics.values())).alias("hits"))
    own = F.when(F.array_max("hits") > 0, F.array_position("hits", F.array_max("hits")).cast("int") - 1)
    so_far = Window.partitionBy("id", "section", "band").orderBy("of", "at").rowsBetween(Window.unboundedPreceding, 0)
    told = parts.withColumn("t", F.last(own, ignorenulls=True).over(so_far)).where("t is not null")
    per = told.groupBy("id", "section", "band", "t").agg(F.min(F.struct("of", "at")).alias("first"), F.sum("n").alias("words"))
    report = Window.partitionBy("id", "section", "band")
    place = (F.row_number().over(report.orderBy("first")) - 1) / F.greatest(F.count("t").over(report) - 1, F.lit(1))
    return per.select("id", "section", "band", "t", F.element_at(F.array(*map(F.lit, topics)), F.col("t") + 1).alias("topic"), place.alias("place"), "words")


def skeletons(read: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """topics_read() to section, band (null: all reports), topic, rank, share, words, reports: the topics of most reports in their usual order.

    Topics of fewer than `share` of the reports go; so do sections and bands with fewer than `least` reports or two topics.
    words is the upper median, from counts of each length: no list of reports is gathered.
    """
    kind = dict(read.dtypes)["band"]
    both = read.withColumn("band", F.explode(F.array_distinct(F.array(F.lit(None).cast(kind), "band"))))
    lengths = both.groupBy("section", "band", "t", "topic", "words").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"), F.count_if(F.col("place") == 0).alias("firsts"))
    topic = Window.partitionBy("section", "band", "t", "topic")
    lengths = lengths.withColumn("to", F.sum("n").over(topic.orderBy("words"))).withColumn("held", F.sum("n").over(topic))
    median = F.min(F.when(F.col("to") > F.floor(F.col("held") / 2), F.col("words")))
    per = lengths.groupBy("section", "band", "t", "topic").agg(F.max("held").alias("held"), median.alias("words"), F.sum("places").alias("places"), F.sum("firsts").alias("firsts"))
    group = Window.partitionBy("section", "band")
    per = per.withColumn("reports", F.sum("firsts").over(group)).where((F.col("reports") >= least) & (F.col("held") >= share * F.col("reports")))
    rank = F.row_number().over(group.orderBy(F.round(F.col("places") / F.col("held"), 6), "t"))
    per = per.withColumn("kept", F.count("t").over(group)).withColumn("rank", rank).where("kept >= 2")
    return per.select("section", "band", "topic", "rank", (F.col("held") / F.col("reports")).alias("share"), "words", "reports")
