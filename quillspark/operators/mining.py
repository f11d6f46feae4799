"""What recurs in a corpus: phrases, openings and closings, terms, linking words, list lines; and trends of what is learned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.records import written
from quillspark.operators.text import recurring_runs, wilson_lower, words


def widest_phrases(reports: DataFrame, lengths: tuple[int, ...], least: int, subsume: float) -> DataFrame:
    """reports: id, text. phrase, reports: runs of these lengths in `least` reports, but for those that a longer one holds in nearly as many.

    A longer phrase is met by the shorter ones that it holds: an equality, no pairs of all phrases.
    """
    often = written(recurring_runs(reports, lengths, least))
    inner = lambda n: F.when(F.size("p") > n, F.transform(F.sequence(F.lit(0), F.size("p") - n), lambda i: F.array_join(F.slice("p", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    held = often.select(F.split("phrase", " ").alias("p"), F.col("reports").alias("wide")).select("wide", F.explode(F.concat(*map(inner, lengths))).alias("phrase"))
    return often.join(held.groupBy("phrase").agg(F.max("wide").alias("wide")), "phrase", "left").where(F.coalesce(F.col("wide") < subsume * F.col("reports"), F.lit(True))).select("phrase", "reports")


def sentences(text: str = "text"):
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?;\n]+"), lambda x: F.trim(x) != "")


def shapes(reports: DataFrame, least: int, subsume: float, shown: int) -> DataFrame:
    """reports: id, section, text. section, place (opening, closing), phrase, reports: first 2 to 5 words of first and last sentences that recur.

    One that a longer beginning continues in nearly as many reports gives way; a section's top of each place stays.
    """
    s = reports.select("id", "section", F.explode(F.array(sentences())).alias("s"))
    ends = s.where(F.size("s") > 0).select("id", "section", F.lit("opening").alias("place"), F.get("s", F.lit(0)).alias("text"))
    ends = ends.unionByName(s.where(F.size("s") > 1).select("id", "section", F.lit("closing").alias("place"), F.element_at("s", -1).alias("text")))
    w = ends.select("id", "section", "place", F.explode(F.array(words("text"))).alias("w"))
    heads = w.select("id", "section", "place", F.explode(F.array(*(F.when(F.size("w") >= n, F.array_join(F.slice("w", 1, n), " ")) for n in (2, 3, 4, 5)))).alias("phrase")).where("phrase is not null").distinct()
    often = heads.groupBy("section", "place", "phrase").agg(F.count(F.lit(1)).alias("reports")).where(F.col("reports") >= least)
    parts = F.split("phrase", " ")
    shorter = F.filter(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), " "))), lambda x: x.isNotNull())
    longer = often.select("section", "place", F.col("reports").alias("wide"), F.explode(shorter).alias("phrase")).groupBy("section", "place", "phrase").agg(F.max("wide").alias("wide"))
    keep = often.join(longer, ["section", "place", "phrase"], "left").where(F.coalesce(F.col("wide") < subsume * F.col("reports"), F.lit(True)))
    order = Window.partitionBy("section", "place").orderBy(F.desc("reports"), "phrase")
    return keep.withColumn("r", F.row_number().over(order)).where(F.col("r") <= shown).select("section", "place", "phrase", "reports")


def usual(texts: DataFrame, groups: dict[str, list[str]], least: int) -> DataFrame:
    """texts: id, text; groups of words that name one thing. group, variant, n: the variant used at least so often and more than any other."""
    known = texts.sparkSession.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "group string, variant string")
    used = texts.select(F.explode(words("text")).alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "variant")
    best = used.groupBy("group").agg(F.max(F.struct("n", "variant")).alias("x"), F.max("n").alias("top"))
    ties = used.join(best.select("group", "top"), "group").where("n = top").groupBy("group").agg(F.count(F.lit(1)).alias("k")).where("k = 1")
    return best.join(ties, "group", "left_semi").where(F.col("x.n") >= least).select("group", "x.variant", "x.n")


def other_terms(texts: DataFrame, groups: dict[str, list[str]], hers: DataFrame) -> DataFrame:
    """hers: group, variant (see usual). id, group, written, usual of words that name a thing otherwise."""
    known = texts.sparkSession.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "group string, written string")
    own = texts.select("id", F.explode(F.array_distinct(words("text"))).alias("written")).join(F.broadcast(known), "written")
    return own.join(F.broadcast(hers.select("group", F.col("variant").alias("usual"))), "group").where("written <> usual").select("id", "group", "written", "usual")


def suggestions(edits: DataFrame, most: int, least: int = 3, sure: float = 0.5) -> DataFrame:
    """edits: pattern, changed. pattern, k (changes), n (exposures), lower, rank: patterns changed often enough, by certainty times log of exposures."""
    c = edits.groupBy("pattern").agg(F.count_if("changed").alias("k"), F.count(F.lit(1)).alias("n"))
    rows = c.withColumn("lower", wilson_lower(F.col("k"), F.col("n"))).where((F.col("k") >= least) & (F.col("lower") >= sure))
    top = rows.withColumn("score", F.round(F.col("lower") * F.log1p("n"), 6)).orderBy(F.desc("score"), "pattern").limit(most)
    # a short list by now
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pattern"))).drop("score")


def connector_habits(texts: DataFrame, listed: list[str], shown: int = 4, rare: float = 0.1) -> DataFrame:
    """word, n, habit: the linking words used most, and those used under a tenth as often as the first."""
    counts = texts.select(F.explode(words("text")).alias("word")).where(F.col("word").isin(*listed)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are listed words
    ranked = counts.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "word"))).withColumn("top", F.max("n").over(Window.partitionBy()))
    return ranked.where((F.col("r") <= shown) | (F.col("n") < rare * F.col("top"))).select("word", "n", F.when(F.col("r") <= shown, "used").otherwise("rare").alias("habit"))


def unmarked(line):
    """A line without its list mark."""
    return F.regexp_replace(F.trim(line), r"^([-–•*]|[0-9]{1,2}[.)]) *", "")


def recurring_lines(reports: DataFrame, least: int) -> DataFrame:
    """reports: id, text. line, reports: lines of two different words or more, list marks apart, that so many reports have."""
    lines = reports.select("id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw")).select("id", unmarked(F.col("raw")).alias("line"))
    per = lines.where(F.size(F.array_distinct(words("line"))) >= 2).distinct()
    return per.groupBy("line").agg(F.count(F.lit(1)).alias("reports")).where(F.col("reports") >= least)


def trend(values: DataFrame, first: int = 10, alpha: float = 0.2) -> DataFrame:
    """values: key, at, x. key, fit: the running mean of the first values, then an exponential mean.

    In closed form: a value after the first ones weighs alpha * (1 - alpha) ** (how many came after it), so sums are enough.
    """
    order = Window.partitionBy("key").orderBy("at", "x")
    rows = values.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    early = F.least("n", F.lit(first))
    weight = F.when(F.col("i") <= first, F.pow(F.lit(1 - alpha), F.greatest(F.col("n") - first, F.lit(0))) / early).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")))
    return rows.groupBy("key").agg(F.sum(weight * F.col("x")).alias("fit"))


def learned(values: DataFrame, kept: int = 120, span: int = 30) -> DataFrame:
    """values: key, at, x. key, latest and before: means of the latest values and of those before them, of the last `kept`."""
    r = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))
    rows = values.withColumn("r", r).where(F.col("r") <= kept)
    mean = lambda a, b: F.round(F.avg(F.when(F.col("r").between(a, b), F.col("x"))), 4)
    return rows.groupBy("key").agg(mean(1, span).alias("latest"), mean(span + 1, 2 * span).alias("before"))


def list_lines(reports: DataFrame, least_words: int = 2, most_chars: int = 160) -> DataFrame:
    """reports: id, text. id, place, line: the lines that may be items of a list, without mark and end: no brackets, no figures, not too short or long."""
    raw = reports.where("id is not null").select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "raw"))
    line = F.trim(F.regexp_replace(F.trim(unmarked(F.col("raw"))), "[.,;]+$", ""))
    return raw.select("id", "place", line.alias("line")).where((F.regexp_count("line", F.lit(r"\S+")) >= least_words) & (F.length("line") <= most_chars) & ~F.col("line").rlike(r"[\[\]0-9]"))


def list_items(reports: DataFrame, least: int, similarity: float = 0.8, small_words: tuple[str, ...] = ()) -> DataFrame:
    """reports: id, text. item, reports, share, place, nth: lines that are alike, as one item, where `least` reports or more have it.

    Lines are alike whose sets of words (without small ones) are as similar as asked for, and so are those that others connect. The
    item is the wording that most reports have (then the first by letters); place is the median of where a report has it first, and
    items are numbered by it. share is of the reports that have a list line at all.
    """
    from quillspark.operators.overlap import similar_items
    from quillspark.operators.records import components, numbered, written

    kept = F.array_except(F.array_sort(F.array_distinct(words("line"))), F.array(*map(F.lit, small_words)).cast("array<string>"))
    lines = written(list_lines(reports).withColumn("w", F.array_join(kept, " ")).where("w <> ''"))
    sets = written(lines.select("w").distinct().withColumn("set", F.monotonically_increasing_id()))
    near = similar_items(sets.select(F.col("set").alias("id"), F.lit("line").alias("kind"), F.col("w").alias("text")), similarity)
    rooted = sets.join(components(near), F.col("set") == F.col("node"), "left").select("w", F.coalesce("root", "set").alias("group"))
    own = lines.join(rooted, "w")
    wordings = own.groupBy("group", "line").agg(F.count_distinct("id").alias("n")).groupBy("group").agg(F.min(F.struct((-F.col("n")).alias("less"), "line")).alias("best"))
    first = own.groupBy("group", "id").agg(F.min("place").alias("place"))
    whole = lines.agg(F.count_distinct("id").alias("of"))
    found = first.groupBy("group").agg(F.count(F.lit(1)).alias("reports"), F.percentile("place", 0.5).alias("place")).where(F.col("reports") >= least)
    out = found.join(wordings, "group").crossJoin(F.broadcast(whole)).select(F.col("best.line").alias("item"), "reports", (F.col("reports") / F.col("of")).alias("share"), "place")
    return numbered(out, ["place", "item"])
