"""Ordered lists by group: positions, tags, tops that keep their order, marks in texts, pathways, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.text import small, words


def consultations(talks: DataFrame, cases: DataFrame) -> DataFrame:
    """talks: id, case_id (null: general), updated; cases: case_id, trashed. id, case_id, updated: without those of trashed or unknown cases, newest first."""
    live = cases.where("not trashed").select("case_id", F.lit(True).alias("live"))
    return talks.join(live, "case_id", "left").where("case_id is null or live").select("id", "case_id", "updated").orderBy(F.desc("updated"), "id")


def sent_since(sent: DataFrame, cases: DataFrame, since: str) -> DataFrame:
    """One row: how many were sent since then for cases that are neither trashed nor invented."""
    live = cases.where("not trashed and not invented").select("case_id")
    return sent.where(F.col("at") >= F.lit(since).cast("timestamp")).join(live, "case_id").agg(F.count(F.lit(1)).alias("n"))


def next_positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position of a row that is put at the end of each."""
    return rows.groupBy(*keys).agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("position"))


def assigned_tags(people: DataFrame, singles: tuple[str, ...]) -> DataFrame:
    """people: case_id, id, role. tag: [role_n] in order of id within case and role; the first of a role that one person has carries no number."""
    n = F.row_number().over(Window.partitionBy("case_id", "role").orderBy("id"))
    plain = F.col("role").isin(*singles) & (F.col("n") == 1)
    return people.withColumn("n", n).withColumn("tag", F.concat(F.lit("["), "role", F.when(plain, "").otherwise(F.concat(F.lit("_"), "n")), F.lit("]"))).drop("n")


def best(scored: DataFrame, group: str, budget: int) -> DataFrame:
    """scored: group, at, score. The best `budget` of each group, ties by place, numbered in their first order."""
    top = Window.partitionBy(group).orderBy(F.desc("score"), "at")
    kept = scored.withColumn("r", F.row_number().over(top)).where(F.col("r") <= budget)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("at"))).select(group, "at", "place")


def trimmed(patterns: DataFrame, most: int) -> DataFrame:
    """patterns: id, decided, n. The `most` that stay: decided ones first, then by use."""
    return patterns.orderBy(F.desc("decided"), F.desc("n"), "id").limit(most)


def _standing(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts: text and more; phrases: phrase and more, once each. The rest of both, a row for each phrase that stands in a text as whole words.

    A text's runs of the lengths that phrases have meet them by equality: no text goes along with its words, and none is moved.
    """
    phrases = phrases.where("phrase is not null")
    lengths = sorted(r["n"] for r in phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect())
    more = [c for c in texts.columns if c != "text"]
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    w = texts.select(*more, F.explode(F.array(words("text"))).alias("w"))
    runs = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(run, lengths)))
    return w.select(*more, F.explode(runs).alias("phrase")).join(small(phrases), "phrase")


def marks(texts: DataFrame, patterns: DataFrame, most: int = 5) -> DataFrame:
    """texts: id, text; patterns: phrase, instead, sure. id, phrase, instead, rank: phrases that stand in a text as whole words, the surest first.

    Of equal phrases the surest counts.
    """
    one = patterns.groupBy("phrase").agg(F.max(F.struct("sure", "instead")).alias("x")).select("phrase", "x.sure", "x.instead")
    order = Window.partitionBy("id").orderBy(F.desc("sure"), "phrase")
    return _standing(texts.select("id", "text"), one).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("id", "phrase", "instead", "rank")


def joined(parts: DataFrame, separator: str) -> DataFrame:
    """parts: id, at, text, found. id, text, found: texts in order with the separator between them, counters added."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), separator)
    return parts.groupBy("id").agg(text.alias("text"), F.sum("found").alias("found"))


def pathways(starts: DataFrame, free: DataFrame, gaps: tuple[int, ...]) -> DataFrame:
    """starts: id, date; free: date, start (free times). id, step, date, start: each step takes the first free time some days after the one before.

    The first free time from every day on is found once for all; each step is then an equality join by day. Steps without room are null, and so are those after them.
    """
    first = free.groupBy("date").agg(F.min("start").alias("start"))
    span = starts.agg(F.min("date").alias("a"), F.max("date").alias("b")).unionByName(first.agg(F.min("date").alias("a"), F.max("date").alias("b"))).agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    # one row a day: a calendar, not the data
    ahead = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    nexts = days.join(first.withColumnRenamed("date", "day"), "day", "left").withColumn("slot", F.first(F.when(F.col("start").isNotNull(), F.struct(F.col("day").alias("date"), "start")), ignorenulls=True).over(ahead)).select("day", "slot")
    at, out = starts.select("id", F.col("date").alias("day")), None
    for n, gap in enumerate(gaps):
        at = at.withColumn("day", F.date_add("day", gap)).join(nexts, "day", "left").select("id", "slot")
        step = at.select("id", F.lit(n).alias("step"), "slot.date", "slot.start")
        out = step if out is None else out.unionByName(step)
        at = at.select("id", F.col("slot.date").alias("day"))
    return out


def focus(items: DataFrame, held: DataFrame, budget: int) -> DataFrame:
    """items: id, scope, kind, pattern (null: none), score; held: pattern. The best of each scope and kind; items tied to a pattern only where it is held."""
    ok = items.join(held.select("pattern", F.lit(True).alias("held")).distinct(), "pattern", "left").where("pattern is null or held")
    order = Window.partitionBy("scope", "kind").orderBy(F.desc("score"), "id")
    return ok.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("id", "scope", "kind", "rank")


def sentences_of(texts: DataFrame, measures: dict[str, str], most: int = 8) -> DataFrame:
    """texts: id, text; measures: name to word. measure, sentence, rank: different sentences that hold the word, in order of text and place, some each."""
    s = texts.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.!?\n]+")).alias("at", "raw")).select("id", "at", F.trim("raw").alias("sentence"))
    tags = F.array_compact(F.array(*(F.when(F.array_contains(words("sentence"), word), F.lit(name)) for name, word in measures.items())))
    first = s.select("id", "at", "sentence", F.explode(tags).alias("measure")).groupBy("measure", "sentence").agg(F.min(F.struct("id", "at")).alias("x"))
    order = Window.partitionBy("measure").orderBy("x", "sentence")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("measure", "sentence", "rank")


def ranked(paragraphs: DataFrame, candidates: DataFrame) -> DataFrame:
    """paragraphs: id, text; candidates: at, text. id, at, shared, rank: candidates that share words, by how many, ties in their order."""
    a = paragraphs.select("id", F.explode(F.array_distinct(words("text"))).alias("word"))
    b = candidates.select("at", F.explode(F.array_distinct(words("text"))).alias("word"))
    shared = a.join(b, "word").groupBy("id", "at").agg(F.count(F.lit(1)).alias("shared"))
    return shared.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "at")))


def routing(passages: DataFrame, assigned: DataFrame, long_from: int) -> DataFrame:
    """passages: material, at; assigned: material, at, section. material, section, passages (in order), needs_sorting: long materials nothing of which is assigned yet."""
    sizes = passages.groupBy("material").agg(F.count(F.lit(1)).alias("n"))
    got = assigned.join(passages, ["material", "at"], "left_semi").groupBy("material", "section").agg(F.array_join(F.array_sort(F.collect_set("at")), ",").alias("passages"))
    return sizes.join(got, "material", "left").select("material", "section", "passages", (F.col("section").isNull() & (F.col("n") >= long_from)).alias("needs_sorting"))


def record_counts(**kinds: DataFrame) -> DataFrame:
    """patient_id and how many records of each kind it has: one aggregate over all kinds."""
    out = None
    for name, rows in kinds.items():
        part = rows.where("patient_id is not null").select("patient_id", F.lit(name).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("patient_id").agg(*(F.count_if(F.col("kind") == name).alias(name) for name in kinds))


def exposures(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts: text, approved; patterns: phrase. phrase, exposed (approved texts that hold it), all (texts that hold it); a row is a text, whatever its id."""
    found = _standing(texts.select("approved", "text"), patterns.select("phrase").distinct())
    return found.groupBy("phrase").agg(F.count_if("approved").alias("exposed"), F.count(F.lit(1)).alias("all"))


def sheet_habits(scores: DataFrame, least_reports: int = 3, least_scores: int = 8, share: float = 0.1) -> DataFrame:
    """scores: report, near (whether a percentile stands beside it). One row: reports, scores, prints: whether percentiles are printed; null with too few."""
    c = scores.agg(F.count_distinct("report").alias("reports"), F.count(F.lit(1)).alias("scores"), F.count_if("near").alias("near"))
    enough = (F.col("reports") >= least_reports) & (F.col("scores") >= least_scores)
    return c.select("reports", "scores", F.when(enough, F.col("near") >= share * F.col("scores")).alias("prints"))


def shrunk(section: Column, n: Column, overall: Column, prior: float = 8.0) -> Column:
    """A section's mean, drawn to the overall one as far as it rests on few values."""
    return (n * section + prior * overall) / (n + prior)


def outliers(measured: DataFrame, moments: DataFrame, least: float, floor: float = 0.5, prior: float = 8.0) -> DataFrame:
    """measured: id, section, feature, x; moments: section, feature, n, mean, sd. id, feature, z: features of a text far from its section's, whose moments are drawn to those of all sections."""
    w = F.col("n")
    every = moments.groupBy("feature").agg((F.sum(w * F.col("mean")) / F.sum(w)).alias("all_mean"), (F.sum(w * F.col("sd")) / F.sum(w)).alias("all_sd"))
    both = moments.join(every, "feature").select("section", "feature", shrunk(F.col("mean"), w, F.col("all_mean"), prior).alias("m"), shrunk(F.col("sd"), w, F.col("all_sd"), prior).alias("s"))
    z = (F.col("x") - F.col("m")) / F.greatest("s", F.lit(floor))
    return measured.join(both, ["section", "feature"]).select("id", "feature", z.alias("z")).where(F.abs("z") >= least)


#: Cyrillic and Greek letters that look like Latin ones, each with its like, and kinds of quotes and dashes.
ALIKE, LIKE = "АВЕКМНОРСТУХасеорхуіΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEKMHOPCTYXaceopxyiABEZHIKMNOPTYXov"
QUOTES, PLAIN = "“”„‟‘’‚‛´`–—‐‑", "\"\"\"\"''''''----"


def normal(text: Column) -> Column:
    """Lower case, look-alike letters as Latin ones, plain quotes, marks over letters dropped, white space and hyphens as one blank."""
    folded = F.translate(F.translate(F.coalesce(text, F.lit("")), ALIKE, LIKE), QUOTES, PLAIN)
    bare = F.translate(F.lower(folded), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(bare, "[ \t\r\n-]+", " "))


def capped_distance(a: Column, b: Column, cap: int) -> Column:
    """Edit distance; cap + 1 for anything beyond the cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def hashed_names(names: DataFrame, key: str) -> DataFrame:
    """names: id, name. id, hash: keyed hashes of normal forms, once each, so that names can be blocked without being kept."""
    return names.select("id", F.sha2(F.concat(F.lit(key), normal(F.col("name"))), 256).alias("hash")).distinct()


def strings(bodies: DataFrame) -> DataFrame:
    """bodies: id, json (an object). id, string: its keys and values. Not an object: none."""
    m = F.from_json("json", "map<string,string>")
    return bodies.select("id", m.alias("m")).where("m is not null").select("id", F.explode(F.concat(F.map_keys("m"), F.map_values("m"))).alias("string")).where("string is not null")


def generalized(rows: DataFrame, fields: DataFrame, other: str = "work") -> DataFrame:
    """rows: id, job; fields: job, field. id, field: the field of an occupation, a general word for unknown ones."""
    return rows.join(fields.select("job", "field").distinct(), "job", "left").select("id", F.coalesce("field", F.lit(other)).alias("field"))


def recurring(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts: id, text; names: id, name found in that text. id, word, at: every place of a found name's words in its text."""
    w = texts.select("id", F.posexplode(words("text")).alias("at", "word"))
    n = names.select("id", F.explode(words("name")).alias("word")).where(F.length("word") >= 2).distinct()
    return w.join(n, ["id", "word"]).select("id", "word", "at")
