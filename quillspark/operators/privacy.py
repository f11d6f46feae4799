"""Personal details: rules in order of priority, tags in their place, the gate that lets a text out, and the way back.

An earlier rule wins: its find is replaced before later rules look, and tags hold no digits. Digits of other scripts are
folded first. Everything is a column expression; only numbered tags need a join (with the book of a set of texts).

No rule reads over the end of a line, and each needs a digit, @, a bracket, :// or www. So rules look at the lines alone that
have one of these, and what is replaced for one rule is made once for all that look after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.text import small

#: Digits of other scripts (Arabic, Persian, Devanagari, full width), each set in order from zero.
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９"
#: Direction marks, joiners and other characters that show nothing.
INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁠⁦⁧⁨⁩﻿­"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Borders of a word of ASCII letters and digits.
A, Z = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Kinds of detail in the order in which they are hidden.
RULES = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "url": r"(?:https?://|www\.)[^ \t\r\n<>]+",
    "ip": rf"{A}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{Z}",
    "iban": rf"{A}[A-Z]{{2}}[0-9]{{2}}(?:[ -]?[0-9A-Z]{{4}}){{3,6}}{Z}",
    "card": rf"{A}[0-9]{{4}}(?:[ -][0-9]{{4}}){{2,3}}{Z}",
    "id": rf"{A}[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}{Z}",
    "phone": rf"(?:\+[0-9]{{1,3}}[ -]?)?\(?{A}[0-9]{{3}}\)?[ -][0-9]{{3}}[ -][0-9]{{4}}{Z}",
    "date": rf"{A}[0-9]{{1,2}}[./][0-9]{{1,2}}[./](?:[0-9]{{4}}|[0-9]{{2}}){Z}|{A}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{Z}|{A}[0-9]{{1,2}} (?:{MONTHS}) [0-9]{{4}}{Z}",
    "year": rf"{A}(?:19[5-9][0-9]|20[0-4][0-9]){Z}",
    "number": rf"\+?{A}[0-9](?:[\-./]?[0-9]){{4,}}{Z}",
}
#: A tag: words in square brackets on one line.
TAG = r"\[[^\[\]\n]{1,60}\]"
OWN_TAG = r"\[(?:tag|" + "|".join(RULES) + r")(?:_[1-9][0-9]{0,17})?\]"
#: A character that a detail, a tag or what is changed before rules look (private characters too) can't do without; see hinted.
#: Ranges, not single characters: each costs a comparison for every character.
HINT = r"[0-9@\[\u00ad\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u200b-\u200f\u202a-\u202e\u2060-\u2069\ue000-\ue1ff\ufeff-\uff19]"
#: Pieces of a text: its tags, what stands between them, and lone brackets.
PIECES = rf"{TAG}|[^\[]+|\["


def folded(text: Column) -> Column:
    """ASCII digits in place of other scripts'."""
    return F.translate(F.coalesce(text, F.lit("")), DIGITS, "0123456789" * 4)


def without_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def hinted(text: Column) -> Column:
    """Whether a text may have a detail at all."""
    return text.rlike(HINT) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))


def suspects(text: Column) -> Column:
    """The text in which lines that can't have a detail are empty; empty as a whole where no line can."""
    lines = lambda x: F.array_join(F.transform(F.split(x, "\n"), lambda line: F.when(hinted(line), line).otherwise("")), "\n")
    return once(F.coalesce(text, F.lit("")), lambda x: F.when(hinted(x), lines(x)).otherwise(""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is made once, however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _by_rule(rest: Column, see: Callable[[str, str, Column], Column], put: Callable[[str], str], rules: tuple = tuple(RULES.items()), seen: tuple = ()) -> Column:
    """see(kind, rule, text) of each rule as an array; what a rule finds is replaced by put(kind) before the next one looks."""
    if not rules:
        return F.array(*seen)
    kind, rule = rules[0]
    return once(rest, lambda r: _by_rule(F.regexp_replace(r, rule, put(kind)), see, put, rules[1:], (*seen, see(kind, rule, r))))


def hidden(text: Column) -> Column:
    """The text with a tag in place of each detail."""

    def line(x: Column) -> Column:
        out = folded(x)
        for kind, rule in RULES.items():
            out = F.regexp_replace(out, rule, f"[{kind}]")
        return F.when(hinted(x), out).otherwise(x)

    return once(F.coalesce(text, F.lit("")), lambda x: F.when(hinted(x), F.array_join(F.transform(F.split(x, "\n"), line), "\n")).otherwise(x))


def counts(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. kind, places, documents of every kind, found by the same order of rules."""
    see = lambda kind, rule, r: F.struct(F.lit(kind).alias("kind"), F.regexp_count(r, F.lit(rule)).alias("n"))
    found = _by_rule(folded(suspects(F.col("text"))), see, lambda kind: f"[{kind}]")
    per = docs.select(F.explode(found).alias("x")).select("x.*")
    return per.groupBy("kind").agg(F.sum("n").alias("places"), F.count_if(F.col("n") > 0).alias("documents"))


def kinds_found(text: Column) -> Column:
    """The kinds of detail that stand in a text, in order; characters that show nothing are taken out and tags blanked first."""
    rest = blank_tags(without_invisible(folded(suspects(text))))
    return F.array_compact(_by_rule(rest, lambda kind, rule, r: F.when(r.rlike(rule), F.lit(kind)), lambda kind: " "))


def in_pieces(text: Column, each) -> Column:
    """The text with each(piece) in place of every tag and of what stands between tags: one pass, results are not read again."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), each), "")


def blank_tags(text: Column) -> Column:
    """Tags as blanks of the same length."""
    return in_pieces(text, lambda x: F.when(x.rlike(f"^{TAG}$"), F.repeat(F.lit(" "), F.length(x))).otherwise(x))


def plain_brackets(text: Column) -> Column:
    """Square brackets that are no tag of ours become round ones."""
    plain = lambda x: F.concat(F.lit("("), F.substring(x, F.lit(2), F.length(x) - 2), F.lit(")"))
    return in_pieces(text, lambda x: F.when(x.rlike(f"^{TAG}$") & ~x.rlike(f"^{OWN_TAG}$"), plain(x)).otherwise(x))


def foreign_tags(text: Column, own: Column) -> Column:
    """The tags of a text that aren't among an array of its own, in order, once each."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(TAG), F.lit(0))), own)


def without_foreign_tags(text: Column, own: Column, instead: str = "(removed)") -> Column:
    return in_pieces(text, lambda x: F.when(x.rlike(f"^{TAG}$") & ~F.array_contains(own, x), F.lit(instead)).otherwise(x))


def remaining_tags(text: Column) -> Column:
    """Tags but for notes of what is missing."""
    return F.filter(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), lambda x: ~x.startswith("[missing"))


def is_mask_tag(tag: Column) -> Column:
    return tag.rlike(r"^\[(?:tag|" + "|".join(RULES) + r")_[1-9][0-9]{0,17}\]$")


def mask_base(tag: Column) -> Column:
    """The kind of a fixed tag; null for any other text."""
    return F.when(tag.rlike(r"^\[(?:" + "|".join(RULES) + r")\]$"), F.substring(tag, F.lit(2), F.length(tag) - 2))


def is_missing_note(tag: Column) -> Column:
    return (tag == "[missing]") | (tag.rlike(r"^\[missing: [^\[\]\n]*\]$") & (F.trim(F.substring(tag, F.lit(11), F.greatest(F.length(tag) - 11, F.lit(0)))) != ""))


def gate(bodies: DataFrame, own_tags: list[str], canaries: list[str], max_bytes: int) -> DataFrame:
    """bodies: id, text. id, reasons (in order), sha256 (null where anything blocks)."""
    text, own = F.coalesce("text", F.lit("")), F.array(*map(F.lit, own_tags)).cast("array<string>")
    trap = F.lit(False)
    for c in canaries:
        trap = trap | F.contains(F.lower(text), F.lit(c.lower()))
    reasons = F.concat(
        F.when(F.octet_length(text) > max_bytes, F.array(F.lit("too_large"))).otherwise(F.array().cast("array<string>")),
        F.transform(kinds_found(text), lambda k: F.concat(F.lit("pattern:"), k)),
        F.when(F.size(foreign_tags(text, own)) > 0, F.array(F.lit("foreign_tag"))).otherwise(F.array().cast("array<string>")),
        F.when(trap, F.array(F.lit("canary"))).otherwise(F.array().cast("array<string>")),
    )
    rows = bodies.select("id", "text", F.explode(F.array(reasons)).alias("reasons"))
    return rows.select("id", F.array_join("reasons", ",").alias("reasons"), F.when(F.size("reasons") == 0, F.sha2(text.cast("binary"), 256)).alias("sha256"))


def gate_with_names(bodies: DataFrame, gated: DataFrame, known: DataFrame, suspects: DataFrame, past: DataFrame, key: str) -> DataFrame:
    """gated: see gate, of the same bodies (id, text; ids are distinct). id, reasons, sha256 with what patterns can't know.

    known: name, payload, rank, declared names (identity, where one stands in the text in any form); suspects: id, word, resolved (suspect,
    where one isn't resolved and its word still stands in the text); past: hash, keyed hashes of names of erased people, word by word, as
    past_hash makes them (past_name). Invisible characters are taken out first.
    """
    from quillspark.operators import names
    from quillspark.operators.edits import raw_words

    texts = bodies.select("id", without_invisible(F.coalesce("text", F.lit(""))).alias("text"))
    told = names.declared(texts.withColumnRenamed("id", "doc_id"), known).select(F.col("doc_id").alias("id"), F.lit("identity").alias("reason")).distinct()
    words = texts.select("id", F.explode(F.array_distinct(F.transform(raw_words(F.col("text")), F.lower))).alias("word"))
    open_ = suspects.where(~F.coalesce("resolved", F.lit(False))).select("id", F.lower("word").alias("word")).distinct()
    # only words that some suspect has move
    left = words.join(small(open_.select("word").distinct()), "word", "left_semi").join(open_, ["id", "word"], "left_semi").select("id", F.lit("suspect").alias("reason")).distinct()
    gone = words.withColumn("hash", past_hash(F.col("word"), key)).join(small(past.select("hash").distinct()), "hash", "left_semi").select("id", F.lit("past_name").alias("reason")).distinct()
    more = told.unionByName(left).unionByName(gone).groupBy("id").agg(F.array_sort(F.collect_list("reason")).alias("more"))
    both = gated.join(more, "id", "left")
    reasons = F.concat_ws(",", F.when(F.col("reasons") != "", F.col("reasons")), F.array_join("more", ","))
    return both.select("id", F.when(F.col("more").isNull(), F.col("reasons")).otherwise(reasons).alias("reasons"), F.when(F.col("more").isNull(), F.col("sha256")).alias("sha256"))


def past_hash(word: Column, key: str) -> Column:
    """A keyed hash of a word in lower case."""
    return F.sha2(F.concat(F.lit(key), F.lower(word)), 256)


def without_refused_lines(text: Column) -> Column:
    """The lines in which the gate finds no detail."""
    clear = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~(hinted(x) & folded(x).rlike("|".join(RULES.values()))))
    return F.array_join(clear, "\n")


def valid_id(digits: Column) -> Column:
    """Nine digits whose sum, every second one doubled (less 9 over 9), is a multiple of ten."""
    each = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(F.transform(each, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.when(digits.rlike("^[0-9]{9}$"), total % 10 == 0), F.lit(False))


def relative_date(date: Column, today: Column) -> Column:
    """A date as a coarse phrase."""
    days = F.abs(F.date_diff(today, date))
    past = date <= today
    amount = (
        F.when(days <= 10, "about a week").when(days <= 17, "about two weeks").when(days <= 25, "about three weeks").when(days <= 45, "about a month").when(days <= 75, "about two months")
        .when(days <= 334, F.concat(F.lit("about "), F.floor((days + 15) / 30).cast("string"), F.lit(" months"))).when(days <= 547, "about a year").when(days <= 912, "about two years")
        .otherwise(F.concat(F.lit("about "), F.floor((days + 182) / 365).cast("string"), F.lit(" years")))
    )
    near = F.when(past, "recently").otherwise("in the coming days")
    return F.when(days <= 3, near).when(past, F.concat(amount, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), amount))


def expand_year(two: Column, today: Column) -> Column:
    """A year of two digits: of this century up to next year, else of the last."""
    return F.when(2000 + two <= F.year(today) + 1, 2000 + two).otherwise(1900 + two)


def infer_year(month: Column, day: Column, today: Column) -> Column:
    """Of a day without a year: the latest that isn't ahead."""
    ahead = (month > F.month(today)) | ((month == F.month(today)) & (day > F.dayofmonth(today)))
    return F.year(today) - ahead.cast("int")


def address_fields(text: Column, label: str = "Address") -> Column:
    """Values after the label on their line, up to two blanks, a tab or a bar; one for each part between commas."""
    values = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{label}: *([^\n\t|]*)"), F.lit(1))
    parts = F.flatten(F.transform(values, lambda v: F.split(F.regexp_extract(v, "^(.*?)(?:  .*)?$", 1), ",")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def restored(docs: DataFrame, book: DataFrame) -> DataFrame:
    """docs: doc_id, text with numbered tags; book: value, tag. The texts with the values again: each tag is read once."""
    from quillspark.operators.records import written

    rows = written(docs.select("doc_id", "text", F.xxhash64("text").alias("version"), F.coalesce(F.col("text").rlike(OWN_TAG), F.lit(False)).alias("tagged")))
    tagged = rows.where("tagged")
    found = tagged.select(F.col("doc_id").alias("tags_id"), F.col("version").alias("tags_version"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(OWN_TAG), F.lit(0)))).alias("tag")).distinct()
    per = found.join(book.select("tag", "value"), "tag").groupBy("tags_id", "tags_version").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("known"))
    back = in_pieces(F.col("text"), lambda x: F.coalesce(F.element_at("known", x), x))
    # only texts with a tag move
    both = tagged.join(per, tagged["doc_id"].eqNullSafe(per["tags_id"]) & (tagged["version"] == per["tags_version"]), "left")
    return both.select("doc_id", F.when(F.col("known").isNull(), F.col("text")).otherwise(back).alias("text")).unionByName(rows.where("not tagged").select("doc_id", "text"))


def filled(template: Column, values: Column) -> Column:
    """A message: {name} gives the map's value (nothing for an unknown name); values are not read again."""
    pieces = F.regexp_extract_all(template, F.lit(r"\{[a-z_]+\}|[^{]+|\{"), F.lit(0))
    value = lambda x: F.coalesce(F.element_at(values, F.regexp_replace(x, "[{}]", "")), F.lit(""))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^\{[a-z_]+\}$"), value(x)).otherwise(x)), "")


def merged_labels(pieces: DataFrame) -> DataFrame:
    """pieces: doc_id, at, label (B, I, O), score. doc_id, first, last, score: runs of a B or I and the I's after it, with their mean score."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("at")
    before, place = F.lag("label").over(order), F.lag("at").over(order)
    starts = (F.col("label") == "B") | ((F.col("label") == "I") & ((F.coalesce(before, F.lit("O")) == "O") | (F.col("at") != place + 1)))
    rows = pieces.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(order)).where("label <> 'O'")
    return rows.groupBy("doc_id", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.avg("score").alias("score")).drop("run")


def span_quality(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold: doc_id, start, end, category; found: doc_id, start, end. category, n, hit: gold spans that a found one overlaps."""
    spans = gold.distinct()
    hits = spans.join(found.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e")), "doc_id").where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))).select(*spans.columns).distinct().withColumn("hit", F.lit(1))
    return spans.join(hits, spans.columns, "left").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"))


def misreads(words: DataFrame, names: DataFrame) -> DataFrame:
    """words: word; names: name. word, name at an edit distance of exactly one.

    Two such words share one form with a letter left out (or one is the other's), so they meet by these forms: no word is
    compared with all names.
    """
    drop = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    forms = lambda c: F.explode(F.array_distinct(F.concat(F.array(c), drop(F.col(c)))))
    a = words.where("word <> ''").distinct().select("word", forms("word").alias("form"))
    b = names.where("name <> ''").distinct().select("name", forms("name").alias("form"))
    return a.join(b, "form").where(F.levenshtein("word", "name") == 1).select("word", "name").distinct()


def phrase_matches(docs: DataFrame, phrases: DataFrame, longest: int = 3) -> DataFrame:
    """docs: doc_id, words; phrases: phrase (words joined by blanks). doc_id, at, n, phrase: leftmost longest, without overlap.

    Each place's runs of words meet the dictionary by equality; what overlaps is settled within a text, over its finds only.
    """
    run = lambda n: F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("phrase"))))
    runs = None
    for n in range(1, longest + 1):
        part = docs.where(F.size("words") >= n).select("doc_id", run(n).alias("x")).select("doc_id", "x.*")
        runs = part if runs is None else runs.unionByName(part)
    found = runs.join(small(phrases.select("phrase").distinct()), "phrase")
    order = F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "phrase")))
    none = F.array().cast("array<struct<at:int,less:int,phrase:string>>")
    end = lambda out: F.when(F.size(out) == 0, F.lit(0)).otherwise(F.get(out, F.size(out) - 1)["at"] - F.get(out, F.size(out) - 1)["less"])
    picked = F.aggregate(order, none, lambda out, x: F.when(x["at"] >= end(out), F.concat(out, F.array(x))).otherwise(out))
    return found.groupBy("doc_id").agg(picked.alias("picked")).select("doc_id", F.explode("picked").alias("x")).select("doc_id", "x.at", (-F.col("x.less")).alias("n"), "x.phrase")


def id_label_near(text: Column) -> Column:
    """Whether nine digits have a label of an ID before or after them, with few characters between."""
    label = "(?i:ID|passport|identity)"
    return text.rlike(rf"{A}{label}{Z}[^0-9\n]{{0,12}}[0-9]{{9}}(?![0-9])|(?<![0-9])[0-9]{{9}}[^0-9\n]{{0,12}}{A}{label}{Z}")


def bare_years(text: Column) -> Column:
    """Years that are neither right after a word of age or score nor right before a unit."""
    kept = rf"(?<!(?i:age|aged|score|scored|iq) ){RULES['year']}(?! ?(?:cm|mm|kg|mg|ml|%|points)(?![A-Za-z]))"
    return F.regexp_extract_all(text, F.lit(kept), F.lit(0))
