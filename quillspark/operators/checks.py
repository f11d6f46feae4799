"""Checks of written texts and of model answers: dates, kinds of document, slips, citations, assignments, score tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: words of a sentence that is too long.
LONG_SENTENCE = 45
#: Words that mark a line as one about a birth.
BIRTH = ("born", "birth", "dob")
NONE = "array<string>"


def document_date(text: Column) -> Column:
    """The latest date written (d.m.yyyy, d/m/yyyy or yyyy-mm-dd) on a line that isn't about a birth."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.lower(x).rlike("|".join(BIRTH)))
    kept = F.array_join(lines, "\n")
    ours = F.transform(F.regexp_extract_all(kept, F.lit(r"(?<![0-9.])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9])"), F.lit(0)), lambda x: F.try_to_timestamp(F.regexp_replace(x, "/", "."), F.lit("d.M.yyyy")).cast("date"))
    iso = F.transform(F.regexp_extract_all(kept, F.lit(r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"), F.lit(0)), lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))
    return F.array_max(F.filter(F.concat(ours, iso), lambda d: F.year(d).between(1900, 2100)))


#: Fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Digits in up to three parts, and a month by name with what may be a year.
DATE_RUN, MONTH_RUN = r"[0-9]+(?:[./\-][0-9]+){0,2}", rf"(?:{'|'.join(MONTHS)})[ ,]*[0-9]+"


def document_month(text: Column) -> Column:
    """yyyy-MM of the latest date written on a line that isn't about a birth; null where there is none.

    Reads d.m.yyyy and d.m.yy (with dots, slashes or hyphens), m/yyyy, and a month by name before a year. Years are from 1990 to 2099;
    two digits are of this century under 50, else of the last.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.lower(x).rlike("|".join(BIRTH)))
    kept = F.array_join(lines, "\n")

    def month(m: Column, year: Column) -> Column:
        return F.when(m.between(1, 12) & year.between(1990, 2099), year * 100 + m)

    def numeric(run: Column) -> Column:
        parts = F.split(run, r"[./\-]")
        n = lambda i: F.get(parts, F.lit(i)).try_cast("int")
        size = lambda i: F.length(F.get(parts, F.lit(i)))
        short = n(2) + F.when(n(2) < 50, 2000).otherwise(1900)
        full = F.when(n(0).between(1, 31), month(n(1), F.when(size(2) == 4, n(2)).when(size(2) == 2, short)))
        return F.when(F.size(parts) == 3, full).when((F.size(parts) == 2) & (size(1) == 4), month(n(0), n(1)))

    def named(run: Column) -> Column:
        year, name = F.regexp_extract(run, "[0-9]+$", 0), F.regexp_extract(run, "^[A-Za-z]+", 0)
        return F.when(F.length(year) == 4, month(F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int"), year.try_cast("int")))

    found = F.concat(F.transform(F.regexp_extract_all(kept, F.lit(DATE_RUN), F.lit(0)), numeric), F.transform(F.regexp_extract_all(kept, F.lit(MONTH_RUN), F.lit(0)), named))
    latest = F.array_max(found)
    return F.concat(F.floor(latest / 100).cast("string"), F.lit("-"), F.lpad((latest % 100).cast("string"), 2, "0"))


def guess(text: Column, keywords: dict[str, list[str]], head: int = 800) -> Column:
    """The first kind one of whose words stands in the text's head; 'table' where over a fifth of its tokens are numbers, else 'other'."""
    start = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(head)))
    tokens = F.filter(F.split(start, "[ \t\r\n]+"), lambda x: x != "")
    numeric = F.size(F.filter(tokens, lambda x: x.rlike("^[0-9.,:/%-]+$")))
    out = F.when(numeric * 5 > F.size(tokens), "table").otherwise("other")
    for kind, some in reversed(keywords.items()):
        out = F.when(F.arrays_overlap(F.array_remove(F.split(start, "[^a-zà-ÿ]+"), ""), F.array(*map(F.lit, some))), kind).otherwise(out)
    return out


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\r\n]+"), lambda x: x != "")


def doubled_words(text: Column) -> Column:
    """Words of letters that stand twice in a row with nothing but white space between them, once each, in order."""
    t = _tokens(text)
    pairs = F.filter(F.zip_with(t, F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.when((F.lower(a) == F.lower(b)) & a.rlike("^[A-Za-z]+$"), F.lower(a))), lambda x: x.isNotNull())
    return F.array_distinct(pairs)


def unbalanced(text: Column) -> Column:
    """opened (brackets never closed) and stray (closed without one open), as a struct."""
    start = F.struct(F.lit(0).alias("opened"), F.lit(0).alias("stray"))
    step = lambda a, x: F.struct((a["opened"] + F.when(x == "(", 1).when(a["opened"] > 0, -1).otherwise(0)).alias("opened"), (a["stray"] + F.when((x == ")") & (a["opened"] == 0), 1).otherwise(0)).alias("stray"))
    return F.aggregate(F.regexp_extract_all(text, F.lit("[()]"), F.lit(0)), start, step)


def long_sentences(text: Column) -> Column:
    """How many sentences have over LONG_SENTENCE words."""
    parts = F.split(F.regexp_replace(text, r"([0-9])\.([0-9])", "$1,$2"), "[.!?\n]")
    return F.size(F.filter(F.transform(parts, lambda s: F.size(F.filter(_tokens(s), lambda w: w.rlike("[A-Za-z0-9]")))), lambda n: n > LONG_SENTENCE))


def unfinished(text: Column) -> Column:
    """One line of four words or more that ends without a mark and is no list item."""
    t = F.trim(text)
    return ~F.contains(t, F.lit("\n")) & (F.size(_tokens(t)) >= 4) & ~t.rlike(r"[.:?!)\]\"'»…]$") & ~t.rlike(r"^([-–•*]|[0-9]{1,2}[.)]) ")


def polish_notes(text: Column) -> Column:
    """Codes of what should be looked at again, in a fixed order."""
    text = F.coalesce(text, F.lit(""))
    note = lambda bad, code: F.when(bad, F.lit(code))
    return F.array_compact(F.array(
        note(text.rlike(r"\{[^{}\n]*\}|(^|[^A-Za-z])(X{3,}|x{3,}|TODO)([^A-Za-z]|$)|\?\?\?"), "placeholder"), note(F.size(doubled_words(text)) > 0, "doubled_word"), note(text.rlike(r"[A-Za-z,;]  +[A-Za-z]| [,;.!?]( |$)"), "spacing"),
        note(unbalanced(text)["opened"] > 0, "bracket_open"), note(unbalanced(text)["stray"] > 0, "bracket_closed"), note(long_sentences(text) > 0, "long_sentence"), note(unfinished(text), "unfinished"),
    ))


ANSWER = "struct<paragraphs:array<struct<text:string,sources:array<string>>>>"


def cited_paragraphs(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers: id, json; sources: id, source, text. id, nth, cited, unknown (sources), uncited (numbers that stand in none of the id's sources).

    An answer that isn't such JSON has no paragraph.
    """
    known = sources.groupBy("id").agg(F.collect_set("source").alias("known"), F.array_distinct(F.flatten(F.collect_list(numbers(F.col("text"))))).alias("told"))
    rows = answers.select("id", F.posexplode(F.from_json("json", ANSWER)["paragraphs"]).alias("nth", "p")).join(known, "id", "left")
    none = F.array().cast(NONE)
    cited = F.coalesce("p.sources", none)
    return rows.select(
        "id", "nth", F.size(F.array_intersect(cited, F.coalesce("known", none))).alias("cited"), F.array_join(F.array_except(cited, F.coalesce("known", none)), ",").alias("unknown"),
        F.array_join(F.array_except(numbers(F.col("p.text")), F.coalesce("told", none)), ",").alias("uncited"),
    )


def numbers(text: Column) -> Column:
    """Numbers, decimals and pairs such as 5:4 too, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:[.:][0-9]+)*"), F.lit(0)))


def numbers_not_in(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """Both: id, text. id, numbers of the text that stand in none of the id's sources, in order."""
    told = sources.select("id", F.explode(numbers(F.col("text"))).alias("x")).distinct()
    own = texts.select("id", F.posexplode(numbers(F.col("text"))).alias("at", "x"))
    left = own.join(told, ["id", "x"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("l"))
    return left.select("id", F.array_join(F.transform("l", lambda v: v["x"]), ",").alias("numbers"))


def sorted_passages(answers: DataFrame, materials: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers: material, passage, section; materials: material, n_passages; sections: section. Valid assignments, once each, and each material's number of those ignored."""
    rows = answers.join(materials, "material", "left").join(sections.select("section", F.lit(True).alias("known")), "section", "left")
    ok = F.coalesce(F.col("known") & F.col("passage").between(0, F.col("n_passages") - 1), F.lit(False))
    checked = rows.withColumn("ok", ok)
    return checked.where("ok").select("material", "passage", "section").distinct(), checked.groupBy("material").agg(F.count_if(~F.col("ok")).alias("ignored"))


def verdicts(sent: DataFrame, answers: DataFrame, known: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """sent: nth, paragraph; answers: paragraph, verdict, sources (array); known: source. nth, paragraph, verdict, sources: one row for each that was sent.

    The first answer of a paragraph counts by its verdict's order; unknown verdicts and missing answers are 'unchecked', unknown sources are dropped.
    """
    first = answers.groupBy("paragraph").agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, allowed)), F.col("verdict")).alias("place"), "verdict", "sources")).alias("a")).select("paragraph", "a.verdict", "a.sources")
    some = F.array_sort(F.array_distinct("sources"))
    ok = first.select("paragraph", "verdict", F.explode_outer(some).alias("source")).join(known.select("source", F.lit(True).alias("known")), "source", "left")
    ok = ok.groupBy("paragraph", "verdict").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("known"), F.col("source")))), ",").alias("sources"))
    return sent.join(ok, "paragraph", "left").select("nth", "paragraph", F.when(F.col("verdict").isin(*allowed), F.col("verdict")).otherwise("unchecked").alias("verdict"), F.coalesce("sources", F.lit("")).alias("sources"))


SCORE_TAG = r"\[score ([a-z0-9_]+):([a-z0-9_]+)=(-?[0-9]+(?:\.[0-9])?)\]"


def score_tag(instrument: Column, measure: Column, value: Column) -> Column:
    """Whole values without a point, others with one decimal."""
    number = F.when(value == F.round(value), value.cast("long").cast("string")).otherwise(F.format_string("%.1f", value))
    return F.concat(F.lit("[score "), instrument, F.lit(":"), measure, F.lit("="), number, F.lit("]"))


def tagged_scores(texts: DataFrame) -> DataFrame:
    """texts: id, text. id, nth, instrument, measure, value of each score tag."""
    tags = texts.select("id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SCORE_TAG), F.lit(0))).alias("nth", "tag"))
    part = lambda n: F.regexp_extract("tag", SCORE_TAG, n)
    return tags.select("id", "nth", part(1).alias("instrument"), part(2).alias("measure"), part(3).cast("double").alias("value"))
