"""Places of personal details: spans in order of rules, without overlap, in the places of the text as it was given.

A rule reads what earlier rules have left: what they found is overwritten, letter for letter, by marks that no rule reads over, so
places never move and no two spans meet. Folding digits keeps places too; characters that show nothing are taken out first, and
spans are mapped back over them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import privacy
from quillspark.operators.records import bounded_batches, written

#: Private characters: MARK + n begins what rule n found, FILL goes on with it. In a text itself they count as TAKEN.
MARK, FILL, TAKEN = 0xE100, "\ue000", "\ue001"
MARKS = re.compile(rf"[{chr(MARK)}-{chr(MARK + 0xFF)}]{FILL}*")
SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"
#: What is masked with numbers: texts that look like a tag of ours first, so that they aren't taken for one on the way back.
MASKED = {"tag": privacy.OWN_TAG} | privacy.RULES


def _own(rule: str) -> str:
    """A rule that doesn't read over marks: only negated classes could."""
    return rule.replace("[^ \\t\\r\\n<>]", f"[^ \\t\\r\\n<>{FILL}{chr(MARK)}-{chr(MARK + 0xFF)}]")


def marked(rows: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """rows with a column `marked`: the folded text in which everything found is overwritten."""
    columns = rows.columns
    private = "".join([FILL, *(chr(MARK + i) for i in range(0x100))])
    start = F.translate(privacy.without_invisible(privacy.folded(F.col(text))), private, TAKEN * len(private))
    out = rows.select(*columns, F.explode(F.array(start)).alias("marked"))
    for i, rule in enumerate(map(_own, rules.values())):
        mark = F.lit(chr(MARK + i))
        parts = F.arrays_zip(F.split("marked", rule, -1).alias("gap"), F.regexp_extract_all("marked", F.lit(rule), F.lit(0)).alias("hit"))
        put = F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.when(x["hit"].isNull(), "").otherwise(F.concat(mark, F.repeat(F.lit(FILL), F.length(x["hit"]) - 1))))), "")
        # a generator of one row: the next rule reads the text and doesn't make it again
        out = out.select(*columns, F.explode(F.array(F.when(F.col("marked").rlike(rule), put).otherwise(F.col("marked")))).alias("marked"))
    return out


def _places(kinds: list[str]):
    hidden = re.compile(f"[{privacy.INVISIBLE}]")

    def spans(marks: pd.Series, texts: pd.Series, sizes: pd.Series) -> pd.Series:
        def of(mark: str | None, text: str | None, sizes: list | None) -> list:
            found, at = [], 0
            if mark is None:
                return found
            for line, own, size in zip(mark.split("\n"), text.split("\n"), sizes, strict=True):
                kept = [i for i, c in enumerate(own) if c not in privacy.INVISIBLE] if hidden.search(own) else None
                for m in MARKS.finditer(line):
                    start, end = (m.start(), m.end()) if kept is None else (kept[m.start()], kept[m.end() - 1] + 1)
                    found.append({"start": at + start, "end": at + end, "kind": kinds[ord(line[m.start()]) - MARK], "value": own[start:end]})
                at += int(size) + 1
            return found

        return pd.Series([of(*x) for x in zip(marks, texts, sizes, strict=True)], dtype=object)

    return F.pandas_udf(spans, SPANS)


def found(docs: DataFrame, rules: dict[str, str] = privacy.RULES) -> DataFrame:
    """docs: doc_id, text. doc_id, text, spans (start, end, kind, value as written, by start) of each row. Null texts count as empty.

    The patterns run in the JVM, over the lines that may have a detail; only these lines of texts with a find go to Python for their
    places, with how long each line is.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.explode(F.array(privacy.suspects(F.col("text")))).alias("kept"))
    some = lambda c: F.when(F.col("any"), c)
    out = marked(rows, "kept", rules).withColumn("any", F.col("marked").rlike(MARKS.pattern))
    return out.select("doc_id", "text", _places(list(rules))(some(F.col("marked")), some(F.col("kept")), some(F.transform(F.split("text", "\n"), F.length))).alias("spans"))


def listed(rows: DataFrame) -> DataFrame:
    """rows: see found. doc_id, start, end, kind, value."""
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def replaced(text: Column, spans: Column, new: Column) -> Column:
    """The text with the new strings, one for each span, in the places of its spans; what stands between stays as it is."""

    def put(texts: pd.Series, starts: pd.Series, ends: pd.Series, new: pd.Series) -> pd.Series:
        def of(text: str | None, starts: list, ends: list, new: list) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for start, end, x in zip(starts, ends, new, strict=True):
                out += [text[at:start], x]
                at = end
            return "".join([*out, text[at:]])

        return pd.Series([of(*x) for x in zip(texts, starts, ends, new, strict=True)], dtype=object)

    # texts without a span don't go to Python
    some = lambda c: F.when(F.size(spans) > 0, c)
    return F.coalesce(F.pandas_udf(put, "string")(some(text), some(F.transform(spans, lambda s: s["start"])), some(F.transform(spans, lambda s: s["end"])), some(new)), text)


def book(rows: DataFrame) -> DataFrame:
    """rows: see found. kind, value, tag: each distinct detail's number among its kind, in the order of first appearance (doc_id, then place).

    Values are sorted in ranges and a range's numbers begin after those of the ranges before it: no task sees all values of a kind.
    """
    firsts = listed(rows).groupBy("kind", "value").agg(F.min(F.struct("doc_id", "start")).alias("first")).select("kind", "value", "first.*")
    ranged = written(firsts.repartitionByRange("kind", "doc_id", "start", "value").withColumn("range", F.spark_partition_id()))
    # one row for each kind in each range
    counts = ranged.groupBy("kind", "range").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("before") + F.row_number().over(Window.partitionBy("kind", "range").orderBy("doc_id", "start", "value"))
    numbered = ranged.join(F.broadcast(counts.select("kind", "range", before.alias("before"))), ["kind", "range"])
    return numbered.select("kind", "value", F.concat(F.lit("["), "kind", F.lit("_"), number.cast("string"), F.lit("]")).alias("tag"))


def masked(docs: DataFrame, rules: dict[str, str] = MASKED) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. doc_id, text with a numbered tag in place of each detail, and the book (kind, value, tag).

    Rows of one id and one text are told by both, so repeated rows stay repeated. A detail without a tag in the book is an error.
    """
    rows = written(found(docs, rules).withColumn("version", F.xxhash64("text")))
    known = written(book(rows))
    own = rows.select("doc_id", "version", F.explode("spans").alias("s")).distinct().select("doc_id", "version", F.col("s.start").alias("start"), "s.kind", "s.value")
    tags = own.join(known, ["kind", "value"]).groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "tag"))).alias("tags"))
    tags = tags.withColumnsRenamed({"doc_id": "tags_id", "version": "tags_version"})
    # only texts with a detail move
    some = rows.where(F.size("spans") > 0)
    both = some.join(tags, some["doc_id"].eqNullSafe(tags["tags_id"]) & (some["version"] == tags["tags_version"]), "left")
    new = F.coalesce(F.transform("tags", lambda t: t["tag"]), F.array().cast("array<string>"))
    checked = F.when(F.size(new) == F.size("spans"), new).otherwise(F.raise_error(F.lit("a detail has no tag")).cast("array<string>"))
    put = both.select("doc_id", replaced(F.col("text"), F.col("spans"), checked).alias("text"))
    return put.unionByName(rows.where(F.size("spans") == 0).select("doc_id", "text")), known


def hidden(docs: DataFrame, rules: dict[str, str] = privacy.RULES) -> DataFrame:
    """docs: doc_id, text. The texts with [kind] in place of each detail, everything else as it was written."""
    rows = found(docs, rules)
    return rows.select("doc_id", replaced(F.col("text"), F.col("spans"), F.transform("spans", lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("text"))
