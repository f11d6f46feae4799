"""Files as tables: bytes to text, recognised words to lines, records by range, and the income file's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.ledger import month_of

#: What Windows-1252 has for the bytes 80 to 9F that it defines, in order.
DEFINED = [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]
SIGNS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark, or else Windows-1252; null for bytes that are neither (its five undefined ones, and zero bytes)."""
    plain = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    zero = F.hex(plain).rlike("^(?:..)*00")
    undefined = F.hex(plain).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    return F.when(~zero & F.is_valid_utf8(plain.cast("string")), plain.cast("string")).when(~zero & ~undefined, F.translate(F.decode(plain, "iso-8859-1"), "".join(map(chr, DEFINED)), SIGNS))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text (null: no text) of a folder's files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def recognised_lines(words: DataFrame) -> DataFrame:
    """words: page, block, par, line, word, conf, text. page, text (lines in order, an empty one between blocks' paragraphs), conf: mean of words with a confidence."""
    real = words.where(F.trim("text") != "")
    lines = real.groupBy("page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("t"), F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("s"), F.count(F.when(F.col("conf") >= 0, 1)).alias("n"))
    pars = lines.groupBy("page", "block", "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("t"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return pars.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "t"))), lambda x: x["t"]), "\n\n").alias("text"), F.round(F.sum("s") / F.sum("n"), 4).alias("conf"))


def of_kind(rows: DataFrame, kind: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """rows: kind, day, id. Records of a kind, in a range of days; the filters reach the scan."""
    out = rows.where(F.col("kind") == kind)
    return out if first is None else out.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def strict(rows: DataFrame, readable: Column) -> DataFrame:
    """The rows, or an error as soon as one can't be read."""
    return rows.where(F.when(readable, True).otherwise(F.raise_error(F.lit("a row can't be read")).cast("boolean")))


def income_parts(payments: DataFrame, tally: DataFrame, first: str, last: str) -> DataFrame:
    """tally: month, method, amount of erased cards. part (1: listing, 2: month by method, 3: totals), month, label, listed, erased.

    Every month of the period has its total, also without payments.
    """
    live = payments.where(~F.col("voided")).select(month_of().alias("month"), "method", "amount", F.col("id").cast("string").alias("label")).where(F.col("month").between(first, last))
    gone = tally.where(F.col("month").between(first, last))
    zero = F.lit(0).cast("long")
    listing = live.select(F.lit(1).alias("part"), "month", "label", F.col("amount").alias("listed"), zero.alias("erased"))
    both = live.select("month", "method", F.col("amount").alias("listed"), zero.alias("erased")).unionByName(gone.select("month", "method", zero.alias("listed"), F.col("amount").alias("erased")))
    sums = both.groupBy("month", "method").agg(F.sum("listed").alias("listed"), F.sum("erased").alias("erased"))
    start, end = F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01"))
    spine = payments.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    totals = spine.join(sums, "month", "left").groupBy("month").agg(F.coalesce(F.sum("listed"), zero).alias("listed"), F.coalesce(F.sum("erased"), zero).alias("erased"))
    return listing.unionByName(sums.select(F.lit(2).alias("part"), "month", F.col("method").alias("label"), "listed", "erased")).unionByName(totals.select(F.lit(3).alias("part"), "month", F.lit("total").alias("label"), "listed", "erased"))
