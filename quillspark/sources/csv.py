"""A CSV sink whose cells a spreadsheet can't take for formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a spreadsheet takes for the start of a formula.
FORMULA = r"^[=+\-@\t\r]"


def csv_cell(text: Column) -> Column:
    """One cell: a formula's start gets an apostrophe, commas, quotes and line breaks get quotes. Null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def line_of(columns: list[str]) -> Column:
    return F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns))


def lines(rows: DataFrame) -> DataFrame:
    """line: the cells of each row, in the columns' order."""
    return rows.select(line_of(rows.columns).alias("line"))


def write(rows: DataFrame, path: str) -> None:
    """A folder of text files, one for each partition; lines end with CRLF."""
    lines(rows).write.option("lineSep", "\r\n").text(path)
