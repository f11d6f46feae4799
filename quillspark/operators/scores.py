"""Score operators: bands, percentiles, pairs before and after, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Closed bands of a scale with mean 100 and deviation 15.
BANDS = [(40.0, 69.0, "very low", 1), (70.0, 79.0, "low", 2), (80.0, 89.0, "low average", 3), (90.0, 109.0, "average", 4), (110.0, 119.0, "high average", 5), (120.0, 129.0, "high", 6), (130.0, 160.0, "very high", 7)]


def band_label(value: Column) -> Column:
    """The band that holds the value; none for one between bands."""
    out = F.lit(None).cast("string")
    for low, high, label, _ in reversed(BANDS):
        out = F.when(value.between(low, high), label).otherwise(out)
    return out


def normal_cdf(z: Column) -> Column:
    """By Abramowitz and Stegun 7.1.26; error below 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def percentile(value: Column, mean: float = 100.0, deviation: float = 15.0) -> Column:
    """As printed: <0.1, >99.9, one decimal below 1 and above 99 (none if it is whole), else a whole number."""
    p = normal_cdf((value - mean) / deviation) * 100
    tenth = F.round(p, 1)
    edge = F.when(tenth == F.round(tenth), F.format_string("%.0f", tenth)).otherwise(F.format_string("%.1f", tenth))
    return F.when(p < 0.1, "<0.1").when(p > 99.9, ">99.9").when((p < 1) | (p > 99), edge).when(p.isNotNull(), F.format_string("%.0f", F.round(p)))


#: Changes worth a look, by scale; other scales have none.
NOTABLE = {"standard": 10.0, "scaled": 3.0, "v_scale": 3.0, "t_concern": 10.0, "t_ability": 10.0}


def score_step(scale: Column) -> Column:
    """The smallest step that scores of the scale are written in."""
    return F.when(scale == "cars", 0.5).otherwise(1.0)


def notable(scale: Column, change: Column) -> Column:
    least = F.lit(None).cast("double")
    for k, v in NOTABLE.items():
        least = F.when(scale == k, v).otherwise(least)
    return F.coalesce(F.abs(change) >= least, F.lit(False))


def critical_value_reasons(values: DataFrame, known: DataFrame, most: float = 20.0) -> DataFrame:
    """values: id, set, measure, value; known: set, measure. id, reason of values that are refused: the first that holds.

    Of repeated ones the first by id is kept.
    """
    sets, measures = known.select("set").distinct().withColumn("has_set", F.lit(True)), known.select("set", "measure").distinct().withColumn("has", F.lit(True))
    first = values.groupBy("set", "measure").agg(F.min("id").alias("first"))
    rows = values.join(sets, "set", "left").join(measures, ["set", "measure"], "left").join(first, ["set", "measure"], "left")
    bad_value = ~F.coalesce((F.col("value") > 0) & (F.col("value") <= most), F.lit(False)) | (F.abs(F.round(F.col("value") * 100) - F.col("value") * 100) > 1e-6)
    reason = F.when(F.col("has_set").isNull(), "unknown_set").when(F.col("has").isNull(), "unknown_measure").when(F.col("id") != F.col("first"), "twice").when(bad_value, "bad_value")
    return rows.select("id", reason.alias("reason")).where("reason is not null")


def compare(before: DataFrame, after: DataFrame, family: tuple[str, ...]) -> DataFrame:
    """Both: person, sheet, instrument, module, measure, scale, value. person, instrument, module, measure, before_instrument, before, after, change, notable.

    A measure is paired with the earlier score of the same instrument and module; only where there is none, and within the
    family, with another instrument's of the same measure and scale. The first sheet wins on both sides.
    """
    new = after.groupBy("person", "instrument", "module", "measure").agg(F.min(F.struct("sheet", "scale", "value")).alias("x")).select("person", "instrument", "module", "measure", "x.scale", F.col("x.value").alias("after"))
    old = before.select("person", "measure", "scale", "sheet", F.col("instrument").alias("before_instrument"), F.col("module").alias("before_module"), F.col("value").alias("before"))
    own = (F.col("before_instrument") == F.col("instrument")) & (F.col("before_module") == F.col("module"))
    kin = (F.col("before_instrument") != F.col("instrument")) & F.col("instrument").isin(*family) & F.col("before_instrument").isin(*family)
    met = new.join(old, ["person", "measure", "scale"]).where(own | kin)
    best = met.groupBy("person", "instrument", "module", "measure", "scale", "after").agg(F.min(F.struct(F.when(own, 0).otherwise(1).alias("far"), "sheet", "before_instrument", "before")).alias("b"))
    change = F.col("after") - F.col("b.before")
    return best.select("person", "instrument", "module", "measure", "b.before_instrument", "b.before", "after", change.alias("change"), notable(F.col("scale"), change).alias("notable"))


def patterns(scores: DataFrame, catalogue: DataFrame, cognitive: tuple[str, ...] = ()) -> DataFrame:
    """scores: sheet, instrument, measure, nth, value; catalogue: instrument, measure, kind (index, subtest). sheet, instrument, pattern.

    The first value of a measure counts, others and measures outside the catalogue don't. Spread of indexes: gap from 15, wide from 23
    (cognitive instruments), flat up to 9 of three or more; subtests, three or more: scatter from 6.
    """
    first = scores.groupBy("sheet", "instrument", "measure").agg(F.min(F.struct("nth", "value")).alias("x")).select("sheet", "instrument", "measure", "x.value")
    rows = first.join(catalogue, ["instrument", "measure"])
    of = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    at = lambda kind: F.when(F.col("kind") == kind, F.struct("value", "measure"))
    per = rows.groupBy("sheet", "instrument").agg(
        (F.max(of("index")) - F.min(of("index"))).alias("spread"), F.count(of("index")).alias("n"), F.min(at("index"))["measure"].alias("low"), F.max(at("index"))["measure"].alias("high"),
        (F.max(of("subtest")) - F.min(of("subtest"))).alias("scatter"), F.count(of("subtest")).alias("m"),
    )
    gap = F.col("spread") >= 15
    found = F.array(
        F.when(gap, F.lit("index_gap")), F.when(gap, F.concat(F.lit("lowest_index:"), "low")), F.when(gap, F.concat(F.lit("highest_index:"), "high")), F.when(F.col("instrument").isin(*cognitive) & (F.col("spread") >= 23), F.lit("index_spread_wide")),
        F.when((F.col("n") >= 3) & (F.col("spread") <= 9), F.lit("flat_profile")), F.when((F.col("m") >= 3) & (F.col("scatter") >= 6), F.lit("subtest_scatter")),
    )
    return per.select("sheet", "instrument", F.explode(F.array_compact(found)).alias("pattern"))


def by_publisher(scores: DataFrame, sets: DataFrame, critical: DataFrame) -> DataFrame:
    """scores: sheet, instrument, measure, value; sets: set, instrument, measure; critical: set, measure, value. sheet, set, measure, place.

    A set counts for a sheet only where each of its measures has a score and a critical value.
    """
    sizes = sets.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    need = sets.join(critical.select("set", "measure", F.col("value").alias("limit")), ["set", "measure"])
    met = scores.join(need, ["instrument", "measure"]).join(sizes, "set")
    own = Window.partitionBy("sheet", "set")
    full = met.withColumn("k", F.count(F.lit(1)).over(own)).withColumn("mean", F.avg("value").over(own)).where("k = size")
    place = F.when(F.col("value") - F.col("mean") >= F.col("limit") - 1e-9, "strength").when(F.col("mean") - F.col("value") >= F.col("limit") - 1e-9, "weakness")
    return full.select("sheet", "set", "measure", place.alias("place")).where("place is not null")


def before_after(sheets: DataFrame) -> DataFrame:
    """sheets: person, measure, at, sheet, value. The last two values of each person and measure: before, after, change."""
    order = Window.partitionBy("person", "measure").orderBy(F.desc("at"), F.desc("sheet"), F.desc("value"))
    two = sheets.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("person", "measure").agg(F.max(F.when(F.col("r") == 2, F.col("value"))).alias("before"), F.max(F.when(F.col("r") == 1, F.col("value"))).alias("after"))
    return two.where("before is not null and after is not null").withColumn("change", F.col("after") - F.col("before"))


def relative_places(sheets: DataFrame, gap: float = 3.0, least: int = 3) -> DataFrame:
    """sheet, measure, place: strengths and weaknesses against the sheet's own mean, where it has enough measures."""
    own = Window.partitionBy("sheet")
    rows = sheets.withColumn("mean", F.avg("value").over(own)).withColumn("n", F.count("value").over(own)).where(F.col("n") >= least)
    place = F.when(F.col("value") - F.col("mean") >= gap, "strength").when(F.col("value") - F.col("mean") <= -gap, "weakness")
    return rows.select("sheet", "measure", place.alias("place")).where("place is not null")


def spreads(sheets: DataFrame, wide: float = 23.0, flat: float = 9.0) -> DataFrame:
    """sheet, spread, shape of sheets with two measures or more."""
    rows = sheets.groupBy("sheet").agg((F.max("value") - F.min("value")).alias("spread"), F.count("value").alias("n")).where("n > 1")
    return rows.select("sheet", "spread", F.when(F.col("spread") >= wide, "wide").when(F.col("spread") <= flat, "flat").otherwise("usual").alias("shape"))
