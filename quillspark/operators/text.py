"""Text operators: words, retrieval, phrases, figures, personal details. All in built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.records import bounded_batches, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What counts as a personal detail, in the order in which they are hidden.
DETAILS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "url": r"https?://[^ \n\t]+", "ip": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "digits": r"[0-9]{7,}"}


def words(text: str | Column) -> Column:
    """Lower-case runs of letters, digits and non-ASCII characters; null is none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))), NOT_WORD), "")


def clean_line(text: str) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))


#: Rows of a word and an id that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """Narrow rows are broadcast if there are BROADCAST_ROWS of them at most."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def bm25(passages: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """passages and queries: id, text. query_id, doc_id, score of pairs that share a word.

    Query words are few and are joined first: only their postings move, once, by document. Counts by word and sums by query
    are then made where a document's postings are.
    """
    asked = queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(words("text"))).alias("word"))
    sent = small(asked)
    docs = passages.select(F.col("id").alias("doc_id"), words("text").alias("words")).withColumn("length", F.greatest(F.size("words"), F.lit(1)))
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.greatest(F.avg(F.size("words")), F.lit(1.0)).alias("mean"))
    postings = docs.select("doc_id", "length", F.explode("words").alias("word")).join(small(asked.select("word").distinct()), "word", "left_semi")
    counts = postings.repartition("doc_id").groupBy("doc_id", "length", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    # df and size have a row for each query word and one row
    scored = counts.join(F.broadcast(df) if sent is not asked else df, "word").crossJoin(F.broadcast(size)).select("word", "doc_id", weight.alias("w"))
    return scored.join(sent, "word").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def top_of(rows: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The k best of each group; ties by key. Scores are rounded first, so that the order of summing can't change it."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round(score, 6)), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Hashes of a task that are packed at a time and of a part at most, as estimated; bits of the filter. They bear on speed, not on results.
PACKED, PART_RUNS, FILTER_BITS = 4_000_000, 4_000_000, 1 << 28


def run_hashes(n: int, by: tuple[str, ...] = ()) -> Column:
    """A 64-bit hash of each n words in a row of w, with what else tells runs apart."""
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*by, *(F.get("w", i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def filter_of(rows: DataFrame, hashes: Column, least: int, parts: int, most: int | None = None) -> np.ndarray:
    """A bit for each place of the hashes that `least` rows or more have: parts by places.

    Hashes are dealt out by their upper half and move as the lower halves, sorted, as differences whose bytes stand by weight: two to
    four bytes each. What comes back is the filter, of `most` or FILTER_BITS at most.
    """
    places = max(8, 1 << ((min(most or FILTER_BITS, FILTER_BITS) // parts).bit_length() - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            h = np.concatenate(held)
            spots = np.sort((h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
            edges = np.searchsorted(spots >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(edges))
            tails = [np.diff(spots[edges[p] : edges[p + 1]].astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for p in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(tails, pa.binary())], names=["part", "tails"])

        for batch in batches:
            h = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if len(h):
                held.append(h)
                size += len(h)
            if size >= PACKED:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def often(key: tuple, part: pa.Table) -> pa.Table:
        tails = [np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().cumsum(dtype=np.uint32) for x in part.column("tails")]
        found, n = np.unique(np.concatenate(tails), return_counts=True)
        bits = np.zeros(places, np.uint8)
        bits[found[n >= least] % np.uint32(places)] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bounded_batches(rows.sparkSession)
    got = rows.select(hashes.alias("h")).mapInArrow(pack, "part int, tails binary").groupBy("part").applyInArrow(often, "part int, bits binary").collect()
    out = np.zeros((parts, places // 8), np.uint8)
    for row in got:
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_filter(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes (unsigned) that have a bit; others may share one."""
    parts, size = np.uint64(bits.shape[0]), np.uint32(bits.shape[1] * 8)
    place = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32) % size
    return np.flatnonzero(bits[(h >> np.uint64(32)) % parts, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)


def picked_runs(rows: DataFrame, lengths: tuple[int, ...], bits: np.ndarray, by: tuple[str, ...] = ()) -> DataFrame:
    """rows: id, by, w (words, at least one). id, by, phrase: each row's different runs whose hashes have a bit; others may share one."""
    bounded_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            picked = []
            for c in batch.columns[-len(lengths) :]:
                hit = in_filter(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sent.value)
                starts = c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py()
                ends = np.searchsorted(hit, starts)
                own = np.repeat(starts[:-1], np.diff(ends))
                picked.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hit - own, pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(lengths)], *picked], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = dict(rows.dtypes)
    schema = StructType.fromDDL(", ".join([f"`{c}` {kinds[c]}" for c in rows.columns] + [f"at{n} array<int>" for n in lengths]))
    arrow = to_arrow_schema(schema)
    found = rows.select("*", *(run_hashes(n, by).alias(f"h{n}") for n in lengths)).mapInArrow(pick, schema)
    said_of = lambda n: F.transform(f"at{n}", lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    said = F.array_distinct(F.concat(*map(said_of, lengths)))
    return found.select("id", *by, F.explode(said).alias("phrase"))


def recurring_runs(reports: DataFrame, lengths: tuple[int, ...], least: int, by: tuple[str, ...] = ()) -> DataFrame:
    """reports: id, by, text. by, phrase, reports: runs of these lengths that `least` reports or more have (of one section, or what `by` names).

    Runs are counted by hash first, which leaves a filter of bounded size; only what passes it moves as words, and is counted exactly.
    Rows of one id and section are one report; rows without an id are left out.
    """
    spark = reports.sparkSession
    reports = reports.where("id is not null")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(reports.agg(F.sum(F.length("text"))).first()[0] or 0) * len(lengths) // (2 * PART_RUNS)))
    # a generator of one row: the lambdas then read the words and don't split the text again at each step
    rows = reports.select("id", *by, F.explode(F.array(words("text"))).alias("w")).where(F.size("w") >= min(lengths))
    bits = filter_of(rows, F.array_distinct(F.concat(*(run_hashes(n, by) for n in lengths))), least, parts)
    per = picked_runs(rows, lengths, bits, by)
    once = reports.groupBy("id", *by).agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
    n = F.count(F.lit(1)) if once else F.count_distinct("id")
    return per.groupBy(*by, "phrase").agg(n.alias("reports")).where(F.col("reports") >= least)


def phrases(reports: DataFrame, n: int, least: int) -> DataFrame:
    """reports: id, section, text. section, phrase, reports: phrases of n words in `least` reports of a section or more."""
    return recurring_runs(reports, (n,), least, ("section",))


def closest(scored: DataFrame, least_words: int = 8, boost: float = 1.5) -> DataFrame:
    """scored: query_id, doc_id, score, n_words, same_section. query_id, doc_id: the best of enough words, those of the query's section counted 1.5 times."""
    rows = scored.where((F.col("n_words") >= least_words) & (F.col("score") > 0)).withColumn("score", F.col("score") * F.when(F.col("same_section"), boost).otherwise(1.0))
    return top_of(rows, "query_id", "score", "doc_id", 1).select("query_id", "doc_id")


def wilson_lower(hits: Column, n: Column, z: float = 1.645) -> Column:
    """Lower bound of the score interval."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def detail_counts(docs: DataFrame) -> DataFrame:
    """kind, places, documents of personal details."""
    per = docs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).alias("n")) for k, p in DETAILS.items()))).alias("x")).select("x.*")
    return per.groupBy("kind").agg(F.sum("n").alias("places"), F.count_if(F.col("n") > 0).alias("documents"))


def redacted(text: str) -> Column:
    """Details replaced by their kind."""
    out = F.coalesce(F.col(text), F.lit(""))
    for kind, pattern in DETAILS.items():
        out = F.regexp_replace(out, pattern, f"[{kind}]")
    return out


def masks(docs: DataFrame, kind: str = "email") -> DataFrame:
    """value, tag: each distinct detail's number, in the order of first appearance (doc_id, then place).

    Values are sorted in ranges, and a range's numbers begin after those of the ranges before it: no task sees all values.
    """
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(DETAILS[kind]), F.lit(0))).alias("place", "value"))
    firsts = found.groupBy("value").agg(F.min(F.struct("doc_id", "place")).alias("first")).select("value", "first.*")
    rows = written(firsts.repartitionByRange("doc_id", "place").withColumn("range", F.spark_partition_id()))
    before, starts = 0, []
    for x in rows.groupBy("range").count().orderBy("range").collect():
        starts.append((x["range"], before))
        before += x["count"]
    starts = docs.sparkSession.createDataFrame(starts, "range int, before long")
    number = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("doc_id", "place"))
    return rows.join(F.broadcast(starts), "range").select("value", F.concat(F.lit(f"[{kind}_"), number, F.lit("]")).alias("tag"))


def name_matches(asked: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Both: case_id, name. case_id, name, other, other_name: known names of other cases that share a word of `least` letters or more.

    asked is a stated set of names; known names are met by word, so no case is compared with all. Null cases and names match
    nothing; repeated rows count once.
    """

    def by_word(rows: DataFrame, case: str, name: str) -> DataFrame:
        named = rows.select(F.col("case_id").alias(case), F.col("name").alias(name)).where(F.col(case).isNotNull()).distinct()
        return named.select(case, name, F.explode(F.array_distinct(words(name))).alias("word")).where(F.length("word") >= least)

    met = by_word(asked, "case_id", "name").join(by_word(known, "other", "other_name"), "word")
    return met.where("case_id <> other").select("case_id", "name", "other", "other_name").distinct()
