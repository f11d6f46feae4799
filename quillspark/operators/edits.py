"""Word changes between two wordings of a text, and what is learned from them.

Two texts are aligned by a longest common subsequence of their words. Of alignments of one length the one is taken that, read from
the start, keeps a word where it can and else inserts before it deletes. Rows of the table of lengths are bit vectors, made from
the end of both texts; only every root-of-n-th is kept and the rows between are made again when the walk from the start gets
there. So a pair of n and m words takes memory of about sqrt(n) * m bits, and there is no limit on words.

Null texts count as empty; a text without words keeps nothing (share null) and shows no changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tag in square brackets, or letters and digits with marks inside.
WORD = r"\[[^\[\]\n]{1,60}\]|[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
MOST_DELETED, MOST_REPLACED = 4, 3
#: Words that alone are not worth learning as a deletion.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "is", "it", "of", "on", "or", "the", "to", "was", "with")
RUNS = "array<struct<deleted:int,n_deleted:int,inserted:int,n_inserted:int>>"


def raw_words(text: Column) -> Column:
    """Words as written, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


class _Rows:
    """Rows of common lengths: bit q of row i is clear where the common length of a[i:] and b[j:] grows at j = len(b) - 1 - q."""

    def __init__(self, a: list, b: list):
        self.a, self.full = a, (1 << len(b)) - 1
        self.where: dict = {}
        for q, word in enumerate(reversed(b)):
            self.where[word] = self.where.get(word, 0) | 1 << q
        self.step = math.isqrt(len(a)) + 1
        self.kept = {len(a): self.full}
        row = self.full
        for i in range(len(a) - 1, -1, -1):
            row = self._before(row, i)
            if i % self.step == 0:
                self.kept[i] = row
        self.block: dict[int, int] = {}

    def _before(self, row: int, i: int) -> int:
        hit = row & self.where.get(self.a[i], 0)
        return ((row + hit) | (row - hit)) & self.full

    def __getitem__(self, i: int) -> int:
        """A row; asked for in rising order, each block is made once."""
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            self.block = {}
            last = min(-(-i // self.step) * self.step, len(self.a))
            row = self.kept[last]
            for at in range(last - 1, i - 1, -1):
                row = self.block[at] = self._before(row, at)
        return self.block[i]


def runs_of(a: list, b: list) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Common words, and the runs between them: where a's deleted words begin, how many, where b's inserted ones begin, how many."""
    rows, n, m = _Rows(a, b), len(a), len(b)
    length = lambda row, j: m - j - (row & ((1 << (m - j)) - 1)).bit_count()
    grows = lambda row, j: not row[(m - 1 - j) >> 3] >> ((m - 1 - j) & 7) & 1
    packed = lambda row: row.to_bytes((m + 7) // 8, "little")
    i = j = start_a = start_b = common = 0
    out = []
    down_row = packed(rows[1]) if n else b""
    here_row = packed(rows[0])
    here, down = length(rows[0], 0), length(rows[1], 0) if n else 0

    def close() -> None:
        if i > start_a or j > start_b:
            out.append((start_a, i - start_a, start_b, j - start_b))

    while i < n and j < m:
        same = a[i] == b[j]
        if same:
            close()
            common += 1
        right = here - grows(here_row, j)
        if same or right >= down:
            here, down, j = right, down - grows(down_row, j), j + 1
        if same or right < down:
            i, here, here_row = i + 1, down, down_row
            if i < n:
                down_row, down = packed(rows[i + 1]), length(rows[i + 1], j)
        if same:
            start_a, start_b = i, j
    i, j = n, m
    close()
    return common, out


def aligned(edits: DataFrame) -> DataFrame:
    """edits: id, before, after (and no other columns). id, a, b (words as written), common, runs."""
    rows = edits.select("id", raw_words(F.col("before")).alias("a"), raw_words(F.col("after")).alias("b"))
    lowered = rows.select("id", "a", "b", F.transform("a", F.lower).alias("low_a"), F.transform("b", F.lower).alias("low_b"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [runs_of(x or [], y or []) for x, y in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                runs = [[{"deleted": s, "n_deleted": d, "inserted": t, "n_inserted": k} for s, d, t, k in r] for _, r in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([c for c, _ in found], pa.int32()), pa.array(runs, arrow.field("runs").type)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"id {kind}, a array<string>, b array<string>, common int, runs {RUNS}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return lowered.mapInArrow(run, schema)


def kept_shares(pairs: DataFrame) -> DataFrame:
    """pairs: see aligned. id, n_before, n_after, kept: the share of the words before that stand after, in order; null where there were none."""
    return pairs.select("id", F.size("a").alias("n_before"), F.size("b").alias("n_after"), F.when(F.size("a") > 0, F.col("common") / F.size("a")).alias("kept"))


def changes(pairs: DataFrame, small: tuple[str, ...] = SMALL_WORDS) -> DataFrame:
    """pairs: see aligned. id, at (its place among the words before), from, to (empty: a deletion).

    Replacements of 1 to 3 words by 1 to 3, and deletions of 1 to 4 words that are not all small ones. Tags and figures are not
    learned, nor changes of case alone.
    """
    each = pairs.where(F.size("a") > 0).select("id", F.explode(F.transform("runs", lambda r: F.struct(r["deleted"].alias("at"), F.slice("a", r["deleted"] + 1, r["n_deleted"]).alias("gone"), F.slice("b", r["inserted"] + 1, r["n_inserted"]).alias("new")))).alias("r"))
    gone, new = F.col("r.gone"), F.col("r.new")
    plain = lambda run: ~F.exists(run, lambda w: w.rlike(r"[\[0-9]"))
    said = lambda run: F.array_join(run, " ")
    deletion = F.size(new).eqNullSafe(0) & F.size(gone).between(1, MOST_DELETED) & plain(gone) & F.exists(gone, lambda w: ~F.lower(w).isin(*small))
    replacement = F.size(gone).between(1, MOST_REPLACED) & F.size(new).between(1, MOST_REPLACED) & plain(gone) & plain(new) & (F.lower(said(gone)) != F.lower(said(new)))
    return each.where(deletion | replacement).select("id", F.col("r.at").alias("at"), said(gone).alias("from"), said(new).alias("to"))


def learned(found: DataFrame, texts: DataFrame, small_side) -> DataFrame:
    """found: id, from, to of changes; texts: id, before. from, to, count (changes), exposed (texts that held the words, in any case), lower.

    Changes are written, so texts are aligned once. Texts are looked through for runs of the lengths that changes have; a filter of
    their hashes, of bounded size, lets through what may be some change's words, and only that is compared as words.
    """
    from quillspark.operators.records import written
    from quillspark.operators.text import filter_of, picked_runs, run_hashes, wilson_lower

    counts = written(found.groupBy(F.lower("from").alias("from"), F.lower("to").alias("to")).agg(F.count(F.lit(1)).alias("count")))
    said = counts.select("from").distinct()
    lengths = tuple(range(1, max(MOST_DELETED, MOST_REPLACED) + 1))
    none = F.array().cast("array<bigint>")
    own = F.concat(*(F.when(F.size("w") == n, run_hashes(n)).otherwise(none) for n in lengths))
    bits = filter_of(said.select(F.split("from", " ").alias("w")), own, 1, int(said.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = texts.select("id", F.explode(F.array(F.transform(raw_words(F.col("before")), F.lower))).alias("w")).where(F.size("w") > 0)
    exposed = picked_runs(held, lengths, bits).withColumnRenamed("phrase", "from").join(small_side(said), "from").groupBy("from").agg(F.count_distinct("id").alias("exposed"))
    rows = counts.join(exposed, "from", "left").withColumn("exposed", F.greatest(F.coalesce("exposed", F.lit(0)), F.col("count")))
    return rows.withColumn("lower", wilson_lower(F.col("count"), F.col("exposed")))
