"""Cross-tokenizer alignment as joins and windows over tokens.

Two tokenizers cut one text (a space put in front): A is byte-level BPE, B is BPE over pieces with byte fallback. Tokens are
exploded with their place; sizes summed up by a window give where each token ends; the two sides are joined by document and
end. Where both end is a cut; the running count of cuts is the group; tokens that end at one cut are linked.

Texts aren't aligned whole. Neither tokenizer joins bytes over a single space between two characters that aren't white
space, so texts are cut there into pieces, and these joins run over the different pieces of the corpus, each being a document of
theirs: a piece that stands in a million texts is encoded and aligned once. How often a pair is linked follows from how
often each piece stands. Texts are then put together from their pieces' rows: texts are dealt into bundles of bounded size, and
each bundle gets the rows of its own pieces, ahead of its texts, so a task holds one bundle's pieces and one batch of texts.

Null and empty texts, and texts whose bytes the tokens don't give back (those that hold U+2581, which B takes for a space), have no
tokens: zeros and ''. Strings of special tokens are plain text. Repeated rows and rows with a null id each have a result of
their own, and each counts. Empty tables give no rows. Further columns are not looked at.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import SLICE_ROWS, freed, small, small_batches, stored, table, texts_of

#: Bytes of text of a bundle, about. A bundle's task holds its different pieces in memory.
BUNDLE_BYTES = 64 << 20
#: A space of which neither neighbour is a space, with no white space of any kind behind it. Java's form and Python's.
CUT, PY_CUT = r" (?<=[^ ] )(?=[^\s\p{Z}\x{85}\x1c-\x1f])", re.compile(r" (?<=[^ ] )(?=\S)")
#: What a text must hold for it to matter which of its spaces are cut at: in others all are.
ODD, PY_ODD = r" (?:[\s\p{Z}\x{85}\x1c-\x1f]|\z)|\A ", re.compile(r" (?:\s|\Z)|\A ")
SPACE = "▁"
TOKENS = ("a", "a_sizes", "b", "b_sizes")
#: Letters under which a text is encoded by rank: that takes time by the square of a word's length.
QUICK = 1_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Pieces:
    """The B tokenizer and the bytes of its entries."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(SPACE in name.lstrip(SPACE) for name in names):
            raise ValueError("pieces of this model go over spaces: texts can't be cut there")
        self.bytes_of = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace(SPACE, " ").encode() for n in names]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Bytes:
    """The A tokenizer. Where its ids stand in the order of its merges, a library encodes short texts by rank, in less time."""

    def __init__(self, path: str):
        self.own = bpe.tokenizer(path)
        self.bytes_of = self.own.bytes_of
        made = [i for i, rank in enumerate(self.own.rank) if rank >= 0]
        in_order = all(self.own.rank[i] < self.own.rank[j] for i, j in zip(made, made[1:], strict=False)) and (not made or made[0] >= 256)
        ranks = {x: i for i, x in enumerate(self.bytes_of) if x and i not in self.own.special.values()}
        self.quick = tiktoken.Encoding("a", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(self, text: str) -> list[int]:
        """The ids of a space and the text; strings of special tokens are plain text."""
        if self.quick and len(text) < QUICK:
            return self.quick.encode_ordinary(" " + text)
        return np.frombuffer(self.own._encode_plain(" " + text), np.int32).tolist()


@functools.lru_cache(2)
def byte_tokens(path: str) -> Bytes:
    return Bytes(path)


def encoded(texts: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The rows (id, text and other columns) with a, a_sizes, b, b_sizes: the ids of both sides and how many bytes each token has. Texts go without the space."""
    a_path, b_path = a_path or bpe.default_path(), b_path or default_path()
    small_batches(texts.sparkSession)
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokens(a_path), pieces(b_path)
        for batch in batches:
            said = batch.column(at).to_pylist()
            of_b = b.model.encode(said, num_threads=1)
            of_a = [a.encode(text) for text in said]
            sizes = []
            for ids, bytes_of in ((of_a, a.bytes_of), (of_b, b.bytes_of)):
                each = [[bytes_of[i] for i in x] for x in ids]
                for text, x in zip(said, each, strict=True):
                    if b"".join(x) != b" " + text.encode():
                        raise ValueError(f"tokens don't give back the bytes of {text[:50]!r}")
                sizes.append([list(map(len, x)) for x in each])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (of_a, sizes[0], of_b, sizes[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], schema=arrow)
        a.own.forget()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*texts.schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in TOKENS)])
    arrow = to_arrow_schema(schema)
    return texts.mapInArrow(run, schema)


@contextlib.contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Meanwhile joins on further columns take rows as they are dealt out by document, and don't shuffle them by all columns."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cuts(dealt: DataFrame) -> DataFrame:
    """id, grp, at_a, at_b: where both sides end, numbered along the document, with the place of the token of either side that ends there.

    dealt: see encoded, dealt out by id.
    """

    def ends(side: str) -> DataFrame:
        rows = dealt.select("id", F.posexplode(f"{side}_sizes").alias(f"at_{side}", "size"))
        until = F.sum("size").over(Window.partitionBy("id").orderBy(f"at_{side}").rowsBetween(Window.unboundedPreceding, 0))
        return rows.select("id", f"at_{side}", until.cast("int").alias("end"))

    both = ends("a").join(ends("b"), ["id", "end"])
    return both.select("id", F.count(F.lit(1)).over(Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("grp"), "at_a", "at_b")


def grouped(tokens: DataFrame) -> DataFrame:
    """id and other columns, groups (a1,a2|b1;a3|b2), links (array of a, b), n_a, n_b of tokens (see encoded).

    Documents are dealt out once, with their tokens as arrays; under joined_in_place no token is shuffled as a row after that.
    A group's tokens are those from the cut before it up to its own.
    """
    dealt = tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    more = [c for c in tokens.columns if c not in ("id", *TOKENS)]
    at = cuts(dealt).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("grp", "at_a", "at_b"))).alias("cuts"))
    rows = dealt.select("id", *more, "a", "b").join(at, "id")

    def said(c: Column, i: Column, side: str) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)[f"at_{side}"] + 1)
        return F.array_join(F.slice(f"said_{side}", begin + 1, c[f"at_{side}"] - begin + 1), ",")

    told = rows.select("*", F.explode(F.array(F.struct(F.col("a").cast("array<string>").alias("said_a"), F.col("b").cast("array<string>").alias("said_b")))).alias("s")).select("id", *more, "a", "b", "cuts", "s.*")
    groups = F.array_join(F.transform("cuts", lambda c, i: F.concat_ws("|", said(c, i, "a"), said(c, i, "b"))), ";")
    links = F.transform("cuts", lambda c: F.struct(F.get("a", c["at_a"]).alias("a"), F.get("b", c["at_b"]).alias("b")))
    return told.select("id", *more, groups.alias("groups"), links.alias("links"), F.size("a").alias("n_a"), F.size("b").alias("n_b"))


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n, best of links a, b, n: how often the pair is linked, and whether no other pair of the same b is linked more often."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def piece_rows(counts: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """text, bundles, groups and numbers of pieces from bundle, text, n (how often each stands in a bundle)."""
    units = counts.groupBy("text").agg(F.sum("n").alias("n"), F.collect_list("bundle").alias("bundles"))
    units = stored(units.withColumn("id", F.monotonically_increasing_id()), "pieces", "zstd")
    tokens = stored(encoded(units, a_path, b_path), "tokens", "zstd")
    with joined_in_place(counts.sparkSession):
        put = stored(grouped(tokens), "groups", "zstd")
    freed(tokens)
    freed(units)
    links = put.select("id", "n", F.explode("links").alias("l")).select("id", "n", "l.a", "l.b")
    pairs = stored(pair_counts(links), "pairs")
    sums = links.drop("n").join(small(pairs), ["a", "b"]).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("best").cast("int")).alias("n_best"), F.sum("n").alias("count_sum"))
    rows = put.select("id", "text", "bundles", "groups", F.size("links").alias("n_groups"), "n_a", "n_b").join(sums, "id")
    out = stored(rows.select("text", "bundles", "groups", *NUMBERS), "piece_rows", "zstd")
    freed(put)
    freed(pairs)
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of one bundle and kind, of SLICE_ROWS rows at most."""
    keys = batch.column("bundle").to_numpy() * 2 + batch.column("kind").to_numpy()
    ends = [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
    at = 0
    for end in ends:
        while at < end:
            size = min(SLICE_ROWS, end - at)
            yield batch.slice(at, size)
            at += size


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (with digest: groups_sha256 in its place) of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts_of(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bundles = -(-max(size, 1) // BUNDLE_BYTES)
    good = F.col("text").isNotNull() & (F.col("text") != "") & ~F.contains(F.col("text"), F.lit(SPACE))
    rows = rows.select("doc_id", F.when(good, F.col("text")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(bundles)).cast("int").alias("bundle"))
    counts = stored(rows.where("text is not null").select("bundle", F.explode(F.when(F.col("text").rlike(ODD), F.split("text", CUT)).otherwise(F.split("text", " "))).alias("text")).groupBy("bundle", "text").agg(F.count(F.lit(1)).alias("n")), "counts", "zstd")
    pieces_of = piece_rows(counts, a_path, b_path)
    freed(counts)
    known = pieces_of.select(F.explode("bundles").alias("bundle"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "text", "groups", *(F.col(c).cast("long").alias(c) for c in NUMBERS))
    texts = rows.select("bundle", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("string").alias("groups"), *(F.lit(None).cast("long").alias(c) for c in NUMBERS))
    said = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place, said_of, numbers, summed = None, {}, [], [], None
        for batch in batches:
            for part in _runs(batch):
                bundle, kind = part.column("bundle")[0].as_py(), part.column("kind")[0].as_py()
                if bundle != here:
                    here, place, said_of, numbers, summed = bundle, {}, [], [], None
                text = part.column("text").to_pylist()
                if kind == 0:
                    place.update(zip(text, range(len(said_of), len(said_of) + len(text)), strict=True))
                    said_of += part.column("groups").to_pylist()
                    numbers.append(np.column_stack([part.column(c).to_numpy() for c in NUMBERS]))
                    continue
                if summed is None:
                    summed, numbers = np.concatenate(numbers or [np.zeros((0, len(NUMBERS)), np.int64)]), []
                sums, told = np.zeros((len(text), len(NUMBERS)), np.int64), []
                for i, x in enumerate(text):
                    found = [] if x is None else list(map(place.__getitem__, PY_CUT.split(x) if PY_ODD.search(x) else x.split(" ")))
                    if found:
                        sums[i] = summed[found].sum(axis=0)
                    groups = ";".join([said_of[at] for at in found])
                    told.append(hashlib.sha256(groups.encode()).hexdigest() if digest and found else groups)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(sums[:, c]) for c in range(len(NUMBERS))), pa.array(told)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, {said} string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    # a task for each bundle
    dealt = known.unionByName(texts).repartitionById(bundles, F.col("bundle")).sortWithinPartitions("bundle", "kind")
    return dealt.mapInArrow(run, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), digest=True)
