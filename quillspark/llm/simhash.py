"""SimHash near-duplicates by a vantage-point tree over fingerprints.

Fingerprint: words are runs of what is not ASCII white space, A-Z in lower case; shingles of `width` words, repeats
included (fewer words: the whole sequence as one shingle), each hashed by XXH64 with seed 42. A bit is set if it is set in
over half of the hashes. Null and empty texts have no shingle: fingerprint zero, linked as any other.

Tree: every node has a vantage point and a radius that splits its fingerprints by their Hamming distance to it, at the median
of a bounded sample. The upper levels, learned from the sample, are sent to all tasks and deal the fingerprints out to shards:
each goes home by its distances, and as a query to every leaf whose side of each split its ball of the link radius reaches
(the triangle inequality leaves out the other branches). Within a shard the tree goes on over the shard's own fingerprints, by
exact medians, down to leaves that are compared in full.

Only distinct fingerprints are searched, and a shard returns a spanning forest of its links rather than all pairs: no
link between groups is lost, and copies are never paired. A shard's search streams through the tree, so its memory is
some multiples of 8 bytes a fingerprint. A pair is met at the home of its smaller fingerprint's leaf or of its larger one's.
Rows with a null doc_id keep their fingerprint; they never name a component unless all of its rows have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_sample, components, keyed, map_texts, small, small_batches, stored, table, texts_of
from quillspark.operators.text import filter_of, in_filter

SEED = 42
WIDTH = 3
RADIUS = 2
#: Fingerprints that a shard is meant to hold, sampled ones that a leaf of the upper tree is learned from, and leaves at most.
SHARD_ROWS, LEAF_SAMPLE, MOST_LEAVES = 20_000, 32, 4_096
#: Upper levels in any case, so that small and large inputs are searched alike.
LEAST_LEVELS = 2
#: Fingerprints of a leaf within a shard, which are compared in full.
LOCAL_LEAF = 256
#: Pairs that are compared at once.
BLOCK_PAIRS = 1 << 21
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """As a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: k - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(k, 8)
    ones = np.concatenate([np.bincount(raw[:, c], minlength=256) @ _BITS for c in range(8)])
    return int(np.packbits(ones * 2 > k).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp."""

    def start():
        return lambda doc_id, text: {"doc_id": doc_id, "fp": [fingerprint(x, width) for x in text]}

    return map_texts(texts_of(docs), start, "doc_id long, fp long")


def apart(fps: np.ndarray, point: np.ndarray | int) -> np.ndarray:
    """Hamming distances of fingerprints to one."""
    return np.bitwise_count(fps.view(np.uint64) ^ np.int64(point).view(np.uint64)).astype(np.int64)


def split(fps: np.ndarray) -> tuple[int, int] | None:
    """A vantage point of these fingerprints and the radius that halves them; none where no radius parts them.

    The point is that of a few candidates whose distances spread most.
    """
    some = fps[:: max(1, len(fps) // 8)][:8]
    point = max(some, key=lambda p: float(apart(fps, p).std()))
    d = np.sort(apart(fps, point))
    radius = int(d[(len(d) - 1) // 2])
    if radius == d[-1]:
        lower = d[d < radius]
        if not len(lower):
            return None
        radius = int(lower[-1])
    return int(point), radius


def plan(sample: np.ndarray, levels: int) -> list[tuple[int, int] | None]:
    """The upper tree as a heap: children of node i are 2i + 1 (within the radius) and 2i + 2. None: a leaf."""
    nodes: list[tuple[int, int] | None] = [None] * ((1 << levels + 1) - 1)
    own = {0: sample}
    for i in range((1 << levels) - 1):
        here = own.pop(i, None)
        if here is None or len(here) < 2 or (node := split(here)) is None:
            continue
        nodes[i] = node
        near = apart(here, node[0]) <= node[1]
        own[2 * i + 1], own[2 * i + 2] = here[near], here[~near]
    return nodes


def leaves_of(fps: np.ndarray, nodes: list[tuple[int, int] | None], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """leaf, places of the fingerprints that reach it, and whether they are at home there."""
    todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        i, at, home = todo.pop()
        if not len(at):
            continue
        if nodes[i] is None:
            yield i, at, home
            continue
        point, cut = nodes[i]
        d = apart(fps[at], point)
        inner, outer = d - radius <= cut, d + radius > cut
        todo.append((2 * i + 1, at[inner], home[inner] & (d[inner] <= cut)))
        todo.append((2 * i + 2, at[outer], home[outer] & (d[outer] > cut)))


def search(home: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, home) within the radius. Branches that a query's ball doesn't reach are left out."""
    todo = [(np.arange(len(home)), np.arange(len(queries)))]
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        node = split(home[h]) if len(h) > LOCAL_LEAF else None
        if node is None:
            step = max(1, BLOCK_PAIRS // len(h))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                near = np.bitwise_count(queries[some].view(np.uint64)[:, None] ^ home[h].view(np.uint64)[None, :]) <= radius
                x, y = np.nonzero(near)
                yield some[x], h[y]
            continue
        point, cut = node
        near, d = apart(home[h], point) <= cut, apart(queries[q], point)
        todo.append((h[near], q[d - radius <= cut]))
        todo.append((h[~near], q[d + radius > cut]))


def forest(home: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) that join the same fingerprints as all pairs of a query and a home fingerprint within the radius do."""
    values, index = np.unique(np.concatenate([home, queries]), return_inverse=True)
    root = np.arange(len(values))
    h_of, q_of = index[: len(home)], index[len(home) :]
    for q, h in search(home, queries, radius):
        a, b = q_of[q], h_of[h]
        while True:
            x, y = root[a], root[b]
            open_ = np.flatnonzero(x != y)
            if not len(open_):
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def dealt(fps: DataFrame, nodes: list[tuple[int, int] | None], radius: int) -> DataFrame:
    """fp to leaf, fp, home: each at its own leaf, and as a query at all leaves that its ball reaches."""
    sent = fps.sparkSession.sparkContext.broadcast(nodes)

    def run(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for leaf, at, home in leaves_of(x, sent.value, radius):
                yield pa.RecordBatch.from_pydict({"leaf": pa.array(np.full(len(at), leaf), pa.int32()), "fp": pa.array(x[at], pa.int64()), "home": pa.array(home)})

    return fps.mapInArrow(run, "leaf int, fp long, home boolean")


def links_in(rows: DataFrame, radius: int) -> DataFrame:
    """leaf, fp, home to links a, b. Every row of a leaf is a query there; those at home are what is searched."""

    def run(part: pa.Table) -> pa.Table:
        x = part.column("fp").to_numpy().astype(np.int64)
        home = part.column("home").to_numpy(zero_copy_only=False).astype(bool)
        a, b = forest(x[home], x, radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("leaf").applyInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to links a, b whose components are those of all pairs within the radius."""
    n = fps.count()
    if not n:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    levels = min(int(math.log2(MOST_LEAVES)), max(LEAST_LEVELS, math.ceil(math.log2(max(1, n / SHARD_ROWS)))))
    sample = np.array([r["fp"] for r in bounded_sample(fps, "fp", LEAF_SAMPLE << levels).collect()], np.int64)
    return links_in(dealt(fps, plan(np.sort(sample), levels), radius), radius)


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that can be reached)."""
    rows = stored(fingerprints(docs, width), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp"), radius))
    named = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicate texts of a given similarity: no pair is missed.
#
# Each text's distinct shingles are put in one global order. Two texts whose Jaccard similarity is `similarity` or more share
# a shingle within the first n - ceil(similarity * n) + 1 of each (prefix filter), their n differ by that ratio at most
# (length filter), and at their first shared shingle enough of both is left (positional filter). What stands in one prefix,
# before both end, and not in the other is surely missing there (evidence filter). So the pairs that pass hold all that
# count; each is compared in full.
#
# Any order is right. Ours is by how many texts of all hold a shingle, as far as the most frequent ones may be broadcast: rare
# ones first. So passages that many texts share aren't among the keys, and two copies of one text that differ too much to
# count meet by their own edits alone, that is, not at all.
#
# Shingles are also folded into a few hundred parity bits: each shingle that only one of two texts has turns one bit, so bits
# that differ are as many as those shingles at most, and pairs with more than the similarity allows fall where they meet.
#
# Only components are asked for. First texts that link by fingerprint, and each key's texts with a few of them, are compared;
# then all pairs that share a key, pass the filters and aren't in one component yet. The few are those that meet the most
# texts: of edited copies, those with the fewest edits, which are alike enough to most of the others.

#: Shingles that are counted in one part, and shingles that come last at most. They bear on speed, not on results.
PART_SHINGLES, COMMON_MOST = 4_000_000, 500_000
#: Bits of the filter of keys, for each key. They bear on what moves, not on results.
KEY_BITS = 2
#: Texts of each key that its others are compared with before all pairs are.
HUBS = 6
#: Words of 64 bits that a text's shingles are folded into.
WORDS = 8
#: A key's texts are dealt out to tasks by this many.
SALT_ROWS = 2_000
_EPS = 1e-9
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value of each byte (white space: zero, A-Z: as a-z), and whether it is no white space."""
    values = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([c + 32 if 0x41 <= c <= 0x5A else c]), SEED) for c in range(256)), ">u8").astype(np.uint64)
    solid = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
    return np.where(solid, values, np.uint64(0)), solid


_VALUES, _SOLID = _tables()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included: those of their words, mixed in order. Fewer words: the whole sequence."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = _SOLID[raw]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    # a word's hash: its bytes' values, each times a power by its place in the word
    powers = np.cumprod(np.full(int(sizes.max()) + 1, _MIX), dtype=np.uint64)
    raw = raw[starts[0] : ends[-1]]
    starts = starts - starts[0]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    w = np.add.reduceat(_VALUES[raw] * powers[np.minimum(place, len(powers) - 1)], starts)
    w ^= w >> np.uint64(31)
    k = max(1, len(w) - width + 1)
    h = np.full(k, min(len(w), width), np.uint64)
    for at in range(min(len(w), width)):
        h = (h ^ w[at : at + k]) * _MIX
        h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ h >> np.uint64(29)


def _whole(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """id, tie, copy (hash of the text), fp, n (distinct shingles)."""

    def start():
        def work(ids, ties, texts):
            hashes = [shingles(x, width) for x in texts]
            copies = [xxhash.xxh3_128_digest((x or "").encode("utf-8", "replace")) for x in texts]
            return {"id": ids, "tie": ties, "copy": copies, "fp": [_whole(h) for h in hashes], "n": [len(np.unique(h)) for h in hashes]}

        return work

    return map_texts(rows.select("id", "tie", "text"), start, "id long, tie int, copy binary, fp long, n int")


def _common(rows: DataFrame, width: int, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The most frequent shingles as (part, tail) in one long, sorted, and their step in the order (from 1). total: shingles in all.

    Shingles are dealt out by the upper half of their hash and travel as the lower halves, packed, each once a slice of texts with its
    count: some megabytes a part, also where a third of all texts hold one. That two may share part and tail moves them in the
    order and changes no result.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SHINGLES))

    def start():
        def work(texts):
            spots, n = np.unique(np.concatenate([_spot(np.unique(shingles(x, width)), parts) for x in texts]), return_counts=True)
            edges = np.searchsorted(spots >> np.uint64(32), np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges))
            ends = np.append(edges[some], len(spots)).astype(np.int32)
            packed = lambda x: pa.ListArray.from_arrays(ends, x)
            return {"part": some, "tails": packed(spots.astype(np.uint32).view(np.int32)), "counts": packed(n.astype(np.int32))}

        return work

    def counted(key: tuple, part: pa.Table) -> pa.Table:
        tails, counts = (np.concatenate([x.flatten().to_numpy() for x in part.column(c).chunks]) for c in ("tails", "counts"))
        order = np.argsort(tails.view(np.uint32))
        tails = tails.view(np.uint32)[order]
        first = np.flatnonzero(np.append(True, tails[1:] != tails[:-1]))
        tails, n = tails[first], np.add.reduceat(counts[order].astype(np.int64), first)
        often = np.flatnonzero(n > 2)
        step = np.minimum(np.log2(n[often]) * 4, 126).astype(np.int32)
        return pa.table({"spot": (tails[often].astype(np.uint64) | np.uint64(key[0].as_py()) << np.uint64(32)).view(np.int64), "step": step})

    counts = map_texts(rows.select("text"), start, "part int, tails array<int>, counts array<int>").groupBy("part").applyInArrow(counted, "spot long, step int")
    counts = stored(counts, "counts")
    room, least = COMMON_MOST, 127
    for step, k in sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        room -= k
        if room < 0:
            break
        least = step
    got = counts.where(F.col("step") >= least).toArrow()
    spots = got.column("spot").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(spots)
    return parts, spots[order], got.column("step").to_numpy().astype(np.uint64)[order]


def _spot(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _prefix(h: np.ndarray, common: tuple[int, np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a text's distinct shingles in the global order: its step, then its hash. Texts without any share one key."""
    own = np.unique(h)
    n = len(own)
    if not n:
        return np.full(1, -1, np.int64)
    key = own >> np.uint64(8)
    parts, spots, step = common
    if len(spots):
        spot = _spot(own, parts)
        at = np.minimum(np.searchsorted(spots, spot), len(spots) - 1)
        key |= np.where(spots[at] == spot, step[at], np.uint64(0)) << np.uint64(56)
    return np.sort(key)[: n - math.ceil(similarity * n - _EPS) + 1].view(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    """Of each of 64 * WORDS classes of shingles, whether a text's distinct ones in it are odd in number."""
    odd = np.bincount((np.unique(h) >> np.uint64(16)) % np.uint64(64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(rows: DataFrame, width: int, similarity: float, total: int) -> DataFrame:
    """id, tie, keys, bits."""
    sent = rows.sparkSession.sparkContext.broadcast(_common(rows, width, total))

    def start():
        common = sent.value

        def work(ids, ties, texts):
            hashes = [shingles(x, width) for x in texts]
            packed = lambda x: pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate(x))
            return {"id": ids, "tie": ties, "keys": packed([_prefix(h, common, similarity) for h in hashes]), "bits": packed([_bits(h) for h in hashes])}

        return work

    return map_texts(rows.select("id", "tie", "text"), start, "id long, tie int, keys array<long>, bits array<long>")


def _shared(prefixes: DataFrame) -> DataFrame:
    """prefixes: node, n, keys, bits. node, n, bits, pos, key, before (the key before it), holders: keys that several texts have, where those may meet.

    Keys are counted packed first, which leaves a filter of bounded size; only what passes it moves with its text, and is counted exactly.
    A key whose texts all have one key before it is left out: they meet at that one.
    """
    spark = prefixes.sparkSession
    small_batches(spark)
    total = prefixes.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SHINGLES))
    sent = spark.sparkContext.broadcast(filter_of(prefixes, F.col("keys"), 2, parts, max(KEY_BITS * total, 8 * parts)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, keys, bits = batch.columns
            h = keys.flatten().to_numpy()
            hit = in_filter(h.view(np.uint64), sent.value)
            starts = keys.offsets.to_numpy().astype(np.int64) - keys.offsets[0].as_py()
            row = np.searchsorted(starts, hit, "right") - 1
            pos = hit - starts[row]
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([node.take(own), n.take(own), bits.take(own), pa.array(pos, pa.int32()), pa.array(h[hit], pa.int64()), pa.array(h[hit - 1], pa.int64(), mask=pos == 0)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("node long, n int, bits array<long>, pos int, key long, before long")
    arrow = to_arrow_schema(schema)
    keys = prefixes.select("node", "n", "keys", "bits").mapInArrow(pick, schema)
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.count("before").alias("after"), F.min("before").alias("least"), F.max("before").alias("most"))
    often = often.where("holders > 1 and not (after = holders and least = most)").select("key", "holders")
    return stored(keys.join(often, "key"), "shared")


def _similar(pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b of the rows a, b, left, right (texts) that are as similar as asked for."""

    def start():
        def work(a, b, left, right):
            keep = []
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                s, t = (np.unique(shingles(z, width)) for z in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both >= similarity * (len(s) + len(t) - both) - _EPS or not len(s) + len(t):
                    keep.append(k)
            return {"a": [a[k] for k in keep], "b": [b[k] for k in keep]}

        return work

    return map_texts(pairs.select("a", "b", "left", "right"), start, "a long, b long")


def _meets(n: Column, at: Column, m: Column, to: Column, similarity: float) -> Column:
    """Length and positional filter of two texts of n and m shingles that share those at places `at` and `to`."""
    alike = F.least(n, m) >= similarity * F.greatest(n, m) - _EPS
    return alike & (F.least(n - at, m - to) >= similarity / (1 + similarity) * (n + m) - _EPS)


def _near(n: Column, bits: Column, m: Column, other: Column, similarity: float) -> Column:
    """Parity filter: bits that differ are at most the shingles that one of two texts of n and m shingles has and the other has not."""
    differ = sum((F.bit_count(bits[k].bitwiseXOR(other[k])) for k in range(1, WORDS)), F.bit_count(bits[0].bitwiseXOR(other[0])))
    return differ <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def _could_be(n: str, keys: str, m: str, other: str, similarity: float) -> Column:
    """Length and evidence filter of two texts of n and m shingles with these prefixes."""
    ends = F.least(F.element_at(keys, -1), F.element_at(other, -1))
    both = F.size(F.array_intersect(keys, other))
    missing = lambda k: F.size(F.filter(k, lambda x: x <= ends)) - both
    alike = F.least(n, m) >= similarity * F.greatest(n, m) - _EPS
    return alike & (F.least(F.col(n) - missing(keys), F.col(m) - missing(other)) >= similarity / (1 + similarity) * (F.col(n) + F.col(m)) - _EPS)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_hubs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of each key's texts with some of them: HUBS of those that meet the most texts, such as copies with the fewest edits."""
    weight = shared.groupBy("node").agg(F.sum("holders").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("key", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("class")).agg(F.max(F.struct("weight", "node", "n", "pos", "bits")).alias("hub"))
    alike = _near(F.col("n"), F.col("bits"), F.col("hub.n"), F.col("hub.bits"), similarity)
    met = shared.join(hubs, "key").where(_meets(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), similarity) & alike)
    return met.select(F.col("node").alias("a"), F.col("hub.node").alias("b"))


def _unlinked(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs a, b that share a key, pass the filters and aren't in one component. A key with many texts goes to several tasks.

    Two texts that share a run of keys meet at its first one only: at the others the key before is the same in both, and all
    filters that let them pass there let them pass at that key too.
    """
    rows = stored(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    rows = rows.join(mixed, "key", "left_semi").withColumn("salts", F.ceil(F.col("holders") / SALT_ROWS).cast("int"))
    x = rows.select("key", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "pos", "before", "bits", "root")))
    # the text with fewer shingles has the first one they share within a shorter prefix
    shorter = rows.where(F.col("n") - F.col("pos") >= 2 * similarity / (1 + similarity) * F.col("n") - _EPS)
    y = shorter.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "pos", "before", "bits", "root")))
    first = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") > F.col("y_node")))
    alike = _meets(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"), similarity) & _near(F.col("x_n"), F.col("x_bits"), F.col("y_n"), F.col("y_bits"), similarity)
    starts = ~F.coalesce(F.col("x_before") == F.col("y_before"), F.lit(False))
    met = x.join(y, ["key", "salt"]).where((F.col("x_root") != F.col("y_root")) & first & starts & alike)
    return met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of documents of which one of each near-duplicate group stays (the smallest doc_id), with all their columns.

    Groups are the components of all pairs of the similarity asked for. Rows of one id and one text are one document and
    both stay or go, as it would.
    """
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    rows = keyed(docs.select("doc_id", "text", F.struct(*(others or [F.lit(0)])).alias("rest")), "rest")
    seen = stored(_sketches(rows, width), "sketches")
    shared = bool(seen.where("tie > 0").limit(1).count())
    node = F.xxhash64("copy") if shared else F.min("id")
    texts = seen.groupBy("copy").agg(F.min(F.struct("id", "tie")).alias("stays"), *(F.first(c).alias(c) for c in ("fp", "n")), *([] if shared else [node.alias("node")]))
    texts = stored((texts.withColumn("node", node) if shared else texts).select("stays.*", "node", "fp", "n"), "texts")
    # texts linked by fingerprint: each to the least of its own fingerprint, and that to the group's
    fps = texts.groupBy("fp").agg(F.min("node").alias("least"))
    roots = components(links(fps.select("fp"), radius))
    named = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    own = texts.join(fps, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    wide = named.join(fps.select(F.col("fp").alias("root"), F.col("least").alias("b")), "root").select(F.col("least").alias("a"), "b")
    # texts that share a key
    made = _prefixes(rows, width, similarity, seen.agg(F.sum("n")).first()[0] or 0).dropDuplicates(["id", "tie"])
    prefixes = stored(made.join(texts.select("id", "tie", "node", "n"), ["id", "tie"]).select("node", "n", "keys", "bits"), "prefixes")
    keys = _shared(prefixes)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = stored(_ordered(pairs), "candidates")
        asked = small(stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked"))
        side = prefixes.drop("bits").join(asked, "node", "left_semi")
        side = stored(side, "sides")
        a, b = (side.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"k{c}")) for c in "ab")
        pairs = stored(pairs.join(a, "a").join(b, "b").where(_could_be("na", "ka", "nb", "kb", similarity)).select("a", "b"), "pairs")
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(texts.select("node", "id", "tie"), "node"), "wanted")
        read = stored(rows.select("id", "tie", "text").join(small(wanted), ["id", "tie"]).select("node", "text").dropDuplicates(["node"]), "read")
        both = pairs.join(read.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(read.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
        return stored(_similar(both, width, similarity), "links")

    some = compared(own.unionByName(wide).unionByName(_with_hubs(keys, similarity)))
    rest = compared(_unlinked(keys, components(some), similarity))
    roots = components(some.unionByName(rest))
    stays = texts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "tie")).alias("stays")).select("stays.*")
    goes = stored(seen.select("id", "tie").distinct().join(stays, ["id", "tie"], "left_anti"), "goes")
    return rows.join(small(goes), ["id", "tie"], "left_anti").select("doc_id", "text", *([] if not others else ["rest.*"])).select(*names)
