"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Which windows of `length` bytes also start earlier (smaller doc_id; in one document, at a smaller offset)?

1. Every window is dealt out by its minimiser: of its 32-byte strings, the one with the least hash. Equal windows have
   equal minimisers, so a window's copies meet at one key. A minimiser that stands in the corpus once ends here.
2. Neighbouring windows with one minimiser are a region. Equal regions of a key collapse: only the first stays, the windows
   of the others are copies. Counts and minima are partial aggregates and joins, so a key with a third of all rows is no one task's.
3. Keys with several different regions go in buckets to the suffix array. It is sorted to a depth of `length`, its
   transform is extended backwards breadth first: from the intervals of strings of l bytes to those of l + 1, each setting
   a boundary with common prefix l where none stands yet, by increasing l, and stopping at `length`. What no boundary
   parts are the copies of one window.
4. Keys with over `REGIONS_MOST` different regions are dealt out again by whole windows, and the first of each is the
   minimum of an aggregate: exact for any number.

Null text counts as empty. Texts under `length` bytes have no window. Documents of one id and one text are one document;
different texts with one id are in the order of a hash. A null id is the largest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import keyed, small, stored, table

LENGTH = 100
#: Bytes of a minimiser; windows must be longer.
GRAM = 32
#: Bytes that are scanned at once: offsets within fit in 20 bits.
SCAN = 1 << 20
#: Bytes of a bucket's text, as far as its keys allow.
BUCKET_BYTES = 1 << 20
REGIONS_MOST = 20_000
#: Copies of a region beyond which it isn't dealt out by key.
HELD_OFTEN = 5_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(SCAN - 1)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8-byte word that starts at each place, big end first; data ends with 8 spare bytes."""
    return np.ndarray((len(data) - 8,), ">u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)


def hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of each string of `gram` bytes."""
    n = len(data) - gram + 1
    x = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    h = x[:n] * _A
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h ^= h >> np.uint64(31)
        h += x[at : at + n]
        h *= _B
    h ^= h >> np.uint64(29)
    h *= _A
    h ^= h >> np.uint64(32)
    return h


def _packed(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side in buffers of SCAN bytes at most: buffer, and of each piece its place, text and offset there."""
    buffer: list[bytes] = []
    at: list[tuple[int, int, int]] = []
    size = 0
    step = SCAN - length + 1
    for k, t in enumerate(texts):
        for start in range(0, max(0, len(t) - length + 1), step):
            piece = t[start : start + SCAN] if len(t) > SCAN else t
            if size + len(piece) > SCAN:
                yield b"".join(buffer), *map(np.array, zip(*at, strict=True))
                buffer, at, size = [], [], 0
            buffer.append(piece)
            at.append((size, k, start))
            size += len(piece)
    if at:
        yield b"".join(buffer), *map(np.array, zip(*at, strict=True))


def regions(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Regions in batches: buffer, each one's place in it, its text's index, first window's offset, windows less one, and its minimiser's hash.

    The order of minimisers is that of the hashes' upper 44 bits, then the place: it depends on the window alone.
    """
    gram = min(gram, length)
    width = length - gram + 1
    for data, places, owner, offset in _packed(texts, length):
        h = hashes(data, gram)
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        at = (least & _LOW).astype(np.int64)
        ends = np.append(places[1:], len(data))
        change = np.ones(len(at), bool)
        change[1:] = at[1:] != at[:-1]
        change[places] = True
        lasts = ends[:-1] - length + 1  # the first window over a border, where the buffer has it
        change[lasts] = True
        first = np.flatnonzero(change)
        stop = np.append(first[1:], len(at))
        piece = np.searchsorted(places, first, "right") - 1
        ok = first + length <= ends[piece]
        first, stop, piece = first[ok], stop[ok], piece[ok]
        yield data, first, owner[piece], offset[piece] + first - places[piece], stop - first - 1, h[at[first]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _raw(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "replace") for x in column.to_pylist()]


def grams_of(rows: DataFrame, length: int) -> DataFrame:
    """key, n: the minimisers of each slice's regions, equal ones counted."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys = [r[5] for r in regions(_raw(batch.column(0).slice(at, 512)), length)]
                if keys:
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"key": _signed(key), "n": pa.array(n, pa.int64())})

    return rows.select("text").mapInArrow(run, "key long, n long")


def occurrences(rows: DataFrame, length: int) -> DataFrame:
    """key, same (hash of the region's bytes), id, tie, first (window's offset), more (windows after it)."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for at in range(0, batch.num_rows, 512):
                for data, place, owner, first, more, key in regions(_raw(batch.column(2).slice(at, 512)), length):
                    same = np.fromiter((digest(data[a:b]) for a, b in zip(place.tolist(), (place + more + length).tolist(), strict=True)), np.uint64, len(place))
                    yield pa.RecordBatch.from_pydict({"key": _signed(key), "same": _signed(same), "id": pa.array(ids[at + owner], pa.int64()), "tie": pa.array(ties[at + owner], pa.int32()), "first": pa.array(first, pa.int32()), "more": pa.array(more, pa.int32())})

    return rows.select("id", "tie", "text").mapInArrow(run, "key long, same long, id long, tie int, first int, more int")


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cyclic suffixes in the order of their first `depth` bytes at least; the boundaries at the first depth reached of 24 or more, and that depth."""
    n = len(data)
    ring = np.concatenate([data, np.resize(data, 8)])
    key = words_at(ring)
    order = np.argsort(key, kind="stable")
    done, part, early = 8, None, None
    cut = np.ones(n, bool)
    cut[1:] = key[order[1:]] != key[order[:-1]]
    while True:
        if early is None and (done >= 24 or done >= depth):
            early = (cut.copy(), done)
        if done >= depth:
            break
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(start, size)
        bits = max(1, int(n).bit_length())
        parts = min(3, 63 // bits)
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        p = order[open_]
        key = rank[p]
        for k in range(1, parts):
            key = key << bits | rank[(p + k * done) % n]
        by = np.argsort(key, kind="stable")
        order[open_] = p[by]
        key = key[by]
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        cut[open_[new]] = True
        done *= parts
    if early is None:
        early = (cut.copy(), done)
    return order, early[0], early[1]


def expand(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the boundaries between suffixes whose common prefix is under `length`.

    Boundaries below the first depth d come with the sort. The queue then starts with the intervals of strings of d bytes whose right
    boundary has common prefix d - 1, and each step extends them by the byte before: the intervals of one step are
    disjoint, so all are extended at once through the last-to-first map.
    """
    n = len(data)
    order, cut, level = suffix_array(data, length)
    if level >= length:
        cut = np.ones(n, bool)
        ring = np.concatenate([data, np.resize(data, length)])
        a, b = order[1:], order[:-1]
        same = np.ones(n - 1, bool)
        for k in range(length):
            same &= ring[a + k] == ring[b + k]
        cut[1:] = ~same
        return order, cut
    before = data[order - 1]
    to_first = np.empty(n, np.int64)
    to_first[np.argsort(before, kind="stable")] = np.arange(n)
    head = np.bincount(before, minlength=256)
    block = np.repeat(np.arange(256, dtype=np.uint8), head)
    ring = np.concatenate([data, np.resize(data, level)])
    start = np.flatnonzero(cut)
    right = np.append(start[1:], n)
    # right boundaries with common prefix level - 1: the last byte alone differs
    inner = np.flatnonzero(right < n)
    a, b = order[right[inner]], order[right[inner] - 1]
    same = np.ones(len(inner), bool)
    for k in range(level - 1):
        same &= ring[a + k] == ring[b + k]
    fresh = inner[same]
    # the last interval has no boundary after it; it is extended once
    lo, hi = np.append(start[fresh], start[-1]), np.append(right[fresh], n)
    owner = np.full(n, -1, np.int64)
    while level < length and len(lo):
        size = hi - lo
        total = int(size.sum())
        at = np.arange(total) - np.repeat(np.cumsum(size) - size - lo, size)
        went = to_first[at]
        owner[went] = np.repeat(np.arange(len(lo)), size)
        went.sort()
        mine, kind = owner[went], block[went]
        turn = np.flatnonzero((went[1:] != went[:-1] + 1) | (mine[1:] != mine[:-1]) | (kind[1:] != kind[:-1]))
        lo = went[np.append(0, turn + 1)]
        hi = went[np.append(turn, total - 1)] + 1
        level += 1
        new = np.ones(len(hi), bool)
        inside = hi < n
        new[inside] = ~cut[hi[inside]]
        new[~inside] = False
        lo, hi = lo[new], hi[new]
        if level <= length:
            cut[hi] = True
    return order, cut


def later_copies(ids: np.ndarray, ties: np.ndarray, firsts: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows within the texts, those that an earlier one equals: runs (text's index, first window's offset, windows)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    none = (np.zeros(0, np.int64),) * 3
    if not len(data) or len(data) < length:
        return none
    order, cut = expand(data, length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    valid = offset + length <= np.repeat(sizes, sizes)
    group = np.cumsum(cut) - 1
    keep = valid[order]
    p, group = order[keep], group[keep]
    many = np.bincount(group)[group] > 1
    p, group = p[many], group[many]
    if not len(p):
        return none
    own = owner[p]
    rank_of = np.empty(len(texts), np.int64)
    by = np.lexsort((firsts, ties, ids))
    rank_of[by] = np.arange(len(texts))
    # firsts grow with the rank within a document, and its windows don't overlap: (rank, offset) is the order of windows
    sort = np.lexsort((offset[p], rank_of[own], group))
    p, group = p[sort], group[sort]
    later = np.sort(p[1:][group[1:] == group[:-1]])
    if not len(later):
        return none
    own, off = owner[later], offset[later]
    turn = np.flatnonzero((own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)) + 1
    first = np.append(0, turn)
    return own[first], off[first], np.diff(np.append(first, len(later)))


def _in_bucket(length: int):
    def run(part: pa.Table) -> pa.Table:
        ids, ties, firsts = (part.column(c).to_numpy() for c in ("id", "tie", "first"))
        own, off, n = later_copies(ids, ties, firsts, part.column("region").to_pylist(), length)
        return pa.table({"id": pa.array(ids[own], pa.int64()), "tie": pa.array(ties[own], pa.int32()), "a": pa.array(firsts[own] + off, pa.int32()), "b": pa.array(firsts[own] + off + n - 1 + length, pa.int32())})

    return run


def _whole_windows(rows: DataFrame, length: int) -> DataFrame:
    """id, tie, first, region of keys with very many regions to id, tie, a, b."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                region, first = batch.column("region")[at].as_py(), batch.column("first")[at].as_py()
                n = len(region) - length + 1
                yield pa.RecordBatch.from_pydict({"id": pa.array([batch.column("id")[at].as_py()] * n, pa.int64()), "tie": pa.array([batch.column("tie")[at].as_py()] * n, pa.int32()), "a": pa.array(range(first, first + n), pa.int32()), "window": [xxhash.xxh3_128_digest(region[k : k + length]) for k in range(n)]})

    windows = rows.select("id", "tie", "first", "region").mapInArrow(run, "id long, tie int, a int, window binary")
    firsts = windows.groupBy("window").agg(F.min(F.struct("id", "tie", "a")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "least")
    return windows.join(firsts, "window").where(F.struct("id", "tie", "a") != F.col("least")).select("id", "tie", "a", (F.col("a") + length).alias("b"))


def removed(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows: id, tie, text (see common.keyed). Returns id, tie, spans: byte ranges [a, b) to remove, that may overlap."""
    spark = rows.sparkSession
    repeated = stored(grams_of(rows, length).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "keys")
    found = stored(occurrences(rows, length).join(repeated, "key"), "regions")
    firsts = stored(found.groupBy("key", "same").agg(F.min(F.struct("id", "tie", "first")).alias("least"), F.max("more").alias("more"), F.count(F.lit(1)).alias("n")), "firsts")
    several = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    wanted = stored(firsts.join(several, "key").select("key", "least.*", "more", "different"), "wanted")
    seen = wanted.agg(F.sum(F.col("more") + length), F.max("different")).first()
    # regions that very many texts hold are few: these meet their first where they are, the others by key
    often = small(stored(firsts.where(F.col("n") > HELD_OFTEN).select("key", "same", "least"), "often"))
    once = firsts.where((F.col("n") > 1) & (F.col("n") <= HELD_OFTEN)).select("key", "same", "least")
    met = found.join(often, ["key", "same"]).unionByName(found.join(often.select("key", "same"), ["key", "same"], "left_anti").join(once, ["key", "same"]))
    copies = met.where(F.struct("id", "tie", "first") != F.col("least")).select("id", "tie", F.col("first").alias("a"), (F.col("first") + F.col("more") + length).alias("b"))
    spans = [copies]
    if seen[0]:
        where = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("key", "first", "more", "different")).alias("wanted"))
        at = rows.select("id", "tie", "text").dropDuplicates(["id", "tie"]) if rows.where("tie > 0").limit(1).count() else rows.select("id", "tie", "text")
        cut = stored(at.join(where, ["id", "tie"]).mapInArrow(_cut_out(length), "key long, id long, tie int, first int, region binary, many boolean").dropDuplicates(["key", "id", "tie", "first"]), "cut")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen[0] // BUCKET_BYTES))
        few = cut.where("not many").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        spans.append(few.groupBy("bucket").applyInArrow(_in_bucket(length), "id long, tie int, a int, b int"))
        if seen[1] > REGIONS_MOST:
            spans.append(_whole_windows(cut.where("many"), length))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return stored(every, "spans").groupBy("id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _cut_out(length: int):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("tie", pa.int32()), ("first", pa.int32()), ("region", pa.binary()), ("many", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                raw = (batch.column("text")[at].as_py() or "").encode("utf-8", "replace")
                some = batch.column("wanted")[at].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": [x["key"] for x in some],
                        "id": [batch.column("id")[at].as_py()] * len(some),
                        "tie": [batch.column("tie")[at].as_py()] * len(some),
                        "first": [x["first"] for x in some],
                        "region": [raw[x["first"] : x["first"] + x["more"] + length] for x in some],
                        "many": [x["different"] > REGIONS_MOST for x in some],
                    },
                    schema=schema,
                )

    return run


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that they hold in part only."""
    out = []
    for a, b in runs:
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, length: int, *more: str) -> DataFrame:
    rows = keyed(docs, *more)
    return rows.join(removed(rows, length), ["id", "tie"], "left").select("doc_id", "text", "spans", *more)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw, runs = (text.as_py() or "").encode("utf-8", "replace"), merged(spans.as_py())
                rest = kept(raw, runs)
                for k, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(rest)), ("n_spans", len(runs)), ("kept_sha256", hashlib.sha256(rest).hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return _with_spans(docs, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (without the repeats; characters that a repeat holds in part stay), n_removed, and columns to keep. One row for each row."""
    rows = _with_spans(docs, length, *keep)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            texts, n = [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                rest = kept(raw, whole_characters(raw, merged(spans.as_py())))
                texts.append(None if text.as_py() is None else rest.decode())
                n.append(len(raw) - len(rest))
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_removed", *keep])

    return rows.mapInArrow(run, "doc_id long, text string, n_removed long" + (f", {kinds}" if kinds else ""))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
