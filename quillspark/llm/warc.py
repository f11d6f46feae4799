"""WARC records and their Merkle fixity audit.

A catalog lists the records of a page table: file, seq, offset, length and SHA-256 digest. A file holds the records of
`FILE_RECORDS` neighbouring page ids; ids that hold more than that between them are dealt out over several files by
digest, so no file, and no window over one, grows with a key. Equal rows are one record, stored `copies` times side by side.

Trees: a leaf hashes a record's digest and offset range; a node hashes its up to 16 children in order with the range that
they span. Two replicas compare roots; only children of nodes that differ are compared next, down to the records.

Null url and html count as empty. A null page_id is file -1's. Ties have the order of their digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import stored, table

FILE_RECORDS = 4096
FAN = 16
#: Pages have no date of their own; the format asks for one.
DATE = "1970-01-01T00:00:00Z"


def record_of(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as a string."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.translate(F.coalesce(url.cast("string"), F.lit("")), "\r\n", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, length, digest, record."""
    record = record_of(pages[page_id], pages[url], pages[html])
    return pages.select(pages[page_id].cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"), record.alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """One WARC file for each partition. A record ends with two line ends, which the text writer puts after each row."""
    records(pages).select(F.expr("substring(record, 1, length(record) - 4)").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and body of each record; raises ValueError where the bytes are no record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not _HEAD.match(data, at) or end < 0:
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        yield at, stop + 4 - at, head, data[end + 4 : stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, record_id, url, body of the WARC files in a folder."""
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, n, head, body in parse_warc(data.as_py()):
                    yield pa.RecordBatch.from_pylist([{"file": name, "offset": at, "length": n, "record_id": head.get("WARC-Record-ID"), "url": head.get("WARC-Target-URI"), "body": body}], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, offset long, length long, record_id string, url string, body binary")


def catalog(rows: DataFrame) -> DataFrame:
    """rows: page_id, length, digest and more columns (their greatest value is kept) to block, part, seq, offset too, and copies."""
    more = [c for c in rows.columns if c not in ("page_id", "length", "digest")]
    one = rows.groupBy("page_id", "length", "digest").agg(F.count(F.lit(1)).alias("copies"), *(F.max(c).alias(c) for c in more))
    one = one.withColumn("block", F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), F.lit(-1)))
    parts = one.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / FILE_RECORDS).alias("parts"))
    split = parts.where("parts > 1")
    one = one.join(split, "block", "left").withColumn("part", F.coalesce(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.col("parts"), F.lit(0)))
    order = Window.partitionBy("block", "part").orderBy("page_id", "digest", "length")
    size = F.col("length") * F.col("copies")
    return one.select("block", "part", "page_id", (F.row_number().over(order) - 1).alias("seq"), (F.sum(size).over(order) - size).alias("offset"), "length", "copies", "digest", *more)


def _node(children: Column) -> Column:
    """children: array of (at, hash, first, last) in order."""
    return F.sha2(F.concat_ws("|", F.transform(children, lambda c: F.concat_ws(",", c["hash"], c["first"].cast("string"), c["last"].cast("string")))), 256)


def leaves(records: DataFrame) -> DataFrame:
    """block, part, at, hash, first, last from block, part, seq, offset, length, copies, digest."""
    last = F.col("offset") + F.col("length") * F.col("copies")
    return records.select("block", "part", F.col("seq").cast("long").alias("at"), F.sha2(F.concat_ws(",", "digest", F.col("offset").cast("string"), last.cast("string")), 256).alias("hash"), F.col("offset").alias("first"), last.alias("last"))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves to the roots. Each is written once: the level above and the comparison read it."""
    out = [stored(leaves(records), "level")]
    for _ in range(height):
        kids = out[-1].groupBy("block", "part", F.expr(f"at div {FAN}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "hash", "first", "last"))).alias("kids"))
        level = kids.select("block", "part", "at", _node(F.col("kids")).alias("hash"), F.array_min(F.transform("kids", lambda c: c["first"])).alias("first"), F.array_max(F.transform("kids", lambda c: c["last"])).alias("last"))
        out.append(stored(level, "level"))
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """block, part, seq, status (differs, missing, extra: in the right replica) of the records that the two don't share."""
    top = left.agg(F.max("seq")).first()[0], right.agg(F.max("seq")).first()[0]
    height, most = 0, max(x if x is not None else 0 for x in top)
    while FAN**height <= most:
        height += 1
    a, b = (tree(x, height) for x in (left, right))
    where = ["block", "part", "at"]
    bad = None
    for level in range(height, -1, -1):
        x, y = (t[level].select(*where, F.col("hash").alias(name)) for t, name in ((a, "left"), (b, "right")))
        if bad is not None:
            parents = bad.select("block", "part", F.col("at").alias("parent"))
            x, y = (z.withColumn("parent", F.expr(f"at div {FAN}")).join(parents, ["block", "part", "parent"], "left_semi").drop("parent") for z in (x, y))
        bad = x.join(y, where, "full").where(~F.col("left").eqNullSafe(F.col("right")))
        if level:
            bad = stored(bad, "nodes")
    return bad.select("block", "part", F.col("at").alias("seq"), F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "extra").otherwise("differs").alias("status"))


def damaged(html: Column, page_id: Column) -> Column:
    """A replica's text with faults put in: for a remainder of 7 by 101 the first character changes, for 8 the second half is lost."""
    kind, text = F.pmod(page_id, F.lit(101)), F.coalesce(html, F.lit(""))
    return F.when(kind == 7, F.concat(F.lit("~"), F.substring(text, 2, 1 << 30))).when(kind == 8, F.left(text, F.floor(F.length(text) / 2).cast("int"))).otherwise(text)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of all pages as one WARC collection, audited against a replica with faults: page_id, block, seq, offset, length, copies, digest, status.

    The replica's faults are put in by a rule (see `damaged`; ids with remainder 9 are missing). Records
    come from the pages, and their place from the catalog; the replica's digests are of its own bytes at that place.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    whole = record_of(pages["page_id"], pages["url"], pages["html"])
    there = record_of(pages["page_id"], pages["url"], damaged(pages["html"], pages["page_id"]))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole.cast("binary"), 256).alias("digest"), F.when(F.pmod("page_id", F.lit(101)) == 9, None).otherwise(F.sha2(there.cast("binary"), 256)).alias("found")
    )
    left = stored(catalog(rows), "catalog")
    right = left.where("found is not null").withColumn("digest", F.col("found"))
    return left.join(audit(left, right), ["block", "part", "seq"], "left").select("page_id", "block", "part", "seq", "offset", "length", "copies", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages),
r AS (SELECT page_id, 'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || replace(replace(url, chr(13), ''), chr(10), '') || nl
  || 'Content-Type: text/html' || nl || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || nl || nl || html || nl || nl AS rec, html FROM p),
g AS (SELECT page_id, sha256(rec) AS digest, CAST(strlen(rec) AS BIGINT) AS length, count(*) AS copies, any_value(html) AS html FROM r GROUP BY page_id, sha256(rec), strlen(rec)),
b AS (SELECT *, CAST(coalesce(floor(page_id / 4096.0), -1) AS BIGINT) AS block FROM g),
q AS (SELECT b.*, CASE WHEN k > 4096 THEN CAST('0x' || digest[1:8] AS BIGINT) % CAST(ceil(k / 4096.0) AS BIGINT) ELSE 0 END AS part FROM b JOIN (SELECT block, count(*) AS k FROM b GROUP BY block) USING (block))
SELECT page_id, block, CAST(part AS BIGINT) AS part, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, CAST(sum(length * copies) OVER w - length * copies AS BIGINT) AS "offset", length, copies, digest,
  CASE WHEN page_id % 101 = 9 THEN 'missing' WHEN page_id % 101 = 7 AND '~' || html[2:] <> html THEN 'differs' WHEN page_id % 101 = 8 AND html <> '' THEN 'differs' ELSE 'ok' END AS status
FROM q WINDOW w AS (PARTITION BY block, part ORDER BY page_id NULLS FIRST, digest, length ROWS UNBOUNDED PRECEDING)
"""
