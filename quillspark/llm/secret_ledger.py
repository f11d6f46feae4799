"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by its content: a blob is the SHA-256 of a text's UTF-8 bytes. The ledger, two
tables in a folder, holds which rule versions have seen which blobs and what they found there. A scan looks up the blobs of
the versions given, takes the text of each blob once, and only for the rules (name and version) that have not seen it; new
rules are scanned for over old blobs without the old rules running again. Findings are joined back to every path and
version that holds their blob.

A finding is a span of code points, end exclusive. All matches of a rule are taken from the left without overlap; those whose
tested group is too short are dropped afterwards, so they still use up their text. Places come from what stands between
the matches: lengths summed up by a window over the matches of one blob and rule.

A null text counts as empty. Null ids, repeated rows and rows of one id with different texts each keep their own result: they
are versions that may share a blob. Tables may be empty, and further columns are not looked at. Writing is append-only and
what is found in a blob is always the same, so a scan that was broken off can be run again: findings are read without
repeats, and a blob counts as seen only once its findings are written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import shared_dir, small, stored, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group whose length must be at least `least`."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which ties of start are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Public formats of further credentials.
FURTHER = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
)
RULES = BASE + FURTHER
SCANNED, FINDINGS = "blob string, rules array<string>", "blob string, rule string, start int, end int"


def _text(rows: DataFrame) -> Column:
    return F.coalesce(rows["text"].cast("string"), F.lit(""))


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Ledger:
    """The tables of what was scanned and found, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")

    def scanned(self) -> DataFrame:
        """blob, rules: every rule version that has seen it."""
        rows = self.spark.read.schema(SCANNED).parquet(f"{self.folder}/scanned").select("blob", F.explode("rules").alias("rule"))
        return rows.groupBy("blob").agg(F.collect_set("rule").alias("rules"))

    def findings(self) -> DataFrame:
        return self.spark.read.schema(FINDINGS).parquet(f"{self.folder}/findings").distinct()

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, todo: the rule versions that have not seen it; only hashes move."""
        blobs = versions.select(blob_of(_text(versions)).alias("blob")).distinct()
        todo = F.array_except(F.array(*(F.lit(r.key) for r in rules)), F.coalesce("rules", F.array().cast("array<string>")))
        return blobs.join(self.scanned(), "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen and write it down; returns blob, todo as they were scanned."""
        todo = stored(self.unseen(versions, rules), "unseen")
        texts = versions.select(blob_of(_text(versions)).alias("blob"), _text(versions).alias("text"))
        texts = texts.join(small(todo.select("blob")), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        spans(texts.join(todo, "blob"), rules).write.mode("append").parquet(f"{self.folder}/findings")
        todo.withColumnRenamed("todo", "rules").write.mode("append").parquet(f"{self.folder}/scanned")
        return todo

    def by_path(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """doc_id, blob, found: for each version of each path the findings of these rules, by start and then by the rules' order."""
        order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind")))))
        known = self.findings().where(F.col("rule").isin([r.key for r in rules])).withColumn("of", order[F.col("rule")])
        found = known.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "of.rank", "of.kind", "end"))).alias("found"))
        paths = versions.select(versions["doc_id"].cast("long").alias("doc_id"), blob_of(_text(versions)).alias("blob"))
        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
        return paths.join(small(stored(found, "found")), "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rule, start, end of the texts (blob, text, todo): only rules listed in todo run."""
    looked = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(r.key).alias("rule"),
                    F.lit(r.pattern).alias("pattern"),
                    F.when(F.array_contains("todo", r.key), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("hits"),
                    F.lit(r.group).alias("group"),
                    F.lit(r.least).alias("least"),
                )
                for r in (_quick(r) for r in rules)
            )
        )
    )
    hits = texts.select("blob", "text", looked.alias("at")).where(F.size("at.hits") > 0).select("blob", "text", "at.*")
    # a match is as long as its tested group where that is the whole of it; otherwise the pattern is asked again, of hits alone
    tested = F.when(F.col("group") == 0, F.col("hits")).otherwise(F.regexp_extract_all("text", F.col("pattern"), F.col("group")))
    parts = F.arrays_zip(F.transform(F.split("text", F.col("pattern"), -1), F.length).alias("gap"), F.transform("hits", F.length).alias("size"), F.transform(tested, F.length).alias("tested"))
    each = hits.select("blob", "rule", "least", F.posexplode(parts).alias("at", "part")).where("part.size is not null")
    until = F.sum(F.col("part.gap") + F.col("part.size")).over(Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ends = each.select("blob", "rule", "least", "part", until.cast("int").alias("end"))
    return ends.where("part.tested >= least").select("blob", "rule", (F.col("end") - F.col("part.size")).alias("start"), "end")


def _quick(rule: Rule) -> Rule:
    """A pattern that ends in one class, repeated and as long as can be, may ask for the length itself.

    What is left out could not have held a long enough match: its run of the class is used up to its end. This spares lists
    of every short run of hex digits in a text. Patterns with a tested group keep their own way.
    """
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        head = rule.pattern.rpartition("[")[0]
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}", 0, rule.least, rule.version)
    return rule


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(by_path: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, blob."""
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return by_path.select("doc_id", *(n(r.kind) for r in BASE), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "blob")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of all documents with a ledger that starts empty, joined back to every document."""
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.scan(docs)
    return report(ledger.by_path(docs))


def _sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    each = " UNION ALL ".join(
        f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_split_to_array(t, '{quoted(r.pattern)}') AS p, regexp_extract_all(t, '{quoted(r.pattern)}', 0) AS m, regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS g FROM d"
        for i, r in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({each}),
x AS (SELECT rid, rank, kind, least, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM h WHERE len(m) > 0),
s AS (SELECT rid, rank, kind, list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS s, length(m[i]) AS n FROM x WHERE length(g[i]) >= least),
l AS (SELECT rid, rank, kind, s, concat_ws(':', kind, CAST(s AS BIGINT), CAST(s + n AS BIGINT)) AS v FROM s),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(v, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(v, ',' ORDER BY s, rank) AS spans FROM l GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN a USING (rid)"""


SQL = _sql()
