"""Queries over a log of chained hashes: its MACs, and what was done to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import audit, nested, requests, upkeep
from quillspark.operators.records import numbered, shared
from quillspark.plans.registry import query
from quillspark.sources.records import table
from quillspark.streaming import blocks, finals

#: A key for these queries alone.
KEY, SIZE = b"a key that only these queries use", 100
_IN, _OUT = (bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


def _mac(text: str) -> str:
    return f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({text}))))"


LOGGED = "l AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, epoch_us(ts) AS ts, event_type AS event, CAST(user_id AS VARCHAR) AS case_ref, '{' || event_id || '}' AS meta FROM events)"
ENTRY = "{a}.seq || '|' || {a}.ts || '|' || {a}.event || '|' || {a}.case_ref || '|' || {a}.meta || '|' || "


def _sealed(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("case_ref"), F.concat(F.lit("{"), F.col("event_id").cast("string"), F.lit("}")).alias("meta"))
    return audit.sealed(numbered(rows, ["ts", "event_id"]).withColumnRenamed("nth", "seq"), KEY, size=SIZE)


CHAIN = f"""WITH RECURSIVE {LOGGED}, g AS (SELECT *, (seq - 1) // {SIZE} AS segment FROM l), c AS (SELECT g.*, {_mac("'segment|' || segment")} AS prev_mac, {_mac(ENTRY.format(a="g") + _mac("'segment|' || segment"))} AS mac FROM g WHERE (seq - 1) % {SIZE} = 0
UNION ALL SELECT g.*, c.mac, {_mac(ENTRY.format(a="g") + "c.mac")} FROM c JOIN g ON g.seq = c.seq + 1 AND g.segment = c.segment)"""


@query(f"{CHAIN} SELECT segment, seq, ts, event, case_ref, meta, prev_mac, mac FROM c")
def audit_macs(spark, d):
    """The events as a sealed log."""
    return _sealed(spark, d)[0]


@query(f"""{CHAIN}, h AS (SELECT segment, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(mac, seq) AS head FROM c GROUP BY segment),
k AS (SELECT *, '{audit.GENESIS}' AS prev_anchor, {_mac(f"'anchor|' || segment || '|' || first_seq || '|' || last_seq || '|' || head || '|{audit.GENESIS}'")} AS anchor FROM h WHERE segment = 0
UNION ALL SELECT h.*, k.anchor, {_mac("'anchor|' || h.segment || '|' || h.first_seq || '|' || h.last_seq || '|' || h.head || '|' || k.anchor")} FROM k JOIN h ON h.segment = k.segment + 1) SELECT segment, first_seq, last_seq, head, prev_anchor, anchor FROM k""")
def audit_anchors(spark, d):
    return _sealed(spark, d)[1]


@query(f"""WITH {LOGGED}, x AS (SELECT seq, (seq - 1) // {SIZE} AS segment, seq > (SELECT max(seq) FROM l) - 3 AS cut, seq % 307 = 7 AS gone FROM l)
SELECT segment, seq, 'truncated' AS fault FROM x WHERE cut UNION ALL SELECT segment, seq, 'gap' FROM x WHERE gone AND NOT cut UNION ALL SELECT segment, seq, 'altered' FROM x WHERE seq % 211 = 5 AND NOT gone AND NOT cut
UNION ALL SELECT segment, seq, 'double' FROM x WHERE seq % 401 = 9 AND NOT gone AND NOT cut""")
def audit_faults(spark, d):
    """The sealed events, of which some are altered, left out, there twice or cut off at the end: each is found."""
    rows, anchors = _sealed(spark, d)
    seq = F.col("seq")
    last = anchors.agg(F.max("last_seq").alias("most"))
    bad = rows.crossJoin(F.broadcast(last)).where((seq <= F.col("most") - 3) & (seq % 307 != 7)).drop("most")
    bad = bad.withColumn("meta", F.when(seq % 211 == 5, F.concat("meta", F.lit(" "))).otherwise(F.col("meta")))
    return audit.faults(bad.unionByName(bad.where(seq % 401 == 9)), anchors, KEY)


FLOOR, MARGIN, MOST, REST = 120, 70, 900, 50
_NOTE = len(requests.NOTE.encode())


def _cut(text: str, keep: str) -> str:
    """The part that is kept, as an expression: whole characters, then the last line end or blank in the second half, then no open bracket."""
    head = f"left({text}, list_max(list_filter(range(0, length({text}) + 1), lambda n: strlen(left({text}, n)) <= {keep})))"
    line, blank = f"regexp_extract({head}, '^((?s:.*))\\n', 1)", f"regexp_extract({head}, '^((?s:.*)) ', 1)"
    part = f"CASE WHEN contains({head}, chr(10)) AND strlen({line}) >= strlen({head}) // 2 THEN {line} WHEN contains({head}, ' ') AND strlen({blank}) >= strlen({head}) // 2 THEN {blank} ELSE {head} END"
    return f"regexp_replace({part}, '\\[[^\\[\\]]*$', '')"


@query(f"""WITH b AS (SELECT conv_id AS request, turn AS block, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS total, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id) + {REST} AS size FROM conversations),
l AS (SELECT *, CASE WHEN size > {MOST} AND total > {FLOOR} THEN {_cut("text", str(FLOOR))} END AS least FROM b), s AS (SELECT *, CASE WHEN least IS NULL THEN 0 ELSE total - strlen(least) - {_NOTE} END AS saving FROM l),
w AS (SELECT *, size - coalesce(sum(saving) OVER (PARTITION BY request ORDER BY total DESC, block DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
k AS (SELECT *, CASE WHEN least IS NOT NULL AND before > {MOST} THEN greatest(total - (before - {MOST} + {MARGIN}), {FLOOR}) END AS keep FROM w),
c AS (SELECT *, CASE WHEN keep = {FLOOR} THEN least WHEN keep > {FLOOR} THEN {_cut("text", "keep")} END AS part FROM k),
o AS (SELECT *, sum(CASE WHEN part IS NULL THEN total ELSE strlen(part) + {_NOTE} END) OVER (PARTITION BY request) + {REST} AS after FROM c),
r AS (SELECT *, CASE WHEN size <= {MOST} THEN 'fits' WHEN after <= {MOST} THEN 'shrunk' ELSE 'refused' END AS outcome FROM o)
SELECT request, block, CAST(total AS INTEGER) AS total, CAST(CASE WHEN outcome = 'shrunk' AND part IS NOT NULL THEN strlen(part) ELSE total END AS INTEGER) AS kept, outcome FROM r""")
def requests_shrunk(spark, d):
    """Conversations as requests of at most 900 bytes, a block for each turn."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("block"), "text")
    return requests.shrunk(rows, MOST, REST, FLOOR, MARGIN).drop("text")


@query(f"""WITH a AS (SELECT o_custkey % 25 AS author, o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS "case", CASE o_orderstatus WHEN 'P' THEN 'forget' ELSE 'final' END AS action, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS n, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders),
r AS (SELECT *, sum(CASE WHEN action = 'final' AND n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY author ORDER BY seq ROWS UNBOUNDED PRECEDING) AS at_ FROM a), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY author, "case" ORDER BY seq DESC) = 1),
m AS (SELECT author, max(at_) AS most FROM r GROUP BY 1), w AS (SELECT l.*, CASE WHEN action = 'final' AND n > 0 THEN pow({finals.FADE}, most - at_) ELSE 0 END AS w FROM l JOIN m USING (author)),
s AS (SELECT author, CAST(sum(CASE WHEN action = 'final' AND n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS finished, sum(w) AS n, sum(w * x) AS t, sum(w * x * x) AS q FROM w GROUP BY 1)
SELECT author, finished, round(n, 4) AS n, round(t / n, 2) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(q - t * t / n, 0) / (n - 1)) ELSE 0 END, 1) AS sd FROM s""")
def finals_learned(spark, d):
    """Orders as finished reports of 25 authors, a case for each customer; pending ones take back what the case taught."""
    o, x = table(spark, d, "orders"), F.floor("o_totalprice").cast("long")
    n = F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(1)
    rows = o.select((F.col("o_custkey") % 25).alias("author"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("case"), F.when(F.col("o_orderstatus") == "P", "forget").otherwise("final").alias("action"), n.alias("n"), x.alias("total"), (x * x).alias("squares"))
    return finals.moments(rows).select("author", "finished", F.round("n", 4).alias("n"), F.round("mean", 2).alias("mean"), F.round("sd", 1).alias("sd"))


@query(r"""WITH c AS (SELECT conv_id || '/' || turn AS stream_id, (conv_id + turn) % 6 AS k, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations), t AS (SELECT *, CASE WHEN k = 0 THEN text ELSE left(text, 2 * (n // 3)) END AS said FROM c)
SELECT stream_id, CASE k WHEN 0 THEN 'done' WHEN 1 THEN 'bad event' WHEN 2 THEN 'block started twice' WHEN 3 THEN 'cut' WHEN 4 THEN 'error: overloaded' ELSE 'delta before its block' END AS state, said AS text, '' AS thinking, '[]' AS inputs, CASE WHEN k = 0 THEN 'end_turn' END AS stop_reason, CASE WHEN k = 0 THEN n END AS output_tokens,
CAST(len(list_filter(regexp_split_to_array(said, '\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM t""")
def assembled_blocks(spark, d):
    """Each turn of a conversation as a message in events, five of six with something wrong in the middle."""
    c = table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("stream_id"), ((F.col("conv_id") + F.col("turn")) % 6).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    event = lambda kind, *more: F.to_json(F.struct(F.lit(kind).alias("type"), *more))
    index = lambda i: F.lit(i).alias("index")
    text = lambda piece, i=0: event("content_block_delta", index(i), F.struct(F.lit("text_delta").alias("type"), piece.alias("text")).alias("delta"))
    begin = event("content_block_start", index(0), F.struct(F.lit("text").alias("type")).alias("content_block"))
    wrong = F.when(F.col("k") == 1, F.lit("{bad")).when(F.col("k") == 2, begin).when(F.col("k") == 4, event("error", F.struct(F.lit("overloaded").alias("type")).alias("error"))).when(F.col("k") == 5, text(F.lit("x"), 7)).otherwise(event("ping"))
    end = event("message_delta", F.struct(F.lit("end_turn").alias("stop_reason")).alias("delta"), F.struct(F.length("text").alias("output_tokens")).alias("usage"))
    parts = F.array(event("message_start"), begin, text(F.substring("text", F.lit(1), third)), text(F.substring("text", third + 1, third)), wrong, text(F.substring("text", 2 * third + 1, F.length("text"))), event("content_block_stop", index(0)), end, event("message_stop"))
    rows = c.select("stream_id", "k", F.posexplode(parts).alias("seq", "data")).where("not (k = 3 and seq = 4)")
    return blocks.assembled(rows.select("stream_id", F.col("seq").cast("long").alias("seq"), "data"))


@query("""WITH b AS (SELECT conv_id AS id, CASE WHEN conv_id % 7 = 0 THEN '{' ELSE CAST(to_json({'conv': conv_id, 'turns': list({'role': role, 'parts': [[{'text': coalesce(text, ''), 'n': turn}]]} ORDER BY turn, role, text)}) AS VARCHAR) END AS body FROM conversations GROUP BY conv_id)
SELECT t.id, j.fullkey AS path, j.value ->> '$' AS value FROM (SELECT * FROM b WHERE body <> '{') t, json_tree(t.body) j WHERE j.type = 'VARCHAR' UNION ALL SELECT id, 'bad', NULL FROM b WHERE body = '{'""")
def nested_strings(spark, d):
    """All strings of conversations as nested JSON, and the bodies that are no JSON."""
    turn = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), F.array(F.array(F.struct(t["text"].alias("text"), t["turn"].alias("n")))).alias("parts")))
    per = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("turns"))
    bodies = per.select("id", F.when(F.col("id") % 7 == 0, "{").otherwise(F.to_json(F.struct(F.col("id").alias("conv"), "turns"))).alias("body"))
    return nested.strings(bodies).unionByName(nested.bad(bodies).select("id", F.lit("bad").alias("path"), F.lit(None).cast("string").alias("value")))


@query("""WITH o AS (SELECT o_custkey AS person, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS value, o_orderdate >= TIMESTAMP '1998-01-01' AS late FROM orders), l AS (SELECT DISTINCT person FROM o WHERE late)
SELECT person, count(*) AS sheets, max(value) AS most, min(id) AS first, CASE WHEN person IN (SELECT person FROM l) THEN 2 ELSE 1 END AS version FROM o GROUP BY person""")
def comparisons_refreshed(spark, d):
    """A figure of each customer's orders, made from those before 1998 and then kept up with the later ones: only customers with later orders are written again."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("value"), (F.to_date("o_orderdate") >= F.lit("1998-01-01")).alias("late"))
    kept = upkeep.Derived(spark, f"{shared(spark)}/derived-{uuid.uuid4().hex}", "person", lambda rows: rows.groupBy("person").agg(F.count(F.lit(1)).alias("sheets"), F.max("value").alias("most"), F.min("id").alias("first")), "person long, sheets long, most long, first long")
    early = o.where("not late")
    kept.refresh(early, early.select("person"), 1)
    kept.refresh(o, o.where("late").select("person"), 2)
    return kept.current()
