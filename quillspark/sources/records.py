"""Practice records as views over the test tables. Money is in whole minor units, made once with integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an order's priority and status stand for.
KINDS = {"1-URGENT": "intake", "2-HIGH": "assessment", "3-MEDIUM": "therapy", "4-NOT SPECIFIED": "feedback", "5-LOW": "meeting"}
STATUSES = {"F": "held", "O": "planned", "P": "cancelled"}
TASKS = {"view": "questionnaire", "signup": "document", "click": "call", "error": "report"}
METHODS = ("cash", "transfer", "check", "card", "other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minor(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def choose(column: str, values: dict[str, str], other: str) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out.otherwise(other)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), choose("o_orderpriority", KINDS, "unknown").alias("kind"), F.to_date("o_orderdate").alias("date"),
        F.pmod(F.col("o_orderkey") * 37, F.lit(1380)).cast("int").alias("start"), F.lit(60).alias("minutes"), choose("o_orderstatus", STATUSES, "unknown").alias("status"), minor("o_totalprice").alias("fee"), (F.col("o_orderkey") % 2 == 0).alias("charge_missed"),
    )


#: Lines of orders that one task joins and sorts at most, unless one order has more.
LINES_A_TASK = 1_000_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's patient. Where there are many, the tasks that join them grow in number, not in memory."""
    line, own = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient_id"))
    tasks = -(-line.count() // LINES_A_TASK)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        line, own = line.repartition(tasks, "l_orderkey"), own.repartition(tasks, "l_orderkey")
    return line.join(own, "l_orderkey")


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.expr("cast(round(l_extendedprice * 100) as long) * (100 - cast(round(l_discount * 100) as long)) div 100")
    return _lines(spark, sf_dir).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "patient_id", F.to_date("l_shipdate").alias("date"), amount.alias("amount"), (F.col("l_returnflag") == "R").alias("voided"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, METHODS)), (F.pmod("l_linenumber", F.lit(5)) + 1).cast("int"))
    return _lines(spark, sf_dir).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "patient_id", F.date_add(F.to_date("l_shipdate"), 30).alias("date"), F.expr("cast(round(l_extendedprice * 100) as long) * (60 + pmod(l_orderkey * 7 + l_linenumber, 60)) div 100").alias("amount"), method.alias("method"), (F.col("l_returnflag") == "A").alias("voided"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    day = lambda first, step, span: F.date_add(F.lit(first).cast("date"), F.pmod(key * step, F.lit(span)).cast("int"))
    status = F.when(F.col("c_nationkey") % 5 == 0, "waiting").when(F.col("c_nationkey") % 5 == 1, "finished").otherwise("active")
    return c.select(
        key.alias("id"), F.col("c_name").alias("name"), status.alias("status"), F.when(key % 11 != 0, day("1985-01-01", 13, 5000)).alias("birth_date"), F.when(key % 3 != 0, day("2000-01-01", 29, 500)).alias("waiting_since"),
        day("1996-06-01", 7, 1800).alias("created_on"), F.col("c_mktsegment").alias("referred_by"), (F.col("c_nationkey") % 7 == 0).alias("urgent"), F.when(key % 4 != 0, key).alias("case_id"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    due = F.date_sub(F.to_date("ts"), 8240)
    return e.select(
        key.alias("id"), F.when(key % 10 != 0, F.col("user_id")).alias("patient_id"), choose("event_type", TASKS, "other").alias("kind"), F.concat_ws(" ", "event_type", key.cast("string")).alias("title"),
        F.when(key % 7 != 0, due).alias("due"), F.when(key % 3 == 0, F.date_add(due, 2)).alias("done_on"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("date"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, approved and total sections."""
    return table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 6).cast("int").alias("approved"), F.lit(5).alias("total"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, saved_at, status: saved versions of visits."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("saved_at"), F.when(F.col("l_linestatus") == "F", "held").otherwise("planned").alias("status"))


#: The same views for the oracle.
SQL = """visits AS (SELECT o_orderkey AS id, o_custkey AS patient_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'intake' WHEN '2-HIGH' THEN 'assessment' WHEN '3-MEDIUM' THEN 'therapy' WHEN '4-NOT SPECIFIED' THEN 'feedback' WHEN '5-LOW' THEN 'meeting' ELSE 'unknown' END AS kind,
  CAST(o_orderdate AS DATE) AS date, CAST((o_orderkey * 37) % 1380 AS INTEGER) AS start, 60 AS minutes, CASE o_orderstatus WHEN 'F' THEN 'held' WHEN 'O' THEN 'planned' WHEN 'P' THEN 'cancelled' ELSE 'unknown' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS fee, o_orderkey % 2 = 0 AS charge_missed FROM orders),
lines AS (SELECT l.*, o_custkey AS patient_id FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
charges AS (SELECT l_orderkey * 10 + l_linenumber AS id, patient_id, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) // 100 AS amount, l_returnflag = 'R' AS voided FROM lines),
payments AS (SELECT l_orderkey * 10 + l_linenumber AS id, patient_id, CAST(l_shipdate AS DATE) + 30 AS date, CAST(round(l_extendedprice * 100) AS BIGINT) * (60 + (l_orderkey * 7 + l_linenumber) % 60) // 100 AS amount, ['cash', 'transfer', 'check', 'card', 'other'][l_linenumber % 5 + 1] AS method, l_returnflag = 'A' AS voided FROM lines),
patients AS (SELECT c_custkey AS id, c_name AS name, CASE c_nationkey % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'finished' ELSE 'active' END AS status, CASE WHEN c_custkey % 11 <> 0 THEN DATE '1985-01-01' + CAST(c_custkey * 13 % 5000 AS INTEGER) END AS birth_date,
  CASE WHEN c_custkey % 3 <> 0 THEN DATE '2000-01-01' + CAST(c_custkey * 29 % 500 AS INTEGER) END AS waiting_since, DATE '1996-06-01' + CAST(c_custkey * 7 % 1800 AS INTEGER) AS created_on, c_mktsegment AS referred_by, c_nationkey % 7 = 0 AS urgent, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS case_id FROM customer),
tasks AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS patient_id, CASE event_type WHEN 'view' THEN 'questionnaire' WHEN 'signup' THEN 'document' WHEN 'click' THEN 'call' WHEN 'error' THEN 'report' ELSE 'other' END AS kind, event_type || ' ' || event_id AS title,
  CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) - 8240 END AS due, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) - 8238 END AS done_on FROM events),
notes AS (SELECT o_orderkey AS visit_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 3 = 0),
reports AS (SELECT c_custkey AS patient_id, CAST(c_custkey % 6 AS INTEGER) AS approved, 5 AS total FROM customer WHERE c_custkey % 4 <> 0),
history AS (SELECT l_orderkey AS record_id, l_linenumber AS saved_at, CASE WHEN l_linestatus = 'F' THEN 'held' ELSE 'planned' END AS status FROM lineitem)"""
