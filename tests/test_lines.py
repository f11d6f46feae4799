"""Lines of orders are joined by as many tasks as they need."""

from quillspark.plans import catalog
from quillspark.sources import records


def test_tasks_of_the_join_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "LINES_A_TASK", 50, raising=False)
    # an order twice, of two patients; a line without an order; orders without lines
    orders = [(k, k % 7, "1996-01-02", "5-LOW", "F", 10.0) for k in range(60)] + [(3, 90, "1996-01-02", "5-LOW", "F", 10.0)]
    lines = [(k % 50, k // 50, "1996-03-13", 20.0, 0.1, "N", "O") for k in range(400)] + [(900, 1, "1996-03-13", 20.0, 0.1, "N", "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate string, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "n", 1, "s") for k in range(8)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, "view", "1996-03-13")], "event_id long, user_id long, event_type string, ts string").write.parquet(f"{tmp_path}/events.parquet")
    assert records.charges(spark, str(tmp_path)).rdd.getNumPartitions() >= 1
    assert "REPARTITION_BY_NUM" in records.charges(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    patients = {}
    for k, patient, *_ in orders:
        patients.setdefault(k, []).append(patient)
    want = {}
    for k, *_ in lines:
        for p in patients.get(k, []):
            want[p] = want.get(p, 0) + 1
    got = catalog.QUERIES["records_by_patient"](spark, str(tmp_path)).collect()
    assert {r["patient_id"]: r["charges"] for r in got if r["charges"]} == want == {r["patient_id"]: r["payments"] for r in got if r["payments"]}
