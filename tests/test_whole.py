from quillspark.operators import records, text


def test_ancestors_of_deep_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(1000, 1001), (1001, 1000), (1002, 1000), (2000, 3000)]
    got = {r.id: (r.root, r.depth) for r in records.ancestors(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {i: (0, i) for i in range(200)} | {i: (None, None) for i in (1000, 1001, 1002)} | {2000: (3000, 1)}


def test_masks_are_numbered_in_ranges(spark):
    docs = spark.createDataFrame([(i, f"u{i % 300}@x.org v{i}@x.org") for i in range(400)], "doc_id long, text string").repartition(7)
    seen = {}
    for i in range(400):
        for v in (f"u{i % 300}@x.org", f"v{i}@x.org"):
            seen.setdefault(v, f"[email_{len(seen) + 1}]")
    out = text.masks(docs)
    assert {r.value: r.tag for r in out.collect()} == seen
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
