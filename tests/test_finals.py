"""Finished reports that are learned from and taken back, in a batch and in streams."""

import random
import tempfile

import pytest

from quillspark.streaming import finals

SCHEMA = "author long, seq long, case string, action string, n long, total long, squares long"


def walk(rows):
    """Each author's cases, action by action, fading as they go."""
    cases, out = {}, {}
    for author, _, case, action, n, total, squares in sorted(rows, key=lambda r: r[1]):
        if author is None or case is None or action not in (finals.FINAL, finals.FORGET):
            continue
        mine = cases.setdefault(author, {})
        mine.pop(case, None)
        if action == finals.FINAL and n:
            for c in mine:
                mine[c] = [v * finals.FADE for v in mine[c]]
            mine[case] = [n, total, squares]
    for author, mine in cases.items():
        n, total, squares = (sum(v[i] for v in mine.values()) for i in range(3))
        mean = total / n if n else None
        out[author] = (len(mine), n, mean, (max(squares - total * mean, 0) / (n - 1)) ** 0.5 if n > 1 else 0.0 if n else None)
    return out


def rows_of(seed, many=120):
    rnd, out = random.Random(seed), []
    for seq in range(many):
        values = [rnd.randrange(50) for _ in range(rnd.choice([0, 1, 3, 5]))]
        out.append((rnd.choice([1, 2, 3, None]), seq, rnd.choice(["a", "b", "c", "d", None]), rnd.choice(["final", "final", "forget", "other"]), len(values), sum(values), sum(v * v for v in values)))
    return out + [(9, many, "a", "final", 2, 3, 5), (9, many + 1, "a", "forget", None, None, None)]


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert [x if x is None else pytest.approx(x, abs=1e-9) for x in want[k]] == list(got[k])


def test_a_batch_is_the_walk(spark):
    for seed in range(3):
        rows = rows_of(seed)
        same({r.author: tuple(r)[1:] for r in finals.moments(spark.createDataFrame(rows, SCHEMA)).collect()}, walk(rows))
    assert finals.moments(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stream_in_any_split_ends_as_the_batch(spark):
    rows, conf = rows_of(7, 40), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = tempfile.mkdtemp(prefix="spark-")
        for begin, end in ((0, 1), (1, 20), (20, 42)):
            spark.createDataFrame(rows[begin:end], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = finals.moments_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        seen = {}

        def keep(df, batch):
            seen.update({r.author: tuple(r)[1:] for r in df.collect()})

        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination(200)
        # pandas writes a missing mean as not a number
        got = {k: tuple(None if isinstance(x, float) and x != x else x for x in v) for k, v in seen.items()}
        same(got, walk(rows))
    finally:
        spark.conf.set(conf, before)
