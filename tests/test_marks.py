"""Phrases that stand in texts."""

from quillspark.operators import lists

TEXTS = [(1, "The of, of the! and", True), (1, "and so and so", True), (2, "the off and-the", False), (3, None, True), (4, "", False), (4, "of the of the", None)]
PATTERNS = [("of the", "x", 0.5), ("of the", "y", 0.4), ("and", "", 0.9), ("the of the of", "z", 0.1), ("", "e", 1.0), ("And", "u", 1.0), (None, "n", 1.0)]


def test_marks_meet_whole_words_and_move_no_text(spark):
    texts = spark.createDataFrame([x[:2] for x in TEXTS], "id long, text string")
    found = lists.marks(texts, spark.createDataFrame(PATTERNS, "phrase string, instead string, sure double"), 2)
    assert sorted(map(tuple, found.collect())) == [(1, "and", "", 1), (1, "and", "", 2), (2, "and", "", 1), (4, "of the", "x", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan


def test_exposures_count_rows_of_one_id_once_each(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string, approved boolean")
    found = lists.exposures(texts, spark.createDataFrame(PATTERNS, "phrase string, instead string, sure double"))
    assert sorted(map(tuple, found.collect())) == [("and", 2, 3), ("of the", 1, 2)]
