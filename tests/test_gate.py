"""What stops a text beyond patterns, and the month of a document."""

from pyspark.sql import functions as F

from quillspark.operators import checks, privacy


def test_names_suspects_and_past_names_stop_a_text(spark):
    bodies = spark.createDataFrame([(1, "met Noam Levi's aunt"), (2, "no one here"), (3, "the Su​spect word"), (4, "gone name"), (5, None), (6, "noam LEVI, gone")], "id long, text string")
    gated = privacy.gate(bodies, [], [], 1000)
    known = spark.createDataFrame([("Noam Levi", "a", 0)], "name string, payload string, rank int")
    suspects = spark.createDataFrame([(3, "suspect", None), (2, "one", True), (1, "absent", False)], "id long, word string, resolved boolean")
    past = spark.createDataFrame([("Gone",)], "word string").select(privacy.past_hash(F.col("word"), "k").alias("hash"))
    got = {r.id: (r.reasons, r.sha256 is None) for r in privacy.gate_with_names(bodies, gated, known, suspects, past, "k").collect()}
    assert got == {1: ("identity", True), 2: ("", False), 3: ("suspect", True), 4: ("past_name", True), 5: ("", False), 6: ("identity,past_name", True)}
    other = {r.id: r.reasons for r in privacy.gate_with_names(bodies, gated, known.where("false"), suspects.where("false"), past, "another key").collect()}
    assert set(other.values()) == {""}


def test_hidden_characters_are_taken_out_before_the_gate_looks(spark):
    bodies = spark.createDataFrame([(1, "call 212​-555‏-0199"), (2, "1​2​3​4​5"), (3, "12 34")], "id long, text string")
    got = {r.id: r.reasons for r in privacy.gate(bodies, [], [], 1000).collect()}
    assert got == {1: "pattern:phone", 2: "pattern:number", 3: ""}


def test_the_month_of_a_document_is_its_latest_date_that_is_no_birth(spark):
    cases = {
        "3-9-2020": "2020-09", "3.9.20 and 1/2/49": "2049-02", "12/5/85": None, "March 2020": "2020-03", "of May, 2021 or 4/2022": "2022-04", "2024-05-06": None,
        "31.12.1989": None, "32.1.2001 0.1.2001 1.13.2001": None, "born 1.1.2030\nseen 1.1.2001": "2001-01", "1.2.3.2004": None, "April 20201": None, "": None, None: None,
    }
    rows = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert [(r.text, r.got) for r in rows.select("text", "want", checks.document_month(F.col("text")).alias("got")).collect() if r.got != r.want] == []
