"""Units, runs and the catalog: cases that the driver's tables do not hold."""

import uuid

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import folds
from cueloom.plans import runs, units


@pytest.mark.parametrize(
    ("text", "ends"),
    [("", True), ("  ", True), ("Done.", True), ("It is Mr.", False), ("in the U.S.", False), ("she has a Ph.D.", False), ("Hmm.", True), ("with e.g.", False), ("cat.", True), ("Al.", False), ("so", False), ("好。", True), ("3.", True), ("what?", True), ("etc. ", False)],
)
def test_abbreviations_end_no_sentence(spark, text, ends):
    assert spark.createDataFrame([(text,)], "t string").select(T.ends_sentence(F.col("t"))).first()[0] is ends


@pytest.mark.parametrize(("a", "b", "together"), [("New", "York", True), ("careful", "man", True), ("y", "x", False), ("dog", "runs", False), ("New,", "York", False), ("the", "dog", True), ("give", "him", True)])
def test_words_that_stay_together(a, b, together):
    assert folds.must_stay_together(a, b) is together


def test_slices_without_words(spark):
    words = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 200)], "media_id long, word_no long, start_ms long, end_ms long")
    own = spark.createDataFrame([(1, "a", 0, 120), (1, "b", 900, 950), (2, "c", 0, 9)], "media_id long, unit_id string, start_ms long, end_ms long")
    got = {r.unit_id: (r.n_words, r.from_word, r.to_word, r.whole) for r in units.slice_words(words, own).collect()}
    assert got == {"a": (1, 1, 1, False), "b": (2, 1, 2, True), "c": (0, None, None, True)}


def test_bilingual_cue_without_marker(spark):
    rows = [("你好\nHello there",), ("你好\n再见",), ("Hi",), ("你好\n\nHello",), ("<<EN>>",), ("好\n<<EN>>\n",)]
    one, two = units.split_bilingual(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").coalesce(1).select(one, two).collect()]
    assert got == [("你好", "Hello there"), ("你好\n再见", ""), ("Hi", ""), ("你好", "Hello"), ("<<EN>>", ""), ("好", "")]


def test_run_states_and_resuming(spark):
    events = [("a", 1, "running", "x"), ("a", 2, "completed", "x"), ("a", 3, "running", "y"), ("a", 4, "failed", "y"), ("b", 1, "running", "x"), ("b", 2, "completed", "x"), ("b", 3, "done", None), ("c", 1, "completed", "x"), ("d", 1, "running", "z"), ("d", 2, "interrupted", "y")]
    states = runs.run_state(spark.createDataFrame(events, "run string, seq long, kind string, step string"))
    got = {r.run: (r.status, r.current_step, r.failed_step, r.completed) for r in states.collect()}
    assert got == {"a": ("failed", "y", "y", ["x"]), "b": ("completed", None, None, ["x"]), "c": ("running", None, None, ["x"]), "d": ("interrupted", "z", "y", [])}
    assert {r.run: r.step_no for r in runs.resume_step(states, ["x", "y", "z"]).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2}
    assert runs.resume_step(states.where("run = 'c'"), ["x"]).first().step_no == 1


def test_override_of_nulls(spark):
    x = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"}), ({"a": "1"}, None)], "u map<string,string>, v map<string,string>")
    assert [r[0] for r in x.coalesce(1).select(runs.override(F.col("u"), F.col("v"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"a": "1"}]


def test_verdict_of_new_issues_alone(spark):
    rows = [("baseline", 1, "r", "warning"), ("current", 2, "r", "warning"), ("current", 3, "r", "suggestion")]
    row = runs.verdict(spark.createDataFrame(rows, "run string, issue_no long, rule string, severity string"), ["s"]).first()
    assert (row.degraded, row.reasons, row.new_issues, row.errors_delta) == (False, "1 new issues", 1, 0)


def test_catalog_tables(spark, tmp_path):
    name = f"videos_{uuid.uuid4().hex[:8]}"
    try:
        for _ in range(2):
            runs.create_table(spark, name, "id long, title string", f"{tmp_path}/videos")
        runs.insert(spark.createDataFrame([("one", 1)], "title string, id long"), name)
        for _ in range(2):
            runs.add_column(spark, name, "status", "string")
        runs.insert(spark.createDataFrame([(2, "two", "done")], "id long, title string, status string"), name)
        assert sorted(map(tuple, spark.table(name).collect())) == [(1, "one", None), (2, "two", "done")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
