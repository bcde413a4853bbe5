"""Rounds of asking again, with responders that answer late, and states over restarts."""

from pyspark.sql import functions as F

from cueloom.plans import rounds, runs
from cueloom.streaming import states

SEGMENT = "media_id long, unit_id string, start_ms long, end_ms long, text string"
CUE = "media_id long, unit_id string, merged_from array<string>, start_ms long, end_ms long, text string"


class Late:
    """Answers a unit in the round that its table says, and not before."""

    def __init__(self, spark, answers, columns="media_id long, unit_id string, since int, reply string"):
        self.table, self.asked = spark.createDataFrame(answers, columns), []

    def reply(self, prompts):
        self.asked.append(sorted((r.media_id, r.unit_id) for r in prompts.collect()))
        x = prompts.join(self.table, ["media_id", "unit_id"], "left")
        return x.withColumn("reply", F.when(F.col("since") <= F.col("round"), F.col("reply"))).drop("since")


def test_missing_doubled_and_moved_units_are_asked_for_again(spark):
    segments = spark.createDataFrame([(1, f"m1_{k}", 1000 * k, 1000 * k + 900, f"source {k}") for k in range(7)] + [(2, "m1_0", 0, 900, "other")], SEGMENT)
    cues = spark.createDataFrame([
        (1, "m1_0", ["m1_1"], 0, 1900, "a"), (1, "m1_2", [], 2000, 2900, "same"), (1, "m1_3", [], 3000, 3900, "same"), (1, "m1_4", [], 9000, 9900, "far"), (2, "m1_0", None, 0, 900, "kept"),
    ], CUE)
    reasons = {(r.media_id, r.unit_id): r.reason for r in rounds.suspects(segments, cues).collect()}
    assert reasons == {(1, "m1_3"): "duplicate", (1, "m1_4"): "moved", (1, "m1_5"): "missing", (1, "m1_6"): "missing"}
    late = Late(spark, [(1, "m1_3", 1, "three"), (1, "m1_4", 1, "four"), (1, "m1_5", 2, "five"), (1, "m1_6", 3, "six")])
    out, asked = rounds.retry(segments, cues, late)
    got = {(r.media_id, r.unit_id): (r.start_ms, r.text) for r in out.collect()}
    assert asked == [4, 2] and late.asked[1] == [(1, "m1_5"), (1, "m1_6")]
    assert got == {(1, "m1_0"): (0, "a"), (1, "m1_2"): (2000, "same"), (1, "m1_3"): (3000, "three"), (1, "m1_4"): (4000, "four"), (1, "m1_5"): (5000, "five"), (2, "m1_0"): (0, "kept")}
    # No answer at all ends the rounds, and nothing is lost.
    out, asked = rounds.retry(segments, cues, Late(spark, [(1, "m1_3", 9, "three")]))
    assert asked == [4] and out.count() == 5
    out, asked = rounds.retry(segments.where("unit_id = 'm1_2'"), cues.where("unit_id = 'm1_2'"), late)
    assert asked == [] and out.count() == 1


class Scores:
    def __init__(self, worth):
        self.worth, self.seen = worth, []

    def reply(self, prompts):
        self.seen.append(sorted(r.text for r in prompts.collect()))
        worth = F.create_map(*(F.lit(x) for pair in self.worth.items() for x in pair))
        accuracy = F.try_element_at(worth, F.col("text"))
        return prompts.withColumns({"accuracy": accuracy, "fluency": accuracy, "consistency": accuracy, "compression": accuracy})


def test_low_scores_are_rewritten_while_rounds_last(spark):
    cues = spark.createDataFrame([(1, "u1", "good"), (1, "u2", "bad"), (1, "u3", "odd"), (1, "u4", "poor")], "media_id long, unit_id string, text string")
    sources = cues.select("media_id", "unit_id", F.lit("s").alias("source"))
    scores = Scores({"good": 0.9, "bad": 0.1, "poor": 0.2, "better": 0.5, "fine": 0.8, "best": 0.95})
    refiner = Late(spark, [(1, "u2", 1, "better"), (1, "u4", 1, "fine")])
    out, last = rounds.refine(cues, sources, scores, refiner)
    assert scores.seen == [["bad", "good", "odd", "poor"], ["better", "fine"]]
    assert refiner.asked == [[(1, "u2"), (1, "u4")], [(1, "u2")]]
    assert {r.unit_id: r.text for r in out.collect()} == {"u1": "good", "u2": "better", "u3": "odd", "u4": "fine"}
    assert {r.unit_id: (round(r.overall, 6), r["round"]) for r in last.collect()} == {"u1": (0.9, 1), "u2": (0.5, 2), "u4": (0.8, 2)}


def stream(spark, tmp_path, make, schema, rows, mode):
    """One run over what has come since the run before, out of the same checkpoint."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = []
    query = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    query.foreachBatch(lambda df, _: found.extend(df.collect())).start().awaitTermination()
    return found


def test_run_states_over_restarts(spark, tmp_path):
    schema = "run long, seq long, kind string, step string"
    parts = [
        [(1, 1, "running", "a"), (1, 2, "completed", "a"), (1, 3, "running", "b"), (2, 1, "running", "a")],
        [(1, 4, "failed", "b"), (3, 9, "done", None)],
        [(1, 2, "completed", "a"), (1, 6, "running", "b"), (1, 5, "interrupted", "b"), (2, 2, "completed", "a"), (2, 3, "done", None), (3, 1, "running", "z")],
    ]
    now, sent = {}, []
    for part in parts:
        sent += part
        found = stream(spark, tmp_path, states.run_states, schema, part, "update")
        assert {r.run for r in found} == {row[0] for row in part}
        now |= {r.run: tuple(r) for r in found}
        want = {r.run: tuple(r) for r in runs.run_state(spark.createDataFrame(sent, schema)).collect()}
        assert now == want


def test_terms_are_annotated_once_over_restarts(spark, tmp_path):
    schema = "media_id long, cue_no long, annotation string"
    one = stream(spark, tmp_path, states.first_annotations, schema, [(1, 2, "※GPT: a model"), (1, 1, "LLM：large"), (2, 1, "GPT: again"), (1, 3, "GPT: once more")], "append")
    assert {(r.media_id, r.cue_no, r.term, r.known) for r in one} == {(1, 1, "LLM", 0), (1, 2, "GPT", 1), (2, 1, "GPT", 0)}
    two = stream(spark, tmp_path, states.first_annotations, schema, [(1, 5, "GPT: late"), (1, 4, "JEPA: new"), (2, 2, "")], "append")
    assert {(r.media_id, r.cue_no, r.term, r.known) for r in two} == {(1, 4, "JEPA", 2)}
