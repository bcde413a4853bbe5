"""Streaming forms, run to the end of what is there."""

from datetime import datetime, timedelta

from cueloom.streaming import progress


def test_streams(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("v1", at, "asr"), ("v1", at + timedelta(minutes=1), "split"), ("v2", at, "asr"), ("v1", at + timedelta(hours=9), "done"), ("v3", at + timedelta(days=3), "asr")]
    spark.createDataFrame(rows, "video_id string, ts timestamp, stage string").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, mode, name):
        stream = spark.readStream.schema("video_id string, ts timestamp, stage string").parquet(str(tmp_path / "in"))
        make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert {(r.video_id, r.stage) for r in run(progress.latest_progress, "complete", "latest")} == {("v1", "done"), ("v2", "asr"), ("v3", "asr")}
    sessions = run(lambda s: progress.pause_sessions(s, ["video_id"], "8 hours", "1 hour"), "append", "sessions")
    assert {(r.video_id, r.n) for r in sessions} >= {("v1", 2), ("v2", 1)}
    assert sum(r.n for r in run(lambda s: progress.windowed_counts(s, ["video_id"], "1 day", "1 hour"), "append", "windows")) == 4
    assert len(run(lambda s: progress.without_repeats(s, ["video_id"], "30 days"), "append", "once")) == 3
