"""Runs and rows under a manifest: what readers see, whatever writers do."""

import pytest

from cueloom.sources import mixed, versions


def issues(spark, *rows):
    return spark.createDataFrame(list(rows), "rule string, severity string")


def test_runs_and_versions(spark, tmp_path):
    root = str(tmp_path / "case")
    assert versions.Versions(spark, root).latest() == 0 and versions.read_baseline(spark, root) is None
    assert versions.save_run(issues(spark, ("A", "error")), root, "r1", git="abc") == 1
    assert versions.save_run(issues(spark, ("A", "error"), ("B", "warning")), root, "r2") == 2
    assert versions.set_baseline(spark, root, "r1") == 3
    assert versions.previous_run(spark, root, "r2") == "r1" and versions.previous_run(spark, root, "r1") is None
    # A run saved anew leaves the baseline and older versions as they were.
    assert versions.save_run(issues(spark), root, "r1") == 4
    assert versions.read_baseline(spark, root).count() == 1
    assert versions.read_run(spark, root, "r1").count() == 0 and versions.read_run(spark, root, "r1", version=2).count() == 1
    assert versions.read_run(spark, root, version=2).count() == 2
    got = {(r.run_no, r.run_id, r.rule, r.severity, r.n, r.is_baseline, r.is_latest) for r in versions.overview(spark, {"c": root}).collect()}
    assert got == {(1, "r1", None, None, 0, True, True), (2, "r2", "A", "error", 1, False, False), (2, "r2", "B", "warning", 1, False, False)}
    with pytest.raises(KeyError):
        versions.read_run(spark, root, "r9")


def test_a_crash_and_a_conflict_leave_the_version_before(spark, tmp_path):
    root = str(tmp_path / "case")
    versions.save_run(issues(spark, ("A", "error")), root, "r1")
    v = versions.Versions(spark, root)
    issues(spark, ("X", "error")).write.parquet(v.folder())  # data, and then nothing more
    (tmp_path / "case" / "_versions" / ".draft").write_text("{half a manif")
    assert v.latest() == 1 and versions.read_run(spark, root).first().rule == "A"
    assert v.commit(1, {"latest": "a"}) == 2
    with pytest.raises(versions.Conflict):
        v.commit(1, {"latest": "b"})
    assert v.read()["latest"] == "a" and v.latest() == 2


def test_upsert_and_delete_against_a_dictionary(spark, tmp_path):
    root, want = str(tmp_path / "table"), {}
    kind = "id string, title string, n long"
    for step in range(5):
        rows = [(f"v{(step * 7 + k) % 20}", f"t{step}", k) for k in range(6)]
        before = versions.read_rows(spark, root)
        old = sorted(map(tuple, before.collect())) if before else []
        assert versions.upsert(spark.createDataFrame(rows, kind), root, "id", parts=4) == step + 1
        # A reader that listed the files before the upsert still reads the rows of then.
        assert before is None or sorted(map(tuple, before.collect())) == old
        want |= {r[0]: r for r in rows}
        assert sorted(map(tuple, versions.read_rows(spark, root).collect())) == sorted(want.values())
    assert sorted(r.id for r in versions.read_rows(spark, root, 1).collect()) == sorted(f"v{k}" for k in range(6))
    gone = ["v1", "v2", "nobody"]
    version = versions.delete(spark.createDataFrame([(g,) for g in gone], "id string"), root, "id", parts=4)
    assert sorted(r.id for r in versions.read_rows(spark, root).collect()) == sorted(set(want) - set(gone))
    everything = spark.createDataFrame([(k,) for k in want], "id string")
    assert versions.delete(everything, root, "id", parts=4) == version + 1 and versions.read_rows(spark, root) is None
    assert versions.upsert(spark.createDataFrame([("z", "t", 1)], kind), root, "id", parts=4) == version + 2


def test_untouched_parts_are_not_written_again(spark, tmp_path):
    root = str(tmp_path / "table")
    versions.upsert(spark.createDataFrame([(k, 0) for k in range(50)], "id long, n long"), root, "id", parts=8)
    before = versions.Versions(spark, root).read()["parts"]
    versions.upsert(spark.createDataFrame([(3, 1)], "id long, n long"), root, "id", parts=8)
    after = versions.Versions(spark, root).read()["parts"]
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1


def test_bilingual_webvtt_reads_back(spark):
    from cueloom.plans import units
    from cueloom.sources import artifacts, subtitles

    rows = [("f", 0, 1000, "你好\n吗", "hi  there\n"), ("f", 1000, 2000, "", " "), ("f", 2000, 3000, None, "only"), ("f", 3000, 4000, "只", None)]
    groups = spark.createDataFrame(rows, "file string, start_ms long, end_ms long, target string, source string")
    (out,) = artifacts.bilingual_vtt(groups, ["file"]).collect()
    assert out.content == (
        "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\n你好\n吗\n<<EN>>\nhi there\n\n2\n00:00:02.000 --> 00:00:03.000\nonly\n\n3\n00:00:03.000 --> 00:00:04.000\n只\n\n"
    )
    read = subtitles.parse_vtt(spark.createDataFrame([("f", out.content)], "file string, content string"), "content", ["file"])
    one, two = units.split_bilingual(read["text"])
    assert [(r.a, r.b) for r in read.orderBy("index").select(one.alias("a"), two.alias("b")).collect()][0] == ("你好\n吗", "hi there")
    assert artifacts.bilingual_vtt(groups.limit(0), ["file"]).collect() == []


def test_a_folder_of_mixed_formats(spark, tmp_path):
    (tmp_path / "a.SRT").write_text("1\n00:00:01,000 --> 00:00:02,000\n你好\n\n2\n00:00:03,000 --> 00:00:04,000\n好\n\n3\n00:00:05,000 --> 00:00:06,000\nok\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nHello\n\n00:02.000 --> 00:03.000\n你\n")
    (tmp_path / "c.ass").write_text("[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,One\\NTwo, three\n")
    (tmp_path / "d.json").write_text('{"cues": [{"id": "x", "start": 1.5, "end": 2, "zh_text": "abc", "lang": "zh"}]}')
    (tmp_path / "e.srt").write_text("")
    files = lambda pattern: spark.read.option("pathGlobFilter", pattern).text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_name AS path", "value AS content")
    got = {(r.path, r.lang, r["index"], r.cue_id, r.start_ms, r.end_ms, r.text, r.cue_lang) for r in mixed.load_mixed(files("*.*")).collect()}
    assert got == {
        ("a.SRT", "zh", 1, None, 1000, 2000, "你好", "zh"), ("a.SRT", "zh", 2, None, 3000, 4000, "好", "zh"), ("a.SRT", "zh", 3, None, 5000, 6000, "ok", "en"),
        ("b.vtt", "en", 1, None, 1000, 2000, "Hello", "en"), ("b.vtt", "en", 2, None, 2000, 3000, "你", "zh"), ("c.ass", "en", 1, None, 1000, 2500, "One\nTwo, three", "en"),
        ("d.json", "zh", 1, "x", 1500, 2000, "abc", "zh"),
    }
    (tmp_path / "f.txt").write_text("no")
    with pytest.raises(Exception, match="no subtitle format"):
        mixed.load_mixed(files("*.*")).collect()
