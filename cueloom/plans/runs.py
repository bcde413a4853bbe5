"""Runs, steps, files and the catalog: what is left to do, what got worse, what belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "suggestion")


def by_severity(issues: DataFrame) -> DataFrame:
    """Issues with the rank of their severity, errors first and otherwise in the order they came (issue_no)."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) - 1
    return issues.withColumn("severity_rank", rank).orderBy("severity_rank", "issue_no")


def verdict(issues: DataFrame, strict: list[str], max_new_errors: int = 0) -> DataFrame:
    """One row: how much more errors, warnings and suggestions the run current has than baseline, whether it
    is worse, and why. Only more errors than allowed, or a strict rule with more issues, make it worse;
    other new issues are a reason alone."""
    sign = F.when(F.col("run") == "current", 1).when(F.col("run") == "baseline", -1).otherwise(0)
    by_rule = issues.groupBy("rule").agg(*(F.coalesce(F.sum(F.when(F.col("severity") == s, sign)), F.lit(0)).alias(s) for s in SEVERITIES), F.count_if(F.col("run") == "baseline").alias("b"), F.count_if(F.col("run") == "current").alias("c"))
    worse = F.col("rule").isin(strict) & (F.col("c") > F.col("b"))
    x = by_rule.agg(
        *(F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}s_delta") for s in SEVERITIES), F.coalesce(F.sum(F.greatest(F.col("c") - F.col("b"), F.lit(0))), F.lit(0)).alias("new_issues"),
        F.array_sort(F.collect_list(F.when(worse, F.concat(F.lit("strict rule "), "rule", F.lit(": "), "b", F.lit(" to "), "c")))).alias("strict"),
    )
    more = F.col("errors_delta") > max_new_errors
    reasons = F.concat(
        F.when(more, F.array(F.concat(F.lit("errors: +"), "errors_delta"))).otherwise(F.array().cast("array<string>")), F.col("strict"),
        F.when(F.col("new_issues") > 0, F.array(F.concat("new_issues", F.lit(" new issues")))).otherwise(F.array().cast("array<string>")),
    )
    return x.select(*(f"{s}s_delta" for s in SEVERITIES), "new_issues", (more | (F.size("strict") > 0)).alias("degraded"), F.array_join(reasons, "; ").alias("reasons"))


def run_state(events: DataFrame) -> DataFrame:
    """The state of each run after its events (run, seq, kind, step): kinds running, completed, failed and
    interrupted are of a step, done is of the run.

    status is that of the last event that sets one; failed_step is cleared when a step starts. One
    aggregate: a task sends one row for each run.
    """
    at = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct("seq", "kind", "step")))
    x = events.groupBy("run").agg(
        at("running", "failed", "interrupted", "done").alias("last"), at("running", "failed", "interrupted").alias("fail"), at("running", "done").alias("current"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "completed", F.col("step")))).alias("completed"),
    )
    status = F.when(F.col("last.kind") == "done", "completed").otherwise(F.coalesce(F.col("last.kind"), F.lit("running")))
    failed = F.when(F.col("fail.kind") != "running", F.col("fail.step"))
    return x.select("run", status.alias("status"), F.when(F.col("current.kind") == "running", F.col("current.step")).alias("current_step"), failed.alias("failed_step"), "completed")


def resume_step(states: DataFrame, plan: list[str]) -> DataFrame:
    """(run, step_no): where to go on. The failed step, or the current one (always, if interrupted); without
    either the first step of the plan that is not completed, or its length."""
    steps = F.array(*map(F.lit, plan))
    target = F.when((F.col("status") == "interrupted") & F.col("current_step").isNotNull(), F.col("current_step")).otherwise(F.coalesce("failed_step", "current_step"))
    named = F.nullif(F.array_position(steps, target), F.lit(0)) - 1
    left = F.filter(F.transform(steps, lambda s, i: F.when(F.array_contains("completed", s), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return states.select("run", F.coalesce(named, F.get(left, 0), F.lit(len(plan))).cast("long").alias("step_no"))


def missing_artifacts(required: DataFrame, present: DataFrame) -> DataFrame:
    """Artifacts (run, step, path) that a step needs and that are not there."""
    return required.join(present.select("run", "path"), ["run", "path"], "left_anti").select("run", "step", "path")


def override(automatic: Column, own: Column) -> Column:
    """A map with the entries of ``own`` over those of ``automatic``; either may be null."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(automatic, empty), F.coalesce(own, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def first_of_pair(hints: DataFrame, pair: tuple[str, str], order: list[str]) -> DataFrame:
    """Hints of each pair of units, the first alone."""
    n = F.row_number().over(Window.partitionBy(*pair).orderBy(*order))
    return hints.withColumn("_n", n).where("_n = 1").drop("_n")


# Files of a library.

VIDEO, SUBTITLE = r"\.(mp4|webm|mkv)$", r"(?i)\.(srt|vtt|ass)$"


def subtitle_language(key: Column) -> Column:
    """The two letters of a subtitle's language in its key, null for annotations and bilingual files."""
    found = F.coalesce(F.nullif(F.regexp_extract(key, r"(?i)^([a-z]{2})\.(?:srt|vtt|ass)$", 1), F.lit("")), F.nullif(F.regexp_extract(key, r"(?i)\.([a-z]{2})\.(?:srt|vtt|ass)$", 1), F.lit("")))
    other = F.contains(key, F.lit(".annotations.")) | F.startswith(key, F.lit("annotations.")) | F.startswith(key, F.lit("bilingual"))
    return F.when(~other, F.lower(found))


def discover(files: DataFrame) -> DataFrame:
    """(dir, video, segment, subtitle, key) of the files (dir, name) of a library: each folder's videos with
    their subtitles (null: none).

    Where a folder has parts (_p1, _p2), its other videos are left out. A subtitle belongs to the video
    whose stem it has or goes on with a dot; a single video also has all other SRT and WebVTT files. Without
    a video these are a chunk of their own, whose video is empty.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    part = F.regexp_extract("stem", r"_p(\d+)$", 1)
    videos = files.where(F.col("name").rlike(VIDEO)).withColumn("stem", stem).withColumn("part", part)
    over = Window.partitionBy("dir")
    videos = videos.withColumn("parts", F.max(F.col("part") != "").over(over)).where("NOT parts OR part <> ''").withColumn("n", F.count(F.lit(1)).over(over))
    videos = videos.select("dir", F.col("name").alias("video"), "stem", F.when(F.col("part") != "", F.concat(F.lit("p"), "part")).otherwise("").alias("segment"), "n")
    subs = files.where(F.col("name").rlike(SUBTITLE)).select("dir", F.col("name").alias("subtitle"), stem.alias("sub_stem"))
    # A subtitle meets the stems that it could go on from: itself, and itself up to each of its dots.
    pieces = F.split("sub_stem", r"\.")
    stems = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, 1, k), "."))
    by_stem = subs.withColumn("stem", F.explode(stems)).join(videos, ["dir", "stem"])
    key = F.when(F.col("sub_stem") == F.col("stem"), F.col("subtitle")).otherwise(F.substring("subtitle", F.length("stem") + 2, F.length("subtitle")))
    own = by_stem.select("dir", "video", "segment", "subtitle", key.alias("key"))
    root = subs.where(~F.lower("subtitle").endswith(".ass"))
    lone = root.join(videos.where("n = 1"), "dir").select("dir", "video", "segment", "subtitle", F.col("subtitle").alias("key"))
    lone = lone.join(own, ["dir", "video", "key"], "left_anti").select("dir", "video", "segment", "subtitle", "key")
    bare = root.join(videos, "dir", "left_anti").select("dir", F.lit("").alias("video"), F.lit("").alias("segment"), "subtitle", F.col("subtitle").alias("key"))
    found = own.unionByName(lone).unionByName(bare)
    none = videos.join(found, ["dir", "video"], "left_anti").select("dir", "video", "segment", F.lit(None).cast("string").alias("subtitle"), F.lit(None).cast("string").alias("key"))
    return found.unionByName(none)


def resolve_subtitle(chunks: DataFrame, files: DataFrame, lang: str, form: str) -> DataFrame:
    """(dir, video, path) of each chunk's subtitle in a language: by its key, by a key that ends like it, by the file
    of that name in the folder, by that of the video's stem; the first that there is."""
    wanted, ending = f"{lang}.{form}", f".{lang}.{form}"
    keyed = chunks.groupBy("dir", "video").agg(
        F.min(F.when(F.col("key") == wanted, F.col("subtitle"))).alias("exact"), F.min(F.when(F.col("key").endswith(ending), F.col("subtitle"))).alias("suffix"),
    )
    there = files.select("dir", F.col("name").alias("there"))
    x = keyed.withColumn("stemmed", F.concat(F.regexp_replace("video", r"\.[^.]*$", ""), F.lit(ending)))
    direct = there.where(F.col("there") == wanted).select("dir", F.col("there").alias("direct")).distinct()
    x = x.join(direct, "dir", "left").join(there.withColumnRenamed("there", "stem_file").distinct(), (x["dir"] == there["dir"]) & (x["stemmed"] == F.col("stem_file")), "left").select(x["dir"], "video", "exact", "suffix", "direct", "stem_file")
    return x.select("dir", "video", F.coalesce("exact", "suffix", "direct", "stem_file").alias("path")).where("path IS NOT NULL")


# The catalog's tables.


def create_table(spark: SparkSession, name: str, columns: str, location: str) -> None:
    """A table of the catalog below a shared folder, if there is none yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{location}'")


def add_column(spark: SparkSession, name: str, column: str, kind: str) -> None:
    """A further column, null in the rows that are there, unless the table has it."""
    if column not in spark.table(name).columns:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({column} {kind})")


def insert(rows: DataFrame, name: str) -> None:
    """Rows added to a table, columns by name."""
    rows.select(*rows.sparkSession.table(name).columns).write.insertInto(name)
