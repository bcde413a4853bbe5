"""Roll-ups: token usage and cost, regression of reports, and the media catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: USD for a million tokens (cache hit, cache miss, output).
RATES = [("deepseek-v4-flash", 0.0028, 0.14, 0.28), ("deepseek-v4-pro", 0.003625, 0.435, 0.87)]
COST_SOURCES = ["api", "api_buckets", "fallback", "unknown"]


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "model string, hit_rate double, miss_rate double, out_rate double")


def cost(usage: DataFrame) -> DataFrame:
    """``usage`` with cost and its source: what the API says, else by cache buckets, else flat, else unknown."""
    x = usage.join(F.broadcast(rates(usage.sparkSession)), "model", "left")  # a table of a few rows, from above
    out = F.col("completion_tokens") * F.col("out_rate")
    buckets = (F.col("cache_hit_tokens") * F.col("hit_rate") + F.col("cache_miss_tokens") * F.col("miss_rate") + out) / 1e6
    flat = (F.col("prompt_tokens") * F.col("miss_rate") + out) / 1e6
    source = F.when(F.col("cost_usd").isNotNull(), 0).when(buckets.isNotNull(), 1).when(flat.isNotNull(), 2).otherwise(3)
    return x.withColumn("source_rank", source).withColumn("cost", F.coalesce("cost_usd", buckets, flat)).drop("hit_rate", "miss_rate", "out_rate")


def usage_report(usage: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each step and of all (step null); the source is the strongest known."""
    x = cost(usage).rollup("step").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cache_hit_tokens").alias("cache_hit_tokens"), F.sum("cache_miss_tokens").alias("cache_miss_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"), F.min(F.when(F.col("cost").isNotNull(), F.col("source_rank"))).alias("rank"),
    )
    return x.withColumn("cost_source", F.element_at(F.array(*map(F.lit, COST_SOURCES)), F.coalesce("rank", F.lit(3)) + 1)).drop("rank")


def usage_delta(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """What each metric has grown by, in long form, without those that have not."""
    total = lambda df: df.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "v")
    x = total(after).alias("a").join(total(before).withColumnRenamed("v", "was"), [*keys, "metric"], "left")
    return x.withColumn("delta", F.col("v") - F.coalesce("was", F.lit(0))).where("delta <> 0").select(*keys, "metric", "delta")


def rule_pivot(issues: DataFrame) -> DataFrame:
    """Issues of each run and rule by severity, with a total."""
    x = issues.groupBy("run", "rule").pivot("severity", ["error", "warning", "suggestion"]).agg(F.count(F.lit(1)))
    x = x.na.fill(0, ["error", "warning", "suggestion"])
    return x.withColumn("total", F.col("error") + F.col("warning") + F.col("suggestion"))


def rule_cube(issues: DataFrame) -> DataFrame:
    return issues.cube("run", "severity").agg(F.count(F.lit(1)).alias("n"))


def rule_share(issues: DataFrame) -> DataFrame:
    """Each rule's share of a run's issues in percent. The sum over rules is of aggregated rows."""
    x = issues.groupBy("run", "rule").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("run")))


def regression(issues: DataFrame, max_new_errors: int = 0) -> DataFrame:
    """Rules whose number of issues differs between the runs baseline and current."""
    of = lambda run: issues.where(F.col("run") == run).groupBy("rule").agg(F.count(F.lit(1)).alias(run), F.count_if(F.col("severity") == "error").alias(f"{run}_errors"))
    x = of("baseline").join(of("current"), "rule", "full_outer").na.fill(0)
    return x.withColumn("delta", F.col("current") - F.col("baseline")).withColumn("degraded", F.col("current_errors") - F.col("baseline_errors") > max_new_errors)


def new_and_fixed(issues: DataFrame, most: int | None = None) -> DataFrame:
    """The issues by which a rule's number grew or fell: the first of the run that has more."""
    counts = issues.groupBy("rule").agg(F.count_if(F.col("run") == "current").alias("c"), F.count_if(F.col("run") == "baseline").alias("b"))
    over = Window.partitionBy("run", "rule").orderBy("issue_no")
    x = issues.withColumn("k", F.row_number().over(over)).join(counts, "rule")
    new = (F.col("run") == "current") & (F.col("k") <= F.col("c") - F.col("b"))
    fixed = (F.col("run") == "baseline") & (F.col("k") <= F.col("b") - F.col("c"))
    return x.where(new | fixed).select("rule", "issue_no", F.when(new, "new").otherwise("fixed").alias("kind"))


def previous_run(runs: DataFrame) -> DataFrame:
    over = Window.partitionBy("case_name").orderBy("run_seq")
    return runs.select("case_name", "run_seq", "run_id", F.lag("run_id").over(over).alias("previous_run_id"))


def latest_per_key(rows: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, so a task sends one row for each key."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("x")
    return rows.groupBy(key).agg(best).select(key, *(f"x.{c}" for c in columns))


def catalog(videos: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Videos with their number of chunks and their latest run, also those that have none."""
    n = chunks.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    last = latest_per_key(runs, "video_id", ["started_at", "run_id"], ["run_id", "status"])
    x = videos.join(n, "video_id", "left").join(last, "video_id", "left")
    return x.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
