"""Set operations, completeness checks, batches and top-k per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consecutive_groups(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Runs of consecutive numbers: (keys, first_i, last_i, n)."""
    over = Window.partitionBy(*keys).orderBy(index)
    x = rows.withColumn("_g", F.col(index) - F.row_number().over(over))
    return x.groupBy(*keys, "_g").agg(F.min(index).alias("first_i"), F.max(index).alias("last_i"), F.count(F.lit(1)).alias("n")).drop("_g")


def batches(rows: DataFrame, keys: list[str], order: str, size: int, context: int) -> DataFrame:
    """Rows in batches of a size, with so many rows before and after as context. Each row goes to the
    batches it can be context of, which is arithmetic on its number: no join."""
    n = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    last = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1
    n = n.withColumn("_last", F.floor(last / size))
    lo, hi = F.greatest(F.floor((F.col("_r") - context) / size), F.lit(0)), F.least(F.floor((F.col("_r") + context) / size), F.col("_last"))
    x = n.withColumn("batch", F.explode(F.sequence(lo, hi)))
    return x.select(*keys, "batch", order, (F.floor(F.col("_r") / size) != F.col("batch")).alias("context"))


def completeness(want: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that were not seen, or were more than once."""
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    x = want.select(*keys).join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.where("n <> 1").withColumn("kind", F.when(F.col("n") == 0, "missing").otherwise("duplicate"))


def repeats(rows: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Rows of equal ``same`` columns after the first."""
    n = F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    return rows.withColumn("_n", n).where("_n > 1").drop("_n")


def replace_by_key(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``fresh`` in the place of equal keys."""
    return rows.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def multiset_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` as often as they come more than in ``right``."""
    return left.exceptAll(right)


def top_per_key(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each task's rows before it shuffles."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
