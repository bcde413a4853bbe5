"""One-to-one matches by weight, and cues of two languages as groups on screen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.operators.checkpoints import cut
from cueloom.operators.intervals import overlap_join

# What lies between a group of one language and its neighbours, in milliseconds.
GAP_MS = 10


def heaviest_pairs(pairs: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """The pairs that remain if the heaviest of all is taken again and again and both its ends go: (keys, left, right).

    Of equal weights the smaller left goes first, then the smaller right. A pair that is the heaviest at both
    of its ends is taken whatever happens elsewhere, so each round takes all of these at once, wherever they are;
    rounds end when nothing is left, and each costs two shuffles. Repeated pairs count once; pairs with
    a null end or weight are left out.
    """
    open_ = cut(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(weight).isNotNull()).groupBy(*keys, left, right).agg(F.max(weight).alias(weight)))
    taken: list[DataFrame] = []
    at_left, at_right = Window.partitionBy(*keys, left), Window.partitionBy(*keys, right)
    order = [F.desc(weight), F.col(left), F.col(right)]
    while open_.limit(1).count():
        x = open_.withColumn("l_rank", F.row_number().over(at_left.orderBy(*order))).withColumn("r_rank", F.row_number().over(at_right.orderBy(*order)))
        x = x.withColumn("is", (F.col("l_rank") == 1) & (F.col("r_rank") == 1))
        gone = F.max("is").over(at_right)
        x = cut(x.withColumn("r_gone", gone).withColumn("gone", F.max("is").over(at_left) | F.col("r_gone")).select(*keys, left, right, weight, "is", "gone"))
        taken.append(x.where("is").select(*keys, left, right))
        open_ = x.where("NOT gone").select(*keys, left, right, weight)
    return reduce(DataFrame.unionByName, taken, open_.select(*keys, left, right))


def bilingual_groups(cues: DataFrame, source: str = "en", known: DataFrame | None = None) -> DataFrame:
    """Cues of two languages as groups on screen: (media_id, group_no, target_no, source_no, start_ms, end_ms).

    Each target cue takes the source cue that it overlaps most, the longest overlaps first and each source cue once.
    ``known`` (media_id, target_no, source_no) are partners that are known before, as by their units: such targets
    take no other, and such sources are nobody else's; a target with several has a group for each.
    Source cues left over are fitted between their neighbours, and go where there is no room.
    """
    targets, sources = cues.where(F.col("lang") != source), cues.where(F.col("lang") == source)
    none = cues.sparkSession.createDataFrame([], "media_id long, target_no long, source_no long")
    known = none if known is None else known.select("media_id", "target_no", "source_no")
    free_t = targets.join(known.select("media_id", F.col("target_no").alias("cue_no")), ["media_id", "cue_no"], "left_anti")
    free_s = sources.join(known.select("media_id", F.col("source_no").alias("cue_no")), ["media_id", "cue_no"], "left_anti")
    met = overlap_join(free_t, free_s, ["media_id"]).select("media_id", F.col("l_cue_no").alias("target_no"), F.col("r_cue_no").alias("source_no"), "overlap_ms")
    partners = heaviest_pairs(met, ["media_id"], "target_no", "source_no", "overlap_ms").unionByName(known)
    own = targets.select("media_id", F.col("cue_no").alias("target_no"), "start_ms", "end_ms").join(partners, ["media_id", "target_no"], "left")
    lone = sources.select("media_id", F.col("cue_no").alias("source_no"), "start_ms", "end_ms").join(partners, ["media_id", "source_no"], "left_anti").withColumn("target_no", F.lit(None).cast("long"))
    return _fitted(own.unionByName(lone))


def _fitted(groups: DataFrame) -> DataFrame:
    """Groups in order of time; those without a target keep clear of the end before and the start after.

    What a group before ends at is known but where that was fitted itself, so only runs of such
    groups, with the one before them, are folded.
    """
    lone = F.col("target_no").isNull()
    over = Window.partitionBy("media_id").orderBy("start_ms", lone, F.coalesce("target_no", "source_no"), "source_no")
    x = groups.withColumns({"next": F.lead("start_ms").over(over), "run": F.sum((~lone).cast("int")).over(over), "k": F.row_number().over(over)})
    runs = x.groupBy("media_id", "run").agg(F.array_sort(F.collect_list(F.struct("k", "target_no", "source_no", "start_ms", "end_ms", "next"))).alias("rows"))
    shown = "array<struct<start:bigint,end:bigint,until:bigint>>"

    def step(done: Column, g: Column) -> Column:
        until = F.try_element_at(done, F.lit(-1))["until"]
        start = F.when(g["target_no"].isNull() & (until > 0), F.greatest(g["start_ms"], until + GAP_MS)).otherwise(g["start_ms"])
        near = g["target_no"].isNull() & (g["end_ms"] > g["next"] - GAP_MS)
        end = F.when(near, F.greatest(start + GAP_MS, g["next"] - GAP_MS)).otherwise(g["end_ms"])
        kept = g["target_no"].isNotNull() | (start < end)
        return F.concat(done, F.array(F.struct(start.alias("start"), F.when(kept, end).alias("end"), F.when(kept, end).otherwise(until).alias("until"))).cast(shown))

    each = runs.withColumn("shown", F.aggregate("rows", F.array().cast(shown), step)).select("media_id", F.explode(F.arrays_zip("rows", "shown")).alias("g"))
    each = each.select("media_id", "g.rows.*", F.col("g.shown.start").alias("s"), F.col("g.shown.end").alias("e")).where("e IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("k")).cast("long")
    return each.select("media_id", number.alias("group_no"), "target_no", "source_no", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
