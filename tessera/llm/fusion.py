"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per list over which the ranks of a long list are spread.
RANK_BUCKETS = 64


def list_ranks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rank (1 = highest ``value``; equal values share the least rank) of each row within its list ``keys``.

    Equal values are counted first, so a list whose rows all tie is one row. The distinct values of a list are spread
    over value ranges, whose counts give offsets: a list with a third of all rows is never sorted by one task.
    """
    distinct = scores.groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    spans = distinct.groupBy(*keys).agg(F.percentile_approx("value", [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)], 1000).alias("_cuts"))
    cut = distinct.join(spans, keys).withColumn("_bucket", F.expr("size(filter(_cuts, c -> c > value))")).drop("_cuts")
    totals = cut.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, [*keys, "_bucket"])
    ranked = ranked.select(*keys, "value", (F.col("_offset") + F.col("_inside") + 1).alias("list_rank"))
    return scores.join(ranked, [*keys, "value"])


def fuse(scores: DataFrame, group: str = "group_id", source: str = "list_id", item: str = "item_id", value: str = "value", k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: (group, item, fused_score, n_lists), fused_score = sum of 1 / (k + rank) over the lists.

    ``value`` must be oriented so that higher is better. Null and NaN values are missing: they get no rank and add
    nothing. Repeated rows of an item in a list count once, with its best value. A null group, list or item is left
    out. Empty input gives an empty result. Other columns are ignored, whatever their names.
    """
    clean = scores.select(F.col(group).alias("group_id"), F.col(source).alias("list_id"), F.col(item).alias("item_id"), F.col(value).cast("double").alias("value"))
    clean = clean.where("value is not null and not isnan(value) and group_id is not null and list_id is not null and item_id is not null")
    best = clean.groupBy("group_id", "list_id", "item_id").agg(F.max("value").alias("value"))
    ranked = list_ranks(best, ["group_id", "list_id"])
    fused = ranked.groupBy("group_id", "item_id").agg(F.expr(f"sum(1.0D / ({float(k)}D + list_rank))").alias("fused_score"), F.count("*").alias("n_lists"))
    return fused.select(F.col("group_id").alias(group), F.col("item_id").alias(item), "fused_score", "n_lists")


def top_items(fused: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The n best items of each group; ties go to the smaller item.

    ``max_by`` style bounded aggregation in two levels (by hashed part, then by group), so no task sorts a whole group.
    """
    best = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, n)
    entry: Column = F.struct((-F.round("fused_score", 12)).alias("neg"), F.col(item).alias("item"), "fused_score", "n_lists")
    w = Window.partitionBy(group, "_part").orderBy(F.round("fused_score", 12).desc(), F.col(item))
    part = fused.withColumn("_part", F.pmod(F.xxhash64(item), F.lit(32)))
    part = part.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(group, "_part").agg(F.collect_list(entry).alias("_top"))
    out = part.groupBy(group).agg(best(F.col("_top")).alias("_top")).select(group, F.posexplode("_top").alias("_pos", "_e"))
    return out.select(group, F.col("_e.item").alias(item), (F.col("_pos") + 1).alias("fused_rank"), F.col("_e.fused_score").alias("fused_score"), F.col("_e.n_lists").alias("n_lists"))
