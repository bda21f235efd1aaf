"""Fusion of ranked lists, diversity, contexts, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CONTEXT = 60.0, 24


def reciprocal_ranks(lists: list[DataFrame], key: str = "frame_id", k: float = RRF_K) -> DataFrame:
    """(key, fused, best_rank): sum over the lists (key, rank) of 1 / (k + rank), best first."""
    every = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    return every.groupBy(key).agg(F.expr(f"sum(1D / ({k}D + rank))").alias("fused"), F.min("rank").alias("best_rank")).orderBy(F.round("fused", 12).desc(), "best_rank", key)


def diversify(hits: DataFrame, group: str, k: int) -> DataFrame:
    """One hit of each group first, then the others in rank order, k in all; adds ``place``."""
    first = F.row_number().over(Window.partitionBy(group).orderBy("rank")) > 1
    placed = hits.withColumn("_later", first.cast("int"))
    order = Window.orderBy("_later", "rank")
    return placed.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k).drop("_later")


def context(hits: DataFrame, text: str = "search_text", chars: int = 400) -> DataFrame:
    """One row: the first 24 diversified hits rendered with their numbers, for a reader model."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.substring(text, 1, chars))
    best = hits.where(F.col("place") <= CONTEXT).select(F.struct("place", line.alias("line")).alias("x"))
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n").alias("context"), F.count("*").alias("n_hits"))


def citations(hits: DataFrame, n: int = 3, chars: int = 160) -> DataFrame:
    """One row: the extractive answer, the n best snippets with [n] marks."""
    top = hits.where(F.col("rank") <= n).select(F.struct("rank", F.concat(F.substring("search_text", 1, chars), F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("s")).alias("x"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.s), " ").alias("answer"), F.count("*").alias("n_citations"))


def promote_extremes(hits: DataFrame) -> DataFrame:
    """Earliest and latest hits first, then the others by rank; ranks are given anew."""
    ends = hits.agg(F.min_by("frame_id", F.struct("ts", "frame_id")).alias("_first"), F.max_by("frame_id", F.struct("ts", "frame_id")).alias("_last"))
    marked = hits.crossJoin(F.broadcast(ends))  # one row
    kind = F.when(F.col("frame_id") == F.col("_first"), 0).when(F.col("frame_id") == F.col("_last"), 1).otherwise(2)
    return marked.withColumn("rank", F.row_number().over(Window.orderBy(kind, "rank")).cast("bigint")).drop("_first", "_last")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """A bounded result page with its ``rank`` from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
