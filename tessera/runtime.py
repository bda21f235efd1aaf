"""Session-level helpers: table access, shared checkpoints, size-checked broadcasts, bounded prefix sums."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes (estimated from the optimizer's statistics).
BROADCAST_LIMIT = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the given directory; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a local one serves a local session only: on a cluster
    each executor would write to a disk of its own, so that is an error."""
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = os.path.join(os.environ.get("TMPDIR", "/tmp"), "tessera-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table written to the shared folder, which survives the loss of executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, as its own broadcast decision uses it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcasts a side whose estimated size is under the limit; a larger side keeps the shuffled join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the one with the greatest values of ``order``.

    An aggregation with map-side combining, so a key that holds a third of all rows costs one partial row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def prefix_sums(df: DataFrame, group: list[str], order: Column, size: Column, bucket: Column, tie: list[str]) -> DataFrame:
    """Adds ``_before``: the sum of ``size`` over the rows of the group that come earlier in ``order``.

    ``bucket`` must be a non-decreasing function of ``order`` with a bounded number of values. Rows are summed per
    (group, bucket) first, the bounded bucket totals give offsets, and the row-level window runs per (group, bucket),
    so that a group that holds most rows is spread over its buckets.
    """
    rows = df.withColumn("_order", order).withColumn("_size", size).withColumn("_bucket", bucket)
    totals = rows.groupBy(*group, "_bucket").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_order", *tie).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return (
        summed.join(offsets, [*group, "_bucket"])
        .withColumn("_before", F.col("_offset") + F.col("_inside"))
        .drop("_order", "_size", "_bucket", "_offset", "_inside")
    )
