"""Mixing sources to target weights: Efraimidis-Spirakis order within each source, complete epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut, maybe_broadcast, prefix_sums

#: Ranges of sampling keys over which a source's prefix sum is spread.
KEY_BUCKETS = 512


def sampling_key(item: Column, weight: Column, seed: int) -> Column:
    """Exponential key -ln(u) / weight; items in ascending order are a weighted sample without replacement."""
    u = (F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """(source, target_share, available, epochs, part): whole repeats of a source, and tokens of a partial one.

    Shares are rescaled over the sources that have documents. Without ``total`` it is the greatest mixture in which
    every source reaches its share within its max_repeats; a larger ``total`` leaves the scarce sources at their cap.
    """
    goal = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    have = sizes.where("size > 0").groupBy("source").agg(F.sum("size").alias("available"))
    live = goal.join(have, "source").where("target_share > 0 and max_repeats > 0")
    whole = live.agg(F.sum("target_share").alias("shares"))
    live = live.crossJoin(F.broadcast(whole)).withColumn("share", F.col("target_share") / F.col("shares"))  # one row
    most = live.agg(F.min(F.col("available") * F.col("max_repeats") / F.col("share")).alias("most"))
    size = F.lit(float(total)) if total is not None else F.col("most")
    b = live.crossJoin(F.broadcast(most)).withColumn("budget", F.least(size * F.col("share"), F.col("available").cast("double") * F.col("max_repeats")))  # one row
    b = b.withColumn("epochs", F.expr("cast(floor(budget / available + 1e-9) as bigint)")).withColumn("part", F.expr("greatest(budget - epochs * available, 0D)"))
    return b.select("source", "target_share", "max_repeats", "available", "epochs", "part")


def mix(documents: DataFrame, targets: DataFrame, item: str = "doc_id", source: str = "source", size: str = "size", weight: str = "weight", total: int | None = None, seed: int = 17) -> DataFrame:
    """(item, source, size, repeats): the documents of the mixture and how often each is used.

    Every document of a source is used in each complete epoch; of the last, partial one the sampled order decides:
    the documents that come first are in as far as they fit, and then the one further document whose size comes nearest
    to the tokens still left, if that is nearer than leaving them. Source names are compared without case and outer spaces. Documents without tokens or of no target
    source are left out, null, zero or negative weights count as the least weight, ties of keys go to the smaller id,
    targets without documents take no part, and an empty table gives no rows. Other columns are ignored.
    """
    docs = documents.select(F.col(item).alias("item"), F.lower(F.trim(source)).alias("source"), F.col(size).cast("bigint").alias("size"), F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(1e-6)).cast("double").alias("weight"))
    docs = docs.where("size > 0 and source is not null")
    plan = budgets(docs, targets, total)
    keyed = docs.join(maybe_broadcast(plan), "source").withColumn("key", sampling_key(F.col("item"), F.col("weight"), seed))
    # the logarithm of a key is spread over a few units around that of 1 / weight, whatever the weight (from 1e-6 to 1e6)
    bucket = F.least(F.greatest(F.floor((F.log("key") + 18) * (KEY_BUCKETS / 36)), F.lit(0)), F.lit(KEY_BUCKETS - 1))
    ordered = cut(prefix_sums(keyed, ["source"], F.col("key"), F.col("size"), bucket, ["item"]).withColumn("inside", F.expr("_before + size <= part")))
    room = ordered.groupBy("source").agg(F.expr("max(part) - coalesce(max(if(inside, _before + size, null)), 0)").alias("room"))
    rest = ordered.where("not inside").join(maybe_broadcast(room), "source").withColumn("off", F.abs(F.col("size") - F.col("room"))).where("off < room")
    last = rest.groupBy("source").agg(F.min(F.struct("off", "key", "item")).alias("last")).select("source", F.col("last.item").alias("last"))  # a row for each target
    chosen = ordered.join(F.broadcast(last), "source", "left").withColumn("repeats", F.col("epochs") + F.expr("if(inside or coalesce(item = last, false), 1, 0)")).where("repeats > 0")
    return chosen.select(F.col("item").alias(item), "source", "size", F.least("repeats", F.col("max_repeats").cast("bigint")).alias("repeats"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, most_repeats) for every target, those without documents included."""
    got = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    goal = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    total = got.agg(F.sum("tokens").alias("total"))
    out = goal.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.expr("coalesce(tokens, 0) / greatest(total, 1)").alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
