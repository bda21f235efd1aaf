"""Connected components by alternating neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node in ``edges``; component is the least id of the class. Null ends are ignored.

    Large-star / small-star rounds (Kiveris et al. 2014), each one grouped minimum over the edges: a hub's edges are
    folded before the shuffle, and the edge table is cut after each round. Goes on until a round changes nothing; the number of rounds grows
    with the logarithm of the number of nodes.
    """
    e = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x is not null and y is not null and x <> y").distinct()
    nodes = edges.select(F.explode(F.array(a, b)).alias("id")).where("id is not null").distinct()
    e, before = cut(e), None
    while True:
        both = e.select("x", "y").union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select("x", "y", "m")
        small = small.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").union(low.select("x", F.col("m").alias("y"))).distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = e.groupBy("x").agg(F.min("y").alias("m"))
    return nodes.join(found, nodes.id == found.x, "left").select("id", F.coalesce("m", "id").alias("component"))
