"""The entity graph: merging nodes and edges, statistics, walks along links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut, maybe_broadcast


def node_id(name, kind):
    return F.xxhash64(F.lower(F.trim(name)), kind)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, name, kind, frames, mentions, frame_ids, confidence): mentions of one canonical name and kind are one node.

    ``frames`` and ``mentions`` are counts; ``frame_ids`` lists the distinct frames, in order.
    """
    n = nodes.withColumn("node_id", node_id(F.col("name"), F.col("kind")))
    return n.groupBy("node_id", F.lower(F.trim("name")).alias("name"), "kind").agg(F.count_distinct("frame_id").alias("frames"), F.count("*").alias("mentions"), F.array_sort(F.collect_set("frame_id")).alias("frame_ids"), F.max("confidence").alias("confidence"))


def find(merged: DataFrame, name: str | None = None, kind: str | None = None, frame_id: int | None = None) -> DataFrame:
    """Nodes by canonical name, by kind, or of a frame."""
    out = merged
    if name is not None:
        out = out.where(F.col("name") == name.strip().lower())
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if frame_id is not None:
        out = out.where(F.array_contains("frame_ids", F.lit(frame_id).cast("bigint")))
    return out


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, link), the one of the least frame, on a tie of the least confidence."""
    return edges.groupBy("src", "dst", "link").agg(F.min_by("confidence", F.struct("frame_id", "confidence")).alias("confidence"), F.min("frame_id").alias("frame_id"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): histograms of node kinds and link types."""
    a = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    b = edges.groupBy("link").agg(F.count("*").alias("n")).select(F.lit("link").alias("what"), F.col("link").alias("kind"), "n")
    return a.unionByName(b)


# Words by which links are asked for, beside their own names.
LINK_NAMES = {
    "manager": "manages managed_by", "member": "member_of", "owner": "owns owned_by", "author": "wrote written_by", "email": "contact", "deadline": "due due_date", "location": "located_in at",
    "employer": "works_at employed_by", "parent": "parent_of", "child": "child_of", "related": "related_to",
}
LINK_WORDS = {word: link for link, words in LINK_NAMES.items() for word in words.split()}


def entities_of(hits: DataFrame, mentions: DataFrame, parents: DataFrame) -> DataFrame:
    """(frame_id, entities): the entities (frame_id, name) of each hit, or, where it has none, of its parent (frame_id,
    parent_id); an empty list where neither has any."""
    of = mentions.groupBy("frame_id").agg(F.array_sort(F.collect_set("name")).alias("_names"))
    own = hits.select("frame_id").distinct().join(parents.select("frame_id", "parent_id"), "frame_id", "left").join(of.withColumnRenamed("_names", "_own"), "frame_id", "left")
    both = own.join(of.select(F.col("frame_id").alias("parent_id"), F.col("_names").alias("_up")), "parent_id", "left")
    return both.select("frame_id", F.coalesce("_own", "_up", F.array().cast("array<string>")).alias("entities"))


def follow(edges: DataFrame, start: DataFrame, hops: int, link: str | None = None, both: bool = True, all_paths: bool = False) -> DataFrame:
    """(node, hops, confidence) of the nodes within ``hops`` links of the start nodes (node), themselves included.

    Only edges of ``link`` count, if given (a word of LINK_WORDS means its link). Each node comes once, with its least
    number of hops and, over the paths of that length, the best product of confidences (edges without a confidence
    column or with a null one count as 1); with ``all_paths`` it comes once for each number of hops at which it can be
    reached. Ordering by confidence is left to the caller. Null ends join nothing; an empty start gives no rows.

    One join for each hop; each frontier is folded and cut, so neither plans nor paths multiply.
    """
    c = F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)) if "confidence" in edges.columns else F.lit(1.0)
    e = edges if link is None else edges.where(F.lower("link") == LINK_WORDS.get(link.lower(), link.lower()))
    e = e.where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"), c.alias("c"))
    if both:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    e = e.groupBy("a", "b").agg(F.max("c").alias("c"))
    seen = frontier = start.select("node").distinct().select("node", F.lit(0).alias("hops"), F.lit(1.0).alias("confidence"))
    for i in range(1, hops + 1):
        step = e.join(maybe_broadcast(frontier.select(F.col("node").alias("a"), "confidence")), "a")
        step = step.groupBy(F.col("b").alias("node")).agg(F.max(F.col("c") * F.col("confidence")).alias("confidence")).select("node", F.lit(i).alias("hops"), "confidence")
        frontier = step if all_paths else step.join(seen.select("node"), "node", "left_anti")
        frontier = cut(frontier) if i < hops else frontier  # the last one is read once
        seen = seen.unionByName(frontier)
    return seen
