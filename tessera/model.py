"""The data model: frames (immutable content units) as DataFrames over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import table


def epoch(name: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Documents as frames: frame_id, ts (unix seconds), uri, title, track, labels, capsule, lang, search_text."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("frame_id"),
        epoch("ts").alias("ts"),
        "uri",
        "title",
        F.lower("source").alias("track"),
        "labels",
        "capsule",
        F.lower("lang").alias("lang"),
        F.col("text").alias("search_text"),
    )


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change log: one chain of versions per user, the last event type a tombstone of the chain."""
    return table(spark, d, "events").select("event_id", epoch("ts").alias("ts"), "user_id", "event_type", "value")
