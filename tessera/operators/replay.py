"""Replay of recorded sessions: clean action logs, comparison, match rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import latest


def clean(actions: DataFrame) -> DataFrame:
    """Each action once, as last delivered."""
    return latest(actions, ["action_id"], ["ingested_at"])


def compare(actions: DataFrame, left: int, right: int) -> DataFrame:
    """(action_seq, left_type, right_type, verdict): two sessions side by side by sequence number."""
    a = actions.where(F.col("session_id") == left).groupBy("action_seq").agg(F.min("action_type").alias("left_type"), F.min("output_hash").alias("lo"))
    b = actions.where(F.col("session_id") == right).groupBy("action_seq").agg(F.min("action_type").alias("right_type"), F.min("output_hash").alias("ro"))
    verdict = F.when(F.col("left_type").isNull(), "right only").when(F.col("right_type").isNull(), "left only").when((F.col("left_type") == F.col("right_type")) & (F.col("lo") == F.col("ro")), "same").otherwise("different")
    return a.join(b, "action_seq", "full_outer").select("action_seq", "left_type", "right_type", verdict.alias("verdict"))


def match_rates(actions: DataFrame) -> DataFrame:
    """(action_type, actions, matched, mismatched, skipped): an action matches if its input gave the same output first.

    Inputs are grouped by their hash with partial aggregation; all-zero and null hashes are skipped.
    """
    zero = F.unhex(F.lit("00" * 32))
    usable = actions.where(F.col("input_hash").isNotNull() & F.col("output_hash").isNotNull() & (F.col("input_hash") != zero) & (F.col("output_hash") != zero))
    first = usable.groupBy("action_type", "input_hash").agg(F.min_by("output_hash", "action_id").alias("expected"))
    joined = usable.join(first, ["action_type", "input_hash"]).groupBy("action_type").agg(F.count_if(F.col("output_hash") == F.col("expected")).alias("matched"), F.count_if(F.col("output_hash") != F.col("expected")).alias("mismatched"))
    every = actions.groupBy("action_type").agg(F.count("*").alias("actions"))
    out = every.join(joined, "action_type", "left")
    zero_if = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("action_type", "actions", zero_if("matched"), zero_if("mismatched"), (F.col("actions") - F.coalesce("matched", F.lit(0)) - F.coalesce("mismatched", F.lit(0))).alias("skipped"))


def sessions(actions: DataFrame) -> DataFrame:
    """(session_id, actions, first_seq, last_seq, busy_ms) of every session."""
    return actions.groupBy("session_id").agg(F.count("*").alias("actions"), F.min("action_seq").alias("first_seq"), F.max("action_seq").alias("last_seq"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("busy_ms"))
