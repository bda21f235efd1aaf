"""Sketches of texts: SimHash, small Bloom filters, candidates by overlap and distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sketch_tokens

HAMMING, SHORT = 10, 50


def term_weights(frames: DataFrame, text: str = "search_text") -> DataFrame:
    """(frame_id, term, weight): 100 for each occurrence of a term, three at most."""
    each = frames.select("frame_id", F.explode(sketch_tokens(F.col(text))).alias("term"))
    return each.groupBy("frame_id", "term").agg((F.least(F.count("*"), F.lit(3)) * 100).cast("bigint").alias("weight"))


def token_hash(term: Column) -> Column:
    """64 bits out of SHA-256, the same in any engine: its first 15 hex digits as a number, shifted by 4."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 15), 16, 10).cast("bigint")


def simhash(weights: DataFrame, bits: int = 60) -> DataFrame:
    """(frame_id, simhash): bit b is set where the weights of terms with it outweigh the others."""
    h = weights.withColumn("h", token_hash(F.col("term")))
    sums = h.groupBy("frame_id").agg(*[F.sum(F.when(F.expr(f"(h >> {b}) & 1 = 1"), F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(bits)])
    total = " + ".join(f"if(b{b} > 0, {1 << b}L, 0L)" for b in range(bits))
    return sums.select("frame_id", F.expr(total).alias("simhash"))


def spots(term: Column, bits: int = 256) -> Column:
    """The three bit positions of a term."""
    h = token_hash(term)
    return F.array(*[F.pmod(F.shiftright(h, s), F.lit(bits)).cast("int") for s in (0, 16, 32)])


def bloom(weights: DataFrame, bits: int = 256) -> DataFrame:
    """(frame_id, filter): a filter of ``bits`` bits, three a term, as an array of 64-bit words."""
    each = weights.select("frame_id", F.explode(spots(F.col("term"), bits)).alias("p"))
    words = [F.bit_or(F.expr(f"if(p div 64 = {w}, shiftleft(1L, p % 64), 0L)")).alias(f"w{w}") for w in range(bits // 64)]
    return each.groupBy("frame_id").agg(*words).select("frame_id", F.array(*[f"w{w}" for w in range(bits // 64)]).alias("filter"))


def may_contain(filter_: Column, term: Column, bits: int = 256) -> Column:
    """Whether a filter may hold a term: all its positions are set. No false negatives."""
    return F.forall(spots(term, bits), lambda p: F.call_function("shiftrightunsigned", F.element_at(filter_, (p / 64).cast("int") + 1), p % 64).bitwiseAND(1) == 1)


def share_bits(a: Column, b: Column) -> Column:
    """Whether two filters of equal size have a set bit in common."""
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def filter_overlap(a: Column, b: Column) -> Column:
    """Bits in both over bits in either of two filters of equal size, as arrays of 64-bit words."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
    return both / any_


def candidates(queries: DataFrame, entries: DataFrame, threshold: int = 32) -> DataFrame:
    """(query_id, frame_id, hamming, shared, score) of the entries that share a top term and are near by SimHash.

    Joined on shared terms, common terms spread by the records they are in; score = .5 shared / slots + .4 (1 - h / 64)
    + .1 / (1 + .1 length difference).
    """
    q = queries.select("query_id", F.col("simhash").alias("qh"), F.expr("array_distinct(filter(top_terms, t -> t <> 0))").alias("qt"), F.col("token_count").alias("ql"))
    e = entries.select("frame_id", "simhash", F.expr("array_distinct(filter(top_terms, t -> t <> 0))").alias("terms"), "length_hint").where("simhash is not null")
    pairs = q.select("*", F.explode("qt").alias("t")).join(e.select("*", F.explode("terms").alias("t")), "t").where(hamming(F.col("qh"), F.col("simhash")) <= threshold)
    # a pair that shares several terms is kept under the least of them
    first = pairs.where(F.col("t") == F.array_min(F.array_intersect("qt", "terms")))
    h = hamming(F.col("qh"), F.col("simhash"))
    shared = F.size(F.array_intersect("qt", "terms"))
    score = 0.5 * shared / F.greatest(F.size("qt"), F.lit(1)) + 0.4 * (1 - h / 64.0) + 0.1 / (1 + 0.1 * F.abs(F.col("ql") - F.coalesce("length_hint", F.lit(0))))
    return first.select("query_id", "frame_id", h.cast("int").alias("hamming"), shared.alias("shared"), score.alias("score"))
