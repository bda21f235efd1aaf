"""Lexical search: BM25 over query terms, recency order, fallback scoring, snippets and pages."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.stemmer import stem
from tessera.functions.text import keywords, occurrences, sections, snippets, tokens
from tessera.plans import compiler, parser

K1, B = 1.2, 0.75
DECAY, PLAIN, FRESH = 0.00000802, 0.4, 0.6


def bm25(frames: DataFrame, words: list[str]) -> DataFrame:
    """``frames`` that hold any of the words, with ``score``.

    One scan computes each frame's length and term counts without exploding it; the corpus statistics are one
    aggregated row, so nothing is shuffled by term and no postings table is needed for an ad-hoc query.
    """
    count = lambda w: F.size(F.filter("_tokens", lambda t: t == w))
    hits = [count(w).alias(f"_tf{i}") for i, w in enumerate(words)]
    counted = frames.withColumn("_tokens", tokens(F.col("search_text"))).select("*", F.size("_tokens").alias("_len"), *hits).drop("_tokens")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    joined = counted.where(reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(stats))  # one row

    def part(i: int):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))

    return joined.withColumn("score", reduce(lambda a, b: a + b, map(part, range(len(words))))).select(*frames.columns, "score")


def search(frames: DataFrame, query: str, match: str = "token") -> DataFrame:
    """Frames that satisfy the query with their BM25 ``score``; 0 for queries without scoring words.

    Statistics are those of all frames given, so filters that only narrow the result belong into the query.
    """
    tree = parser.parse(query)
    words = parser.terms(tree)
    scored = bm25(frames, words) if words and match == "token" else frames.withColumn("score", F.lit(0.0))
    if words and match == "token" and _needs_all(tree):
        scored = scored.where(compiler.predicate(tree, match))
    elif words and match == "token":
        rest = bm25(frames, words).select("frame_id", "score")
        scored = frames.where(compiler.predicate(tree, match)).join(rest, "frame_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        scored = scored.where(compiler.predicate(tree, match))
    return scored


def _needs_all(node: parser.Node) -> bool:
    """Whether every match must hold a scoring word, so that frames without one need not be looked at."""
    if node.kind in ("word", "phrase"):
        return True
    if node.kind == "and":
        return any(map(_needs_all, node.parts))
    return node.kind == "or" and all(map(_needs_all, node.parts))


def recency(scored: DataFrame) -> DataFrame:
    """Adds ``boosted``: part of the score fades with the age against the newest frame of the result."""
    newest = scored.agg(F.max("ts").alias("_newest"))
    fade = F.exp(-DECAY * (F.col("_newest") - F.col("ts")))
    boosted = F.col("score") * PLAIN + F.col("score") * F.coalesce(fade, F.lit(0.0)) * FRESH
    return scored.crossJoin(F.broadcast(newest)).withColumn("boosted", boosted).drop("_newest")  # one row


def top(scored: DataFrame, k: int, by: str = "boosted") -> DataFrame:
    """The k best with their ``rank``; ties go to the smaller frame_id."""
    best = scored.orderBy(F.round(by, 9).desc(), "frame_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round(by, 9).desc(), "frame_id")).cast("bigint"))  # k rows


def pages(hits: DataFrame, words: list[str], window: int = 160) -> DataFrame:
    """One row for each snippet of each hit, numbered over all hits: the unit that pages are cut from."""
    cut = hits.withColumn("_spans", snippets(words, window)("search_text")).select("*", F.posexplode("_spans").alias("snippet_no", "_s"))
    text = F.expr("substring(search_text, _s.start + 1, _s.stop - _s.start)")
    numbered = F.row_number().over(Window.orderBy("rank", "snippet_no")) - 1
    return cut.select("rank", "frame_id", "snippet_no", F.col("_s.start").alias("char_start"), F.col("_s.stop").alias("char_end"), text.alias("snippet"), numbered.cast("bigint").alias("cursor"))


def fallback_score(frames: DataFrame, words: list[str], section: bool = True) -> DataFrame:
    """Occurrences of all words, 1,000 more if they follow each other as a phrase; every word must be there.

    With ``section`` each section of a frame is scored by itself and its best one counts, so all words must be in one
    section; without it the frame is scored as a whole.
    """
    if section:
        parts = frames.select("frame_id", "search_text").withColumn("_s", F.explode(sections("search_text"))).select("frame_id", F.expr("substring(search_text, _s.start + 1, _s.stop - _s.start)").alias("search_text"))
        best = fallback_score(parts, words, False).groupBy("frame_id").agg(F.max("score").alias("score"))
        return frames.join(best, "frame_id")
    total = reduce(lambda a, b: a + b, [occurrences(F.col("search_text"), w) for w in words])
    every = reduce(lambda a, b: a & b, [F.lower("search_text").contains(w) for w in words])
    phrase = F.when(F.lower("search_text").contains(" ".join(words)), 1000).otherwise(0)
    return frames.where(every).withColumn("score", total + (phrase if len(words) > 1 else F.lit(0)))


def postings(frames: DataFrame) -> DataFrame:
    """(term, frame_id, tf, positions): the inverted index as a table, for workloads of many queries."""
    each = frames.select("frame_id", F.posexplode(tokens(F.col("search_text"))).alias("pos", "term"))
    return each.groupBy("term", "frame_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def build_index(frames: DataFrame, path: str, buckets: int = 256, stemmed: bool = False) -> None:
    """Writes the inverted index to a folder: postings (term, frame_id, tf, positions, length) by bucket of the term, terms
    with their document frequencies by bucket, and one row of statistics.

    A query reads the buckets of its terms only. With ``stemmed``, terms are stems.
    """
    each = frames.select("frame_id", F.posexplode(tokens(F.col("search_text"))).alias("pos", "term"))
    if stemmed:
        each = each.withColumn("term", stems("term"))
    rows = each.groupBy("term", "frame_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    rows = rows.join(frames.select("frame_id", F.size(tokens(F.col("search_text"))).alias("length")), "frame_id").withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int"))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = frames.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    size = F.size(tokens(F.col("search_text")))
    frames.agg(F.count("*").alias("n"), F.avg(size).alias("average")).withColumn("buckets", F.lit(buckets)).withColumn("stemmed", F.lit(stemmed)).write.mode("overwrite").parquet(f"{path}/statistics")


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda w: known[w] if w in known else known.setdefault(w, stem(w)))


def followed_by(starts: Column, later: Column, gap: int) -> Column:
    """The positions after which, at the given distance, there is one of the later positions."""
    return F.filter(starts, lambda p: F.array_contains(later, p + gap))


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(frame_id, score) of the frames that satisfy a query of words, phrases, AND, OR and NOT, by BM25, from an index.

    Phrases are consecutive positions. Only the buckets of the query's terms are read, and no text.
    """
    size = spark.read.parquet(f"{path}/statistics").first()  # one row
    tree = parser.parse(query)
    words = parser.all_terms(tree)
    as_term = {w: stem(w) if size["stemmed"] else w for w in words}
    wanted = sorted(set(as_term.values()))
    buckets = sorted({zlib.crc32(t.encode()) % size["buckets"] for t in wanted})
    read = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    df = {r["term"]: r["df"] for r in spark.read.parquet(f"{path}/terms").where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted)).collect()}  # a row for each term of the query
    hits = read.groupBy("frame_id").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # at most the terms of the query
    at = lambda w: F.try_element_at("at", F.lit(as_term[w]))

    def test(node: parser.Node):
        if node.kind == "and":
            return reduce(lambda a, b: a & b, map(test, node.parts))
        if node.kind == "or":
            return reduce(lambda a, b: a | b, map(test, node.parts))
        if node.kind == "not":
            return ~test(node.parts[0])
        if node.kind == "word":
            return at(node.value).isNotNull()
        if node.kind == "phrase":
            ws = parser.terms(node)
            starts = F.coalesce(at(ws[0]), F.array().cast("array<int>"))
            for i, w in enumerate(ws[1:], 1):
                starts = followed_by(starts, F.coalesce(at(w), F.array().cast("array<int>")), i)
            return F.size(starts) > 0
        raise parser.QueryError(f"an index search has no {node.kind}")

    def part(w: str):
        n, tf = df.get(as_term[w], 0), F.coalesce(F.size(at(w)), F.lit(0))
        return math.log(1 + (size["n"] - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(size["average"])))

    matches, scoring = test(tree), parser.terms(tree)
    if not scoring:
        raise parser.QueryError("an index search needs a word that its hits must or may have")
    score = reduce(lambda a, b: a + b, [F.when(at(w).isNotNull(), part(w)).otherwise(0.0) for w in scoring])
    return hits.where(matches).select("frame_id", score.alias("score"))


def document_frequencies(frames: DataFrame) -> DataFrame:
    """(term, df, cf) over all frames: distinct tokens per frame are counted before the shuffle."""
    each = frames.select(F.explode(tokens(F.col("search_text"))).alias("term"), "frame_id")
    return each.groupBy("frame_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top_keywords(frames: DataFrame, k: int = 12) -> DataFrame:
    """(frame_id, word, n): the k most frequent keywords of each frame; ties go to the smaller word."""
    words = frames.select("frame_id", F.explode(keywords(F.col("search_text"))).alias("word"))
    counted = words.groupBy("frame_id", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("frame_id").orderBy(F.desc("n"), "word")  # the words of one text
    return counted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def token_order(hits: DataFrame, words: list[str]) -> DataFrame:
    """Hits reordered by distinct words present, all occurrences, and their old rank."""
    present = reduce(lambda a, b: a + b, [F.lower("search_text").contains(w).cast("int") for w in words])
    total = reduce(lambda a, b: a + b, [occurrences(F.col("search_text"), w) for w in words])
    return hits.withColumn("distinct_words", present).withColumn("all_words", total).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("distinct_words"), F.desc("all_words"), "rank")).cast("bigint"))
