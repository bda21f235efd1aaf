"""How distinctive a term is per record: hypergeometric enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut, maybe_broadcast

#: Rows of one term that one task takes; a term with more is spread.
HOT = 65536
#: Coefficients of the Lanczos approximation of log gamma (g = 7, n = 9). Fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for x >= 1, whole arrays at a time."""
    y = np.asarray(x, dtype=np.float64) - 1.0
    total = np.full_like(y, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total += c / (y + i)
    t = y + 7.5
    return 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(total)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    ok = (k >= 0) & (k <= n)
    kk = np.where(ok, k, 0)
    return np.where(ok, log_gamma(n + 1.0) - log_gamma(kk + 1.0) - log_gamma(n - kk + 1.0), -np.inf)


def upper_tail(population: np.ndarray, holders: np.ndarray, draws: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Natural log of P(X >= count) for X hypergeometric(population, holders, draws), summed exactly in log space."""
    population, holders, draws, count = (np.asarray(a, dtype=np.float64) for a in (population, holders, draws, count))
    most = np.minimum(holders, draws)
    total = np.full(len(population), -np.inf)
    base = log_choose(population, draws)
    for step in range(int(np.max(np.maximum(most - count, 0), initial=0)) + 1):
        x = count + step
        term = np.where(x <= most, log_choose(holders, np.minimum(x, most)) + log_choose(population - holders, draws - x) - base, -np.inf)
        total = np.logaddexp(total, term)
    return np.where(count <= 0, 0.0, np.minimum(total, 0.0))


def record_terms(records: DataFrame, record: str, terms: str, order: str | None = None) -> DataFrame:
    """(record_id, term, in_record, slots): counts of the terms of each record; 0 and null are no terms.

    The latest row of a record counts (by ``order``), repeated rows once; records without terms give no rows.
    """
    at = F.col(order) if order else F.lit(0)
    one = records.select(F.col(record).alias("record_id"), F.expr(f"filter({terms}, t -> t is not null and t <> 0)").alias("_terms"), at.alias("_at")).where("record_id is not null")
    one = one.groupBy("record_id").agg(F.max_by("_terms", "_at").alias("_terms")).where("size(_terms) > 0")
    out = one.select("record_id", F.size("_terms").alias("slots"), "_terms", F.explode(F.array_distinct("_terms")).alias("term"))
    return out.select("record_id", "term", F.expr("size(filter(_terms, t -> t = term))").alias("in_record"), "slots")


def hot_terms(counts: DataFrame, held: DataFrame) -> DataFrame:
    """(term, hot_holders) of the terms that hold at least a 4096th of all slots and more than HOT of them: at most 4096."""
    size = counts.agg((F.sum("in_record") / 4096).alias("_least"))
    return held.crossJoin(F.broadcast(size)).where(F.col("holders") >= F.greatest("_least", F.lit(HOT))).select("term", F.col("holders").alias("hot_holders"))  # one row


def enrichment(records: DataFrame, record: str = "frame_id", terms: str = "top_terms", order: str | None = "updated_at") -> DataFrame:
    """(record_id, term, in_record, holders, log_p, score): how characteristic each term is of its record.

    log_p is the log of the exact chance of at least ``in_record`` copies of the term among the record's slots if the
    slots were drawn from all slots of the collection; score is the negative log10 of that chance after the
    Benjamini-Hochberg correction over all (record, term) tests. Nulls and 0 in the list are empty slots; a null list,
    a list of empty slots or an empty table gives no rows; ties have equal scores; other columns are ignored.

    The chance depends only on (slots, in_record, holders): it is computed on those distinct cases, and the correction
    runs over them with their multiplicities, never over all rows. Holders of different terms add up to the number of
    slots n, so there are at most sqrt(2 n) different ones, times the few pairs of slots and in_record. Terms held by a
    large part of all records meet their count by a broadcast of at most 4096 rows, the others by a shuffle.
    """
    counts = record_terms(records, record, terms, order)
    held = counts.groupBy("term").agg(F.sum("in_record").alias("holders"))
    size = counts.agg(F.sum("in_record").cast("bigint").alias("population"))
    flagged = counts.join(F.broadcast(hot_terms(counts, held)), "term", "left")  # at most 4096 rows
    cold = flagged.where("hot_holders is null").drop("hot_holders").join(held, "term")
    joined = flagged.where("hot_holders is not null").withColumnRenamed("hot_holders", "holders").unionByName(cold)
    cases = joined.groupBy("slots", "in_record", "holders").agg(F.count("*").alias("tests"))
    # one row; it bounds itself
    cases = cases.crossJoin(F.broadcast(size)).withColumn("draws", F.col("slots").cast("bigint")).withColumn("in_record", F.col("in_record").cast("bigint"))

    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["log_p"] = upper_tail(b.population, b.holders, b.draws, b.in_record)
            yield b[["draws", "in_record", "holders", "tests", "log_p"]]

    scored = cases.select("population", "holders", "draws", "in_record", "tests").mapInPandas(correct, "draws bigint, in_record bigint, holders bigint, tests bigint, log_p double")
    up = Window.orderBy("log_p", "draws", "in_record", "holders").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("log_p"), "draws", "in_record", "holders").rowsBetween(Window.unboundedPreceding, 0)
    ranked = scored.withColumn("_upto", F.sum("tests").over(up)).withColumn("_all", F.sum("tests").over(Window.partitionBy()))
    ranked = ranked.withColumn("_upto", F.max("_upto").over(Window.partitionBy("log_p")))
    ranked = ranked.withColumn("_q", F.least(F.lit(0.0), F.min(F.col("log_p") + F.log(F.col("_all") / F.col("_upto"))).over(down)))
    final = ranked.select(F.col("draws").cast("int").alias("slots"), F.col("in_record").cast("int").alias("in_record"), "holders", "log_p", (-F.col("_q") / F.log(F.lit(10.0))).alias("score"))
    return joined.join(maybe_broadcast(final), ["slots", "in_record", "holders"]).select("record_id", "term", "in_record", "holders", "log_p", "score")


def single_out(queries: DataFrame, entries: DataFrame, query: str = "query_id", record: str = "frame_id", terms: str = "top_terms", order: str | None = "updated_at") -> DataFrame:
    """(query, record, worth): for each query the one record in which its terms are most enriched, taken together.

    worth is the sum of the ``enrichment`` scores (corrected upper tails with the record's own slots and counts) of the
    record's terms that the query has; ties go to the smaller id. A query's empty slots (null, 0) and repeated terms
    count for nothing, repeated rows of a query once; a query that shares no term with any record gives no row, and an
    empty table on either side none; other columns are ignored.

    Exact for every query. Terms of a query are taken from the rarest on: after the rarest two, a query goes on to a
    more common term only while the most that the terms still to come can add could reach what it has found. Records
    with equal terms and scores are one row. The rows of a common term are spread over salts of HOT rows each, to which
    the queries that have it are copied.
    """
    scored = cut(enrichment(entries, record, terms, order))
    e = scored.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("term", "score"))).alias("ts"))  # a record's few slots
    distinct = e.groupBy("ts").agg(F.min("record_id").alias("record_id"))
    worth = scored.groupBy("term").agg(F.max("holders").alias("holders"), F.max("score").alias("most"))
    q = queries.select(F.col(query).alias("query_id"), F.expr(f"array_distinct(filter({terms}, t -> t is not null and t <> 0))").alias("terms")).where("query_id is not null").groupBy("query_id").agg(F.max("terms").alias("terms"))
    qt = q.select("query_id", F.explode("terms").alias("term")).join(worth, "term")
    ranked = qt.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("holders", "most", "term"))).alias("qs")).withColumn("own", F.expr("transform(qs, t -> t.term)"))
    hot = hot_terms(scored, worth).select("term", F.ceil(F.col("hot_holders") / HOT).cast("int").alias("g"))
    salted = lambda df, salt: df.join(F.broadcast(hot), "term", "left").withColumn("salt", salt)  # noqa: E731 (at most 4096 rows)
    by_term = salted(distinct.select("record_id", "ts", F.explode("ts").alias("t")).withColumn("term", F.col("t.term")).drop("t"), F.coalesce(F.expr("cast(pmod(xxhash64(record_id), g) as int)"), F.lit(0))).select("term", "salt", "record_id", "ts")
    shared = "round(aggregate(filter(ts, t -> array_contains(own, t.term)), 0D, (a, t) -> a + t.score), 9)"

    def best(wanted: DataFrame) -> DataFrame:
        spread = salted(wanted, F.expr("explode(if(g is null, array(0), sequence(0, g - 1)))")).drop("g")
        return spread.join(by_term, ["term", "salt"]).groupBy("query_id").agg(F.max(F.struct(F.expr(shared).alias("worth"), (-F.col("record_id")).alias("neg"))).alias("best"))

    first = ranked.select("query_id", "own", F.explode(F.slice("qs", 1, 2)).alias("t")).withColumn("term", F.col("t.term")).drop("t")
    found = cut(best(first))
    rest = ranked.join(found, "query_id", "left").where("size(qs) > 2").select("query_id", "own", "qs", F.coalesce(F.col("best.worth"), F.lit(0.0)).alias("have"))
    rest = rest.select("query_id", "own", "have", F.posexplode(F.expr("transform(qs, (t, i) -> struct(t.term as term, aggregate(slice(qs, i + 1, size(qs)), 0D, (a, x) -> a + x.most) as ahead))")).alias("pos", "t"))
    rest = rest.where("pos >= 2 and t.ahead >= have - 1e-6").select("query_id", "own", F.col("t.term").alias("term"))
    both = found.unionByName(best(rest)).groupBy("query_id").agg(F.max("best").alias("best"))
    return both.select(F.col("query_id").alias(query), (-F.col("best.neg")).alias(record), F.col("best.worth").alias("worth"))
