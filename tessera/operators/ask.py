"""Question answering: reading a question, a ladder of queries, retrieval, fusion, an extractive answer with citations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS
from tessera.operators import lexical, ranking

# Words that mark kinds of questions.
MARKS = {
    "update": ("current", "currently", "now", "latest", "most recent", "updated", "changed", "still"),
    "aggregation": ("how many", "how much", "total", "sum", "count", "average", "all the", "list all", "every"),
    "recency": ("latest", "recent", "recently", "newest", "last time", "today", "yesterday", "this week"),
    "analytical": ("why", "how does", "explain", "compare", "difference", "trend", "analyze", "impact"),
}


def sanitise(question: str) -> str:
    """ASCII words and : / _ - . @ of the question, without stop words unless nothing else is left."""
    words = re.sub(r"[^A-Za-z0-9:/_.@-]+", " ", question).split()
    kept = [w for w in words if ":" in w or w.lower().strip(".") not in STOP_WORDS]
    return " ".join(w.strip(".") or w for w in (kept or words))


def kinds(question: str) -> set[str]:
    """The kinds of a question, by whole words."""
    low = " " + " ".join(re.findall(r"[a-z0-9]+", question.lower())) + " "
    return {k for k, marks in MARKS.items() if any(f" {m} " in low for m in marks)}


def variants(word: str) -> list[str]:
    """A word with its likely singular or plural."""
    if word.endswith("ies") and len(word) > 4:
        return [word, word[:-3] + "y"]
    if word.endswith("s") and not word.endswith("ss") and len(word) > 3:
        return [word, word[:-1]]
    return [word, word + "s"] if word.isalpha() and len(word) > 2 else [word]


def ladder(question: str) -> list[str]:
    """Queries from strict to loose: all words, all words with number variants, any word, the longest word."""
    words = list(dict.fromkeys(w.lower() for w in sanitise(question).split() if ":" not in w))
    fields = [w for w in sanitise(question).split() if ":" in w]
    if not words and not fields:
        return []
    strict = " AND ".join(words + fields)
    varied = " AND ".join(["(" + " OR ".join(variants(w)) + ")" for w in words] + fields)
    loose = " OR ".join(sorted({v for w in words for v in variants(w)})) or strict
    longest = max(words, key=lambda w: (len(w), w)) if words else strict
    return list(dict.fromkeys([strict, varied, loose, longest]))


def retrieve(frames: DataFrame, question: str, k: int = 24) -> DataFrame:
    """The k best frames over the rungs of the ladder, fused by reciprocal rank, with ``rank``; newest first if asked for."""
    lists = [lexical.top(lexical.recency(lexical.search(frames, q)), k).select("frame_id", "rank") for q in ladder(question)]
    if not lists:
        out = frames.orderBy(F.desc("ts"), F.desc("frame_id")).limit(k)
        return ranking.ranked(out, [F.desc("ts"), F.desc("frame_id")])
    fused = reduce(DataFrame.unionByName, lists).groupBy("frame_id").agg(F.expr("sum(1D / (60D + rank))").alias("fused"), F.min("rank").alias("best_rank"))
    best = fused.orderBy(F.round("fused", 12).desc(), "best_rank", "frame_id").limit(k)
    joined = frames.join(F.broadcast(best), "frame_id")  # k rows
    order = [F.desc("ts"), F.desc("frame_id")] if "recency" in kinds(question) else [F.round("fused", 12).desc(), F.asc("best_rank"), F.asc("frame_id")]
    return ranking.ranked(joined, order)


def answer(frames: DataFrame, question: str, k: int = 24) -> DataFrame:
    """One row: question, answer (three best passages with [n] marks), citations, context."""
    hits = retrieve(frames, question, k)
    placed = hits.withColumn("place", F.col("rank"))
    return ranking.citations(hits).crossJoin(ranking.context(placed)).select(F.lit(question).alias("question"), "answer", "n_citations", "context", "n_hits")  # one row each


def triple(question: str) -> tuple[str | None, str | None, str | None] | None:
    """(entity, slot, value) asked for by simple questions about facts; None where the question is no such one."""
    slots = {"work": "employer", "works": "employer", "employer": "employer", "live": "location", "lives": "location", "email": "email", "job": "job_title", "title": "job_title", "wife": "spouse", "husband": "spouse", "spouse": "spouse", "hobby": "hobby", "age": "age", "birthday": "birthday", "pet": "pet", "manager": "manager"}
    q = question.strip().rstrip("?").strip()
    m = re.match(r"(?i)(?:what|who)(?: is|'s) (\w+)'s (\w+)$", q)
    if m and m[2].lower() in slots:
        return m[1].lower(), slots[m[2].lower()], None
    m = re.match(r"(?i)where does (\w+) (work|live)s?$", q)
    if m:
        return m[1].lower(), slots[m[2].lower()], None
    m = re.match(r"(?i)who (works?|lives?) (?:at|for|in) (.+)$", q)
    if m:
        return None, slots[m[1].lower()], m[2].lower()
    return None
