"""Search requests as one plan: candidates, access, time, the query, recency order, a page and its total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import access, ask, facts, lexical, ranking, store, temporal, vectors
from tessera.plans import compiler, parser


@dataclass(frozen=True)
class Request:
    """What is asked for; None is no restriction. ``cursor`` is how many hits of the ranking to leave out."""

    query: str
    top_k: int = 10
    cursor: int = 0
    uri: str | None = None
    scope: str | None = None
    as_of_frame: int | None = None
    as_of_ts: int | None = None
    active: str | None = None
    start: int | None = None
    stop: int | None = None
    tenant: str | None = None
    roles: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    principal: str = ""


def run(frames: DataFrame, request: Request, candidates: tuple[DataFrame | None, ...] = (), spoken: DataFrame | None = None) -> DataFrame:
    """The page of a request: the frames' columns with ``score``, ``boosted``, ``rank`` and ``total_hits``.

    Every restriction comes before the ranking, so a page is never short: access, candidates (each a set of frame_id that
    must hold a hit), time travel, uri (which overrides scope), dates that the query requires, and a time span, which
    looks at the mentions ``spoken`` first where they are given. Scores are those of all frames. A query that every
    frame satisfies has score 0. A negative cursor is an error; one beyond the hits gives an empty page.
    """
    if request.cursor < 0 or request.top_k < 1:
        raise ValueError("a page needs a cursor of 0 or more and at least one hit")
    hits = lexical.search(frames, request.query)
    if request.tenant is not None:
        hits = access.enforce(hits, request.tenant, list(request.roles), list(request.groups), request.principal)
    hits = store.intersected(hits, *candidates).where(compiler.time_travel(request.as_of_frame, request.as_of_ts))
    if request.active is not None:
        hits = hits.where(F.expr(request.active))
    if request.uri is not None:
        hits = hits.where(compiler.uri_filter(request.uri))
    elif request.scope is not None:
        hits = hits.where(F.col("uri").startswith(request.scope))
    required = parser.required_dates(parser.parse(request.query))
    if required:
        hits = hits.where(F.col("ts").between(*[x if x is not None else d for x, d in zip(required, (-(1 << 62), 1 << 62))]))
    if request.start is not None and request.stop is not None:
        hits = temporal.within(hits, spoken, request.start, request.stop) if spoken is not None else hits.where(F.col("ts").between(request.start, request.stop))
    total = hits.agg(F.count("*").alias("total_hits"))
    page = lexical.top(lexical.recency(hits), request.cursor + request.top_k).where(F.col("rank") > request.cursor)
    return page.crossJoin(F.broadcast(total))  # one row


def find(frames: DataFrame, words: list[str], k: int = 10, snippets: int = 3) -> DataFrame:
    """The k best frames by their best section, with up to three snippets each (frame_id, search_text, score, snippet)."""
    best = lexical.fallback_score(frames, words).orderBy(F.desc("score"), "frame_id").limit(k)
    spans = F.slice(lexical.snippets(words)("search_text"), 1, snippets)
    cut = best.withColumn("_s", F.explode_outer(spans))
    return cut.withColumn("snippet", F.expr("substring(search_text, _s.start + 1, _s.stop - _s.start)")).drop("_s")


def hybrid(frames: DataFrame, current: DataFrame, query: str, question: str, mode: str = "hybrid", k: int = 20) -> DataFrame:
    """(frame_id, fused, best_rank): frames by words ('text'), by the facts a question asks for ('graph'), or both.

    ``current`` are current facts with the frame they come from. A question that the planner does not understand has no
    graph part.
    """
    if mode not in ("text", "graph", "hybrid"):
        raise ValueError(f"no mode {mode!r}")
    lists = []
    if mode != "graph":
        lists.append(lexical.top(lexical.search(frames, query), k, "score").select("frame_id", "rank"))
    if mode != "text":
        planned = ask.triple(question)
        matched = facts.match_triple(current, *planned) if planned else current.limit(0)
        lists.append(ranking.ranked(matched.select("frame_id").distinct().orderBy("frame_id").limit(k), [F.asc("frame_id")]))
    return ranking.reciprocal_ranks(lists)


def semantic_rerank(hits: DataFrame, query: list[float], mode: str = "semantic") -> DataFrame:
    """A result page (frame_id, rank, embedding) ranked anew: by cosine, by cosine and both reciprocal ranks ('hybrid'), or
    as it is ('lexical'). Frames without a vector count as cosine 0."""
    c = F.coalesce(vectors.cosine(F.col("embedding"), vectors.literal(query)), F.lit(0.0))
    page = ranking.ranked(hits.withColumn("cosine", c).withColumnRenamed("rank", "old_rank"), [F.round("cosine", 9).desc(), F.asc("frame_id")]).withColumnRenamed("rank", "sem_rank")
    if mode == "semantic":
        order = [F.asc("sem_rank")]
    elif mode == "hybrid":
        order = [F.round(F.col("cosine") + 1 / (ranking.RRF_K + F.col("old_rank")) + 1 / (ranking.RRF_K + F.col("sem_rank")), 9).desc(), F.asc("old_rank")]
    elif mode == "lexical":
        order = [F.asc("old_rank")]
    else:
        raise ValueError(f"no mode {mode!r}")
    return ranking.ranked(page, order)
