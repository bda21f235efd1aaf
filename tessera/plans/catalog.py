"""Registered queries of the core operators and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import structure
from tessera.functions import text as T
from tessera.model import epoch, event_log, frames
from tessera.operators import access, ask, facts, lexical, mesh, ranking, replay, sketches, store, tables, temporal, vectors
from tessera.plans import compiler, parser
from tessera.runtime import latest, maybe_broadcast, table
from tessera.sources import readers, sinks
from tessera.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# Common parts of the SQL.
SECONDS = "epoch_us(ts) // 1000000"
FRAMES = f"frames as (select doc_id as frame_id, {SECONDS} as ts, uri, title, lower(source) as track, labels, capsule, lower(lang) as lang, text as search_text from documents)"
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(search_text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def bm25_sql(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(tok, lambda t: t = '{w}')) as tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(words)))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(words)))
    any_ = " or ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""{FRAMES},
tok as (select *, {TOKENS} as tok from frames),
cnt as (select * exclude (tok), len(tok) as l, {tf} from tok),
st as (select count(*) as n, avg(l) as a, {df} from cnt),
scored as (select cnt.*, {part} as score from cnt, st where {any_})"""


BOOST = "score * 0.4 + score * exp(-0.00000802 * ((select max(ts) from hits) - ts)) * 0.6"


def _search(words: str, k: int | None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = lexical.search(frames(spark, d), words)
        if k is None:
            return hits.select("frame_id", F.round("score", 6).alias("score"))
        return lexical.top(lexical.recency(hits), k).select("rank", "frame_id", F.round("score", 6).alias("score"))

    return run


def _has(word: str) -> str:
    return f"list_contains({TOKENS}, '{word}')"


for _name, _text, _words, _where in [
    ("k1_search_and", "snapshot AND ledger", ["snapshot", "ledger"], f"{_has('snapshot')} and {_has('ledger')}"),
    ("k1_search_or", "retriever OR capsule", ["retriever", "capsule"], f"{_has('retriever')} or {_has('capsule')}"),
    ("k1_search_implicit_and_not", "cache index NOT token", ["cache", "index"], f"{_has('cache')} and {_has('index')} and not {_has('token')}"),
    ("k1_search_nested", "(cache OR index) AND track:kb_article AND label:harbor", ["cache", "index"], f"({_has('cache')} or {_has('index')}) and track = 'kb_article' and list_contains(labels, 'harbor')"),
]:
    query(_name, f"with {bm25_sql(_words)}, hits as (select * from scored where {_where}), b as (select *, {BOOST} as boosted from hits) select row_number() over (order by round(boosted, 9) desc, frame_id) as rank, frame_id, round(score, 6) as score from b order by rank limit 10")(_search(_text, 10))

query("a13_bm25_scores", f"with {bm25_sql(['query', 'segment'])} select frame_id, round(score, 6) as score from scored where {_has('query')} or {_has('segment')}")(_search("query OR segment", None))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Frames under uris of their capsules."""
    return frames(spark, d).withColumn("uri", F.concat(F.lit("doc://"), "capsule", F.lit("/"), F.col("frame_id").cast("string")))


PLACED = f"{FRAMES.replace('frames as', 'given as')}, frames as (select * replace ('doc://' || capsule || '/' || frame_id as uri) from given)"


def _filtered(text: str) -> Query:
    return lambda spark, d: placed(spark, d).where(compiler.predicate(parser.parse(text), "substring")).select("frame_id", "uri")


for _name, _text, _where in [
    ("p1_word_filter", "snapshot", "contains(lower(search_text), 'snapshot')"),
    ("p2_phrase_filter", '"log said"', "contains(lower(search_text), 'log said')"),
    ("p4_uri_filter", "uri:doc://THICKET-main/20 OR uri:doc://ember-tenwin/1", "lower(uri) in ('doc://thicket-main/20', 'doc://ember-tenwin/1')"),
    ("p5_scope_filter", "scope:doc://ember", "starts_with(uri, 'doc://ember')"),
    ("p6_track_label_filter", "track:support_ticket AND tag:orchard", "track = 'support_ticket' and list_contains(list_transform(labels, lambda x: lower(x)), 'orchard')"),
    ("p7_date_filter", "date:[2025-01 TO 2025-06-15]", "ts between 1735689600 and 1750031999"),
    ("p8_boolean_filter", "(cache OR ledger) AND NOT token", "(contains(lower(search_text), 'cache') or contains(lower(search_text), 'ledger')) and not contains(lower(search_text), 'token')"),
]:
    query("filter_" + _name, f"with {PLACED} select frame_id, uri from frames where {_where}")(_filtered(_text))

query("filter_p3_wildcard", f"with {FRAMES} select frame_id, uri from frames where list_bool_or(list_transform({TOKENS}, lambda t: regexp_full_match(t, 'snap.*')))")(lambda s, d: frames(s, d).where(compiler.predicate(parser.parse("snap*"))).select("frame_id", "uri"))
query("filter_p12_time_travel", f"with {FRAMES} select frame_id, ts from frames where frame_id <= 400 and ts <= 1745000000")(lambda s, d: frames(s, d).where(compiler.time_travel(400, 1745000000)).select("frame_id", "ts"))
query("filter_p10_uri_prefix", f"with {PLACED} select frame_id, uri from frames where starts_with(lower(uri), 'doc://atlas')")(lambda s, d: placed(s, d).where(compiler.uri_filter("doc://ATLAS")).select("frame_id", "uri"))


@query("k3_snippet_pages")
def k3(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.top(lexical.recency(lexical.search(frames(spark, d), "snapshot ledger")), 20)
    return lexical.pages(hits, ["snapshot", "ledger"]).where("cursor >= 0 and cursor < 10")


@query("k13_token_order", f"""with {bm25_sql(['cache', 'index'])}, hits as (select *, row_number() over (order by round(score, 9) desc, frame_id) as r from scored where {_has('cache')} or {_has('index')} order by r limit 50),
m as (select *, contains(lower(search_text), 'cache')::int + contains(lower(search_text), 'index')::int as u, (length(lower(search_text)) - length(replace(lower(search_text), 'cache', ''))) // 5 + (length(lower(search_text)) - length(replace(lower(search_text), 'index', ''))) // 5 as t from hits)
select row_number() over (order by u desc, t desc, r) as rank, frame_id, t::bigint as all_words from m""")
def k13(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.top(lexical.search(frames(spark, d), "cache OR index"), 50, "score")
    return lexical.token_order(hits, ["cache", "index"]).select("rank", "frame_id", "all_words")


@query("a13_document_frequencies", f"with {FRAMES}, e as (select frame_id, unnest({TOKENS}) as term from frames) select term, count(distinct frame_id) as df, count(*) as cf from e group by 1")
def dfs(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(frames(spark, d))


@query("postings", f"with {FRAMES}, e as (select frame_id, unnest({TOKENS}) as term from frames) select term, frame_id, count(*) as tf from e group by 1, 2")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(frames(spark, d)).select("term", "frame_id", "tf")


@query("filter_only_search", f"with {FRAMES} select frame_id, left(search_text, 120) as snippet from frames where track = 'kb_article' order by frame_id limit 50")
def filter_only(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).where(compiler.predicate(parser.parse("track:kb_article"))).orderBy("frame_id").limit(50).select("frame_id", T.preview(F.col("search_text")).alias("snippet"))


# Vectors. The query vectors are those of the given ids.
def _query_vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])  # one row


@query("k6_knn_l2", "with q as (select embedding::double[64] as e from embeddings where vec_id = 7) select vec_id, round(array_distance(embedding::double[64], e), 6) as distance, round(1 - array_distance(embedding::double[64], e), 6) as similarity from embeddings, q order by round(array_distance(embedding::double[64], e), 9), vec_id limit 10")
def k6(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.knn(table(spark, d, "embeddings"), _query_vector(spark, d, 7), 10)
    return near.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("m2_cosine_top", "with q as (select embedding::double[64] as e from embeddings where vec_id = 11) select vec_id, round(array_cosine_similarity(embedding::double[64], e), 6) as cosine from embeddings, q order by round(array_cosine_similarity(embedding::double[64], e), 9) desc, vec_id limit 10")
def m2(spark: SparkSession, d: str) -> DataFrame:
    q = vectors.literal(_query_vector(spark, d, 11))
    c = vectors.cosine(F.col("embedding"), q)
    return table(spark, d, "embeddings").select("vec_id", c.alias("c")).orderBy(F.round("c", 9).desc(), "vec_id").limit(10).select("vec_id", F.round("c", 6).alias("cosine"))


@query("k6_knn_by_label", "with q as (select embedding::double[64] as e from embeddings where vec_id = 7) select label, vec_id from (select label, vec_id, row_number() over (partition by label order by round(array_distance(embedding::double[64], e), 9), vec_id) as r from embeddings, q) where r <= 3")
def k6_label(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.distances(table(spark, d, "embeddings"), _query_vector(spark, d, 7))
    entry = F.struct(F.round("distance", 9).alias("d"), "vec_id")
    # three per task and label before the shuffle
    part = near.groupBy("label", F.spark_partition_id().alias("p")).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, 3).alias("t"))
    best = part.groupBy("label").agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, 3).alias("t"))
    return best.select("label", F.explode("t").alias("x")).select("label", "x.vec_id")


def _scored_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every score list of every report, oriented so that higher is better."""
    ways = maybe_broadcast(table(spark, d, "retrievers").select("retriever", "higher_is_better"))
    s = table(spark, d, "scored_index").where("score is not null and not isnan(score)").join(ways, "retriever")
    s = s.groupBy(F.concat_ws("/", "report_id", "retriever").alias("query_id"), "frame_id").agg(F.max(F.expr("cast(if(higher_is_better, score, -score) as double)")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "frame_id")
    return s.withColumn("pos", F.row_number().over(w) - 1)


LISTS = """s as (select report_id || '/' || retriever as query_id, frame_id, max(case when higher_is_better then score::double else -score::double end) as score from scored_index join retrievers using (retriever) where score is not null and not isnan(score) group by all),
b as (select *, row_number() over (partition by query_id order by score desc, frame_id) - 1 as pos, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi, count(*) over (partition by query_id) as n from s),
m as (select *, case when hi - lo < 1.1920929e-07 then 1.0 else (score - lo) / (hi - lo) end as norm from b),
l as (select *, lag(norm) over (partition by query_id order by pos) as prev from m)"""
FALL = "coalesce(prev > 1.1920929e-07 and (prev - norm) / prev > {drop}, false)"
for _name, _args, _test in [
    ("absolute", {"min_score": 0.3}, "norm < 0.3"),
    ("relative", {"min_ratio": 0.5}, "norm < 0.5"),
    ("cliff", {"max_drop": 0.4}, FALL.format(drop=0.4)),
    ("combined", {"relative": 0.5, "max_drop": 0.4, "min_score": 0.3}, f"norm < 0.3 or norm < 0.5 or {FALL.format(drop=0.4)}"),
]:
    query(f"k10_cutoff_{_name}", f"with {LISTS} select query_id, (case when min(n) <= 1 then min(n) else coalesce(min(case when ({_test}) and pos >= 1 then pos end), min(n)) end)::bigint as kept from l group by 1")(lambda s, d, n=_name, a=_args: vectors.cutoff(_scored_lists(s, d), n, **a))


@query("k10_cutoff_elbow", f"""with {LISTS}, e as (select query_id, min(n) as n, arg_min(norm, pos) as y1, arg_max(norm, pos) as y2 from l group by 1),
g as (select l.query_id, pos, abs((y2 - y1) * pos / (e.n - 1) - norm + y1) / sqrt(1 + (y2 - y1) * (y2 - y1)) * (1 + 1.0 * (1 - pos / (e.n - 1))) as far from l join e using (query_id) where pos >= 1 and pos < e.n - 1 and e.n >= 3),
p as (select query_id, pos, far from g qualify row_number() over (partition by query_id order by far desc, pos) = 1)
select e.query_id, (case when e.n <= 1 or far is null or far <= 0.05 then e.n else pos + 1 end)::bigint as kept from e left join p using (query_id)""")
def elbow(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cutoff(_scored_lists(spark, d), "elbow", sensitivity=1.0)


@query("m3_normalised_scores", f"with {LISTS} select query_id, frame_id, round(norm, 6) as norm from m")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return vectors.normalised_scores(_scored_lists(spark, d), ["query_id"]).select("query_id", "frame_id", F.round("norm", 6).alias("norm"))


@query("a5_embedding_identities", "select vec_model, count(*) as frames from (select frame_id, arg_max(vec_model, added_at) as vec_model from vec_documents group by 1) group by 1")
def a5(spark: SparkSession, d: str) -> DataFrame:
    v = latest(table(spark, d, "vec_documents").select("frame_id", "vec_model", "added_at"), ["frame_id"], ["added_at"])
    return v.groupBy("vec_model").agg(F.count("*").alias("frames"))


@query("k8_quantised_search")
def k8(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    v = table(spark, d, "embeddings")
    sample = np.stack([np.asarray(r[0], dtype=float) for r in v.orderBy(F.xxhash64("vec_id")).limit(512).select("embedding").collect()])  # bounded training sample
    book = vectors.train_codebook(sample, 16, 64)
    near = vectors.code_distance(vectors.encode(v, book), book, _query_vector(spark, d, 7))
    return near.orderBy(F.round("distance", 9), "vec_id").limit(10).select("vec_id", F.round("distance", 6).alias("distance"))


# Fusion and contexts.
@query("rrf_fusion", f"""with {bm25_sql(['cache', 'index'])}, h as (select *, row_number() over (order by round(score, 9) desc, frame_id) as r1, row_number() over (order by ts desc, frame_id desc) as r2 from scored where {_has('cache')} or {_has('index')}),
u as (select frame_id, r1 as rank from h where r1 <= 100 union all select frame_id, r2 from h where r2 <= 100)
select frame_id, round(sum(1.0::double / (60.0::double + rank)), 9) as fused, min(rank) as best_rank from u group by 1""")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.search(frames(spark, d), "cache OR index")
    a = lexical.top(hits, 100, "score").select("frame_id", "rank")
    newest = hits.orderBy(F.desc("ts"), F.desc("frame_id")).limit(100)
    b = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("frame_id"))).cast("bigint")).select("frame_id", "rank")
    return ranking.reciprocal_ranks([a, b]).select("frame_id", F.round("fused", 9).alias("fused"), "best_rank")


@query("diversify_by_capsule", f"""with {bm25_sql(['cache', 'index'])}, h as (select *, row_number() over (order by round(score, 9) desc, frame_id) as r from scored where {_has('cache')} or {_has('index')} order by r limit 60),
v as (select *, (row_number() over (partition by capsule order by r) > 1)::int as later from h) select row_number() over (order by later, r) as place, frame_id, capsule from v order by place limit 24""")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.top(lexical.search(frames(spark, d), "cache OR index"), 60, "score")
    return ranking.diversify(hits, "capsule", 24).select("place", "frame_id", "capsule")


@query("q6_promote_extremes", f"""with {bm25_sql(['snapshot', 'ledger'])}, h as (select *, row_number() over (order by round(score, 9) desc, frame_id) as r from scored where {_has('snapshot')} and {_has('ledger')} order by r limit 20),
e as (select arg_min(frame_id, ts * 1000000 + frame_id) as ef, arg_max(frame_id, ts * 1000000 + frame_id) as el from h)
select row_number() over (order by case when frame_id = ef then 0 when frame_id = el then 1 else 2 end, r) as rank, frame_id from h, e""")
def q6(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.top(lexical.search(frames(spark, d), "snapshot ledger"), 20, "score")
    return ranking.promote_extremes(hits).select("rank", "frame_id")


@query("q8_audit_sources", "select a.report_id, s.cite_index, s.frame_id, s.uri, coalesce(s.title, 'untitled') as title from (select distinct report_id from audit_reports) a join (select distinct span_id, report_id, cite_index, frame_id, uri, title from source_spans) s using (report_id)")
def q8(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "audit_reports").select("report_id").distinct()
    spans = table(spark, d, "source_spans").select("span_id", "report_id", "cite_index", "frame_id", "uri", "title").distinct()
    return spans.join(reports, "report_id").select("report_id", "cite_index", "frame_id", "uri", F.coalesce("title", F.lit("untitled")).alias("title"))


# Store, timelines, versions.
@query("s11_dedup_exact", "select sha256(text) as hash, min(doc_id) as frame_id, count(*) as copies from documents where text is not null group by 1")
def s11(spark: SparkSession, d: str) -> DataFrame:
    return store.dedup(frames(spark, d))


LOG = f"log as (select event_id, {SECONDS} as ts, user_id, event_type, value from events)"


@query("s8_current_versions", f"with {LOG} select user_id, event_id, event_type, round(value, 4) as value from log qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 and event_type <> 'error'")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return store.current_versions(event_log(spark, d), "user_id", ["ts", "event_id"], "event_type = 'error'").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query("s9_tombstones", f"with {LOG} select user_id, event_id from (select * from log qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where event_type = 'error'")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return store.tombstones(event_log(spark, d), "user_id", ["ts", "event_id"], "event_type = 'error'").select("user_id", "event_id")


@query("s8_supersessions", f"with {LOG} select event_id, lead(event_id) over w as superseded_by, lag(event_id) over w as supersedes from log window w as (partition by user_id order by ts, event_id)")
def s8b(spark: SparkSession, d: str) -> DataFrame:
    return store.supersessions(event_log(spark, d), "user_id", ["ts", "event_id"], "event_id").select("event_id", "superseded_by", "supersedes")


@query("f3_as_of_versions", f"with {LOG} select user_id, event_id, event_type from log where ts <= 1705000000 qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    return store.as_of(event_log(spark, d), "user_id", ["ts", "event_id"], "ts <= 1705000000").select("user_id", "event_id", "event_type")


@query("k12_timeline", f"with {FRAMES} select frame_id, ts, uri from frames where ts between 1736000000 and 1752000000 order by ts, frame_id limit 100")
def k12(spark: SparkSession, d: str) -> DataFrame:
    return store.timeline(frames(spark, d), 1736000000, 1752000000).select("frame_id", "ts", "uri")


@query("k12_timeline_newest", f"with {FRAMES} select frame_id, ts, uri from frames order by ts desc, frame_id desc limit 25")
def k12b(spark: SparkSession, d: str) -> DataFrame:
    return store.timeline(frames(spark, d), limit=25, newest_first=True).select("frame_id", "ts", "uri")


@query("a1_statistics", f"with {FRAMES} select count(*) as frames, sum(strlen(coalesce(search_text, '')))::bigint as bytes, (sum(strlen(coalesce(search_text, ''))) // greatest(count(*), 1))::bigint as bytes_each, count(*) filter (coalesce(search_text, '') = '') as empty, min(ts) as first_ts, max(ts) as last_ts from frames")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return store.statistics(frames(spark, d))


@query("s14_latest_by_uri", f"with {FRAMES} select uri, frame_id, ts from frames where uri is not null qualify row_number() over (partition by uri order by ts desc, frame_id desc) = 1")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_by_uri(frames(spark, d).select("uri", "frame_id", "ts")).select("uri", "frame_id", "ts")


@query("anti_unenriched", "select doc_id as frame_id from documents where doc_id not in (select frame_id from extracted_entities where frame_id is not null)")
def unenriched(spark: SparkSession, d: str) -> DataFrame:
    return store.missing(frames(spark, d), table(spark, d, "extracted_entities")).select("frame_id")


@query("v1_verify", f"""with {FRAMES}, c as (select count(*) filter (frame_id is null) as null_id, count(*) filter (ts is null) as null_ts, count(*) filter (ts < 0) as negative_ts, count(*) filter (uri is null) as null_uri, count(frame_id) - count(distinct frame_id) as repeated_id from frames)
unpivot c on null_id, null_ts, negative_ts, null_uri, repeated_id into name "check" value failures""")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return store.verify(frames(spark, d))


@query("interval_overlap_join", """with o as (select o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000000 as start from orders), s as (select *, start + 864000 as stop from o)
select a.o_orderkey as left_key, b.o_orderkey as right_key from s a join s b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.start <= b.stop and b.start <= a.stop""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", epoch("o_orderdate").alias("start")).withColumn("stop", F.col("start") + 864000)
    return store.overlaps(o, o, "o_custkey").where("l.o_orderkey < r.o_orderkey").select(F.col("l.o_orderkey").alias("left_key"), F.col("r.o_orderkey").alias("right_key"))


# Facts. Events stand for cards: the user is the entity, the event type the slot.
def cards(spark: SparkSession, d: str) -> DataFrame:
    e = event_log(spark, d)
    relation = F.expr("case when event_id % 11 = 0 then 'retracts' when event_id % 3 = 0 then 'updates' when event_id % 3 = 1 then 'extends' else 'sets' end")
    out = e.select(F.col("event_id").alias("card_id"), F.format_string("User %d", "user_id").alias("entity"), F.upper("event_type").alias("slot"), F.format_string("v%d", F.col("event_id") % 7).alias("value"), relation.alias("relation"), F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("event_date"), F.col("ts").alias("document_date"), ((F.col("event_id") * 37) % 100 / 100.0).alias("confidence"))
    return facts.effective(out)


CARDS = f"""cards as (select event_id as card_id, 'user ' || user_id as entity, lower(event_type) as slot, 'v' || (event_id % 7) as value, {SECONDS} as eff_ts, ((event_id * 37) % 100) / 100.0::double as confidence,
 case when event_id % 11 = 0 then 'retracts' when event_id % 3 = 0 then 'updates' when event_id % 3 = 1 then 'extends' else 'sets' end as relation from events)"""


@query("f3_slot_current", f"with {CARDS} select entity, slot, value, eff_ts from cards where relation <> 'retracts' qualify row_number() over (partition by entity, slot order by eff_ts desc, card_id desc) = 1")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return facts.slot_values(cards(spark, d)).select("entity", "slot", "value", "eff_ts")


@query("f3_slot_as_of", f"with {CARDS} select entity, slot, value, eff_ts from cards where relation <> 'retracts' and eff_ts <= 1704800000 qualify row_number() over (partition by entity, slot order by eff_ts desc, card_id desc) = 1")
def f3b(spark: SparkSession, d: str) -> DataFrame:
    return facts.slot_values(cards(spark, d), 1704800000).select("entity", "slot", "value", "eff_ts")


@query("a10_schema_summary", f"""with {CARDS}, p as (select slot, entity, count(*) as n from cards group by 1, 2), v as (select slot, count(distinct value) as distinct_values from cards group by 1)
select slot, count(*) as entities, sum(n)::bigint as values, any_value(distinct_values) as distinct_values, 'string' as value_type, case when max(n) > 1 or any_value(distinct_values) > 1 then 'multiple' else 'single' end as cardinality, false as is_builtin from p join v using (slot) group by 1""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return facts.schema_of(cards(spark, d))


@query("a16_best_cards", f"with {CARDS} select entity, slot, card_id from cards qualify row_number() over (partition by entity, slot order by confidence desc, card_id) = 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return facts.best_cards(cards(spark, d)).select(F.lower("entity").alias("entity"), F.lower("slot").alias("slot"), "card_id")


@query("a2_memory_statistics", f"with {CARDS} select slot, relation, count(*) as cards, count(distinct entity) as entities from cards group by 1, 2")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).groupBy(F.lower("slot").alias("slot"), "relation").agg(F.count("*").alias("cards"), F.count_distinct(F.lower("entity")).alias("entities"))


@query("a8_count_occurrences", f"with {CARDS} select entity, slot, count(*) filter (contains(value, 'v3')) as n from cards group by 1, 2")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).groupBy(F.lower("entity").alias("entity"), F.lower("slot").alias("slot")).agg(F.count_if(F.lower("value").contains("v3")).alias("n"))


@query("g4_triple_match", f"with {CARDS}, c as (select entity, slot, value from cards where relation <> 'retracts' qualify row_number() over (partition by entity, slot order by eff_ts desc, card_id desc) = 1) select distinct entity from c where slot = 'click' and contains(value, '3')")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return facts.match_triple(facts.slot_values(cards(spark, d)), slot="CLICK", value="3").select("entity").distinct()


# Sentences with facts; the given tables have none.
SAID = [
    (1, "I work at Acme Labs. My name is Dana Reyes."),
    (2, "I live in Porto, Portugal. I am allergic to peanuts."),
    (3, "Alice Moore works at Globex. Alice Moore lives in Berlin."),
    (4, "Bob is married to Carol. Bob's favorite color is green."),
    (5, "I really love green tea. I hate cold soup."),
    (6, "Nothing to see here."),
    (7, "my sister's name is Clara. I am 34 years old."),
]
EXPECTED = [
    (1, "employer", "user", "employer", "Acme Labs"), (1, "name", "user", "name", "Dana Reyes"), (2, "location", "user", "location", "Porto, Portugal"), (2, "allergy", "user", "allergy", "peanuts"),
    (3, "3p_employer_works_at", "alice moore", "employer", "Globex"), (3, "3p_location_lives", "alice moore", "location", "Berlin"), (4, "3p_relationship_married", "bob", "spouse", "Carol"),
    (4, "3p_favorite", "bob", "favorite_color", "green"), (5, "food_like", "user", "food_preference", "green tea"), (5, "food_dislike", "user", "food_preference", "cold soup"), (7, "family", "user", "sister", "Clara"), (7, "age", "user", "age", "34"),
]


@query("f5_rule_cards", "select * from (values " + ", ".join(f"({i}::bigint, '{r}', '{e}', '{s}', '{v}')" for i, r, e, s, v in EXPECTED) + ") as t(frame_id, rule, entity, slot, value)")
def f5(spark: SparkSession, d: str) -> DataFrame:
    said = spark.createDataFrame(SAID, "frame_id bigint, search_text string")
    every = said.unionByName(frames(spark, d).select(F.col("frame_id") + 1000000, "search_text").toDF("frame_id", "search_text"))
    return facts.extract(every).select("frame_id", "rule", "entity", "slot", "value")


# Graph over region, nation, customer and supplier.
def graph(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.format_string("n%d", "n_nationkey").alias("src"), F.format_string("r%d", "n_regionkey").alias("dst"), F.lit("in_region").alias("link"))
    c = table(spark, d, "customer").select(F.format_string("c%d", "c_custkey").alias("src"), F.format_string("n%d", "c_nationkey").alias("dst"), F.lit("lives_in").alias("link"))
    s = table(spark, d, "supplier").select(F.format_string("s%d", "s_suppkey").alias("src"), F.format_string("n%d", "s_nationkey").alias("dst"), F.lit("based_in").alias("link"))
    return n.unionByName(c).unionByName(s)


EDGES = """edges as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'in_region' as link from nation union all select 'c' || c_custkey, 'n' || c_nationkey, 'lives_in' from customer union all select 's' || s_suppkey, 'n' || s_nationkey, 'based_in' from supplier)"""


@query("a3_mesh_statistics", f"with {EDGES} select 'link' as what, link as kind, count(*) as n from edges group by 2 union all select 'node', left(node, 1), count(*) from (select src as node from edges union select dst from edges) group by 2")
def a3(spark: SparkSession, d: str) -> DataFrame:
    e = graph(spark, d)
    nodes = e.select("src").union(e.select("dst")).distinct().select(F.substring("src", 1, 1).alias("kind"))
    return mesh.statistics(nodes, e)


@query("a14_merge_nodes", "select lower(trim(text)) as name, coalesce(entity_type, 'unknown') as kind, count(distinct frame_id) as frames, count(*) as mentions, round(max(confidence)::double, 6) as confidence from (select distinct mention_id, frame_id, text, entity_type, confidence from extracted_entities) where text is not null group by 1, 2")
def a14(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "extracted_entities").select("mention_id", "frame_id", "text", "entity_type", "confidence").distinct().where("text is not null")
    nodes = m.select(F.col("text").alias("name"), F.coalesce("entity_type", F.lit("unknown")).alias("kind"), "frame_id", F.col("confidence").cast("double").alias("confidence"))
    return mesh.merge_nodes(nodes).select("name", "kind", "frames", "mentions", F.round("confidence", 6).alias("confidence"))


# Sketches.
@query("m9_sketch_candidates", """with q as (select distinct query_id, simhash, list_sort(list_distinct(list_filter(top_terms, lambda t: t <> 0))) as qt, token_count from query_sketches),
e as (select distinct frame_id, simhash, list_sort(list_distinct(list_filter(top_terms, lambda t: t <> 0))) as terms, length_hint from sketch_entries where simhash is not null)
select query_id, frame_id, bit_count(xor(q.simhash, e.simhash))::int as hamming, len(list_intersect(qt, terms))::int as shared,
 round(0.5 * len(list_intersect(qt, terms)) / greatest(len(qt), 1) + 0.4 * (1 - bit_count(xor(q.simhash, e.simhash)) / 64.0) + 0.1 / (1 + 0.1 * abs(token_count - coalesce(length_hint, 0))), 6) as score
from q, e where len(list_intersect(qt, terms)) > 0 and bit_count(xor(q.simhash, e.simhash)) <= 16""")
def m9(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("simhash", "top_terms", "token_count")
    q = table(spark, d, "query_sketches").groupBy("query_id").agg(F.max(order).alias("x")).select("query_id", "x.*")
    e = latest(table(spark, d, "sketch_entries").select("frame_id", "simhash", "top_terms", "length_hint", "updated_at"), ["frame_id"], ["updated_at"])
    return sketches.candidates(q, e, 16).withColumn("score", F.round("score", 6))


@query("m5_simhash", f"""with {FRAMES}, t as (select frame_id, unnest(list_filter({TOKENS}, lambda x: strlen(x) >= 2)) as term from frames), w as (select frame_id, term, least(count(*), 3) * 100 as weight from t group by all),
h as (select frame_id, weight, ('0x' || sha256(term)[1:15])::bigint as h from w), b as (select frame_id, unnest(range(60)) as b, h, weight from h),
s as (select frame_id, b, sum(case when (h >> b) & 1 = 1 then weight else -weight end) as s from b group by all)
select frame_id, sum(case when s > 0 then 1::bigint << b else 0 end)::bigint as simhash from s group by 1""")
def m5(spark: SparkSession, d: str) -> DataFrame:
    return sketches.simhash(sketches.term_weights(frames(spark, d)))


@query("a11_term_weights", f"with {FRAMES}, t as (select frame_id, unnest(list_filter({TOKENS}, lambda x: strlen(x) >= 2)) as term from frames) select frame_id, term, least(count(*), 3) * 100 as weight from t group by 1, 2")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return sketches.term_weights(frames(spark, d))


@query("a4_sketch_statistics", "with e as (select frame_id, arg_max(term_filter, updated_at) as f, arg_max(length_hint, updated_at) as l from sketch_entries group by 1) select count(*) as entries, sum(octet_length(f))::bigint as bytes, count(*) filter (l < 50) as short_texts from e")
def a4(spark: SparkSession, d: str) -> DataFrame:
    e = latest(table(spark, d, "sketch_entries").select("frame_id", "term_filter", "length_hint", "updated_at"), ["frame_id"], ["updated_at"])
    return e.agg(F.count("*").alias("entries"), F.sum(F.octet_length("term_filter")).alias("bytes"), F.count_if(F.col("length_hint") < 50).alias("short_texts"))


# Text functions.
MASK_SQL = "text"
for _pattern, _to in T.MASKS:
    _opts = "'g'"
    MASK_SQL = f"regexp_replace({MASK_SQL}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_to}', {_opts})"


def previews(spark: SparkSession, d: str) -> DataFrame:
    """Texts with personal data: both previews of the actions, as last delivered."""
    a = latest(table(spark, d, "replay_actions").select("action_id", "ingested_at", "input_preview", "output_preview"), ["action_id"], ["ingested_at"])
    return a.select("action_id", F.posexplode(F.array("input_preview", "output_preview")).alias("k", "search_text")).select((F.col("action_id") * 2 + F.col("k")).alias("frame_id"), "search_text")


PREVIEWS = "latest as (select * from replay_actions qualify row_number() over (partition by action_id order by ingested_at desc) = 1), previews as (select action_id * 2 as frame_id, input_preview as text from latest union all select action_id * 2 + 1, output_preview from latest)"


@query("t20_mask", f"with {PREVIEWS} select frame_id, {MASK_SQL} as masked from previews")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return previews(spark, d).select("frame_id", T.mask(F.col("search_text")).alias("masked"))


@query("filter_p17_personal_data", f"with {PREVIEWS} select frame_id from previews where {' or '.join('regexp_matches(text, ' + chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) + ')' for p, _ in T.MASKS)}")
def contains_personal(spark: SparkSession, d: str) -> DataFrame:
    return previews(spark, d).where(T.has_personal_data(F.col("search_text"))).select("frame_id")


STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(T.STOP_WORDS))


@query("t18_dates", f"with {PREVIEWS} select frame_id, unnest(list_distinct(list_concat(regexp_extract_all(coalesce(text, ''), '\\b((?:19|20)\\d{{2}})\\b', 1), regexp_extract_all(coalesce(text, ''), '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1)))) as date from previews")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return previews(spark, d).select("frame_id", F.explode(T.date_mentions(F.col("search_text"))).alias("date"))


@query("t19_augmented_text", "select doc_id as frame_id, concat_ws(chr(10), text, case when coalesce(title, '') <> '' then 'title: ' || title end, case when coalesce(uri, '') <> '' then 'uri: ' || uri end, case when coalesce(lower(source), '') <> '' then 'track: ' || lower(source) end, case when coalesce(array_to_string(labels, ' '), '') <> '' then 'labels: ' || array_to_string(labels, ' ') end) as augmented from documents")
def t19(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", T.augmented(F.col("search_text"), F.col("title"), F.col("uri"), F.col("track"), F.col("labels")).alias("augmented"))


@query("t23_preview", "select doc_id as frame_id, left(text, 120) as preview, regexp_extract(uri, '([^/]+)/*$', 1) as title from documents")
def t23(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", T.preview(F.col("search_text")).alias("preview"), T.inferred_title(F.col("uri")).alias("title"))


@query("t5_lex_tokens", "select doc_id as frame_id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}&@+/_]+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]')))::int as n from documents")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", F.size(T.lex_tokens(F.col("search_text"))).alias("n"))


@query("t1_normalised_text")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", T.normalised("search_text").alias("text"))


@query("t13_sections")
def t13(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", F.posexplode(T.sections("search_text")).alias("section_no", "s")).select("frame_id", "section_no", "s.start", "s.stop")


@query("t14_chunks")
def t14(spark: SparkSession, d: str) -> DataFrame:
    cut = frames(spark, d).select("frame_id", "uri", "search_text", F.posexplode(T.chunks("search_text")).alias("chunk_no", "s"))
    return cut.select("frame_id", F.concat("uri", F.lit("#page-"), (F.col("chunk_no") + 1).cast("string")).alias("chunk_uri"), F.expr("substring(search_text, s.start + 1, s.stop - s.start)").alias("chunk"))


@query("t17_labels", "select doc_id as frame_id, unnest(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9 &/-]{3,}') and len(regexp_split_to_array(x, '\\s+')) <= 6)))[1:6]) as label from documents")
def t17(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", F.explode(T.label_lines(F.col("search_text"))).alias("label"))


# Access control: tenants and roles derived from the documents' own columns.
def guarded(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return f.select("frame_id", F.split(F.col("capsule"), "-")[0].alias("tenant"), F.expr("case when frame_id % 3 = 0 then 'public' when frame_id % 3 = 1 then 'restricted' end").alias("visibility"), F.to_json("labels").alias("roles"), F.lit("[]").alias("groups"), F.expr("if(frame_id % 7 = 0, '[\"ana\"]', null)").alias("principals"))


GUARDED = "g as (select doc_id as frame_id, split_part(capsule, '-', 1) as tenant, case when doc_id % 3 = 0 then 'public' when doc_id % 3 = 1 then 'restricted' end as visibility, labels, doc_id % 7 = 0 as ana from documents)"
MAY = "coalesce(tenant = 'thicket' and (visibility = 'public' or (visibility = 'restricted' and (coalesce(list_contains(labels, 'harbor'), false) or ana))), false)"


@query("acl_enforce", f"with {GUARDED} select frame_id from g where {MAY}")
def acl(spark: SparkSession, d: str) -> DataFrame:
    return access.enforce(guarded(spark, d), "thicket", ["harbor"], ["ops"], "ana").select("frame_id")


@query("a19_acl_counters", f"with {GUARDED} select count(*) filter ({MAY}) as allowed, count(*) filter (not {MAY}) as denied, count(*) filter (tenant <> 'thicket') as cross_tenant, count(*) filter (tenant is null or visibility is null) as missing from g")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return access.counters(guarded(spark, d), "thicket", ["harbor"], ["ops"], "ana")


# Replay.
ACTIONS = "a as (select * from replay_actions qualify row_number() over (partition by action_id order by ingested_at desc) = 1)"


@query("r1_sessions", f"with {ACTIONS} select session_id, count(*) as actions, min(action_seq) as first_seq, max(action_seq) as last_seq, coalesce(sum(duration_ms), 0)::bigint as busy_ms from a group by 1")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return replay.sessions(replay.clean(table(spark, d, "replay_actions").select("action_id", "ingested_at", "session_id", "action_seq", "duration_ms")))


@query("r2_session_diff", f"""with {ACTIONS}, l as (select action_seq, min(action_type) as left_type, min(output_hash) as lo from a where session_id = 20 group by 1), r as (select action_seq, min(action_type) as right_type, min(output_hash) as ro from a where session_id = 9000001 group by 1)
select action_seq, left_type, right_type, case when left_type is null then 'right only' when right_type is null then 'left only' when left_type = right_type and lo = ro then 'same' else 'different' end as verdict from l full join r using (action_seq)""")
def r2(spark: SparkSession, d: str) -> DataFrame:
    a = replay.clean(table(spark, d, "replay_actions").where("session_id in (20, 9000001)").select("action_id", "ingested_at", "session_id", "action_seq", "action_type", "output_hash"))
    return replay.compare(a, 20, 9000001)


@query("a17_match_rates", f"""with {ACTIONS}, u as (select * from a where input_hash is not null and output_hash is not null and hex(input_hash) <> repeat('0', 64) and hex(output_hash) <> repeat('0', 64)),
f as (select action_type, input_hash, arg_min(output_hash, action_id) as e from u group by all), j as (select action_type, count(*) filter (output_hash = e) as matched, count(*) filter (output_hash <> e) as mismatched from u join f using (action_type, input_hash) group by 1),
t as (select action_type, count(*) as actions from a group by 1)
select action_type, actions, coalesce(matched, 0) as matched, coalesce(mismatched, 0) as mismatched, actions - coalesce(matched, 0) - coalesce(mismatched, 0) as skipped from t left join j using (action_type)""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return replay.match_rates(replay.clean(table(spark, d, "replay_actions").select("action_id", "ingested_at", "action_type", "input_hash", "output_hash")))


# Time in words.
MOMENT = datetime(2025, 10, 15, 12, 0, tzinfo=timezone.utc)
# (phrase, first second, last second) at that Wednesday noon.
SPOKEN = [
    ("today", "2025-10-15 00:00:00", "2025-10-15 23:59:59"), ("yesterday", "2025-10-14 00:00:00", "2025-10-14 23:59:59"), ("two days ago", "2025-10-13 00:00:00", "2025-10-13 23:59:59"),
    ("in 3 days", "2025-10-18 00:00:00", "2025-10-18 23:59:59"), ("2 weeks from now", "2025-10-29 00:00:00", "2025-10-29 23:59:59"), ("two fridays ago", "2025-10-03 00:00:00", "2025-10-03 23:59:59"),
    ("last friday", "2025-10-10 00:00:00", "2025-10-10 23:59:59"), ("next friday", "2025-10-17 00:00:00", "2025-10-17 23:59:59"), ("this friday", "2025-10-17 00:00:00", "2025-10-17 23:59:59"),
    ("next week", "2025-10-20 00:00:00", "2025-10-26 23:59:59"), ("last week", "2025-10-06 00:00:00", "2025-10-12 23:59:59"), ("end of this month", "2025-10-31 00:00:00", "2025-10-31 23:59:59"),
    ("start of next month", "2025-11-01 00:00:00", "2025-11-01 23:59:59"), ("last month", "2025-09-01 00:00:00", "2025-09-30 23:59:59"), ("3 months ago", "2025-07-15 00:00:00", "2025-07-15 23:59:59"),
    ("in 90 minutes", "2025-10-15 13:30:00", "2025-10-15 13:30:00"), ("at 5pm today", "2025-10-15 17:00:00", "2025-10-15 17:00:00"), ("in the last 24 hours", "2025-10-14 12:00:00", "2025-10-15 12:00:00"),
    ("this morning", "2025-10-15 06:00:00", "2025-10-15 11:59:59"), ("on the sunday after next", "2025-10-26 00:00:00", "2025-10-26 23:59:59"), ("next daylight saving change", "2025-11-02 01:00:00", "2025-11-02 01:00:00"),
    ("midnight tomorrow", "2025-10-16 00:00:00", "2025-10-16 00:00:00"), ("noon next tuesday", "2025-10-21 12:00:00", "2025-10-21 12:00:00"), ("q4 2025", "2025-10-01 00:00:00", "2025-12-31 23:59:59"),
    ("end of q3", "2025-09-30 00:00:00", "2025-09-30 23:59:59"), ("first business day of next month", "2025-11-03 00:00:00", "2025-11-03 23:59:59"), ("10/12/2025", "2025-10-12 00:00:00", "2025-10-12 23:59:59"), ("2024", "2024-01-01 00:00:00", "2024-12-31 23:59:59"),
]


@query("d4_mentions")
def d4(spark: SparkSession, d: str) -> DataFrame:
    a = latest(table(spark, d, "replay_actions").select("action_id", "ingested_at", "input_preview", "output_preview", epoch("ts").alias("ts")), ["action_id"], ["ingested_at"])
    return temporal.mentions(a.select("action_id", "ts", F.posexplode(F.array("input_preview", "output_preview")).alias("k", "search_text")).withColumn("frame_id", F.col("action_id") * 2 + F.col("k")))


# Structure, tables, exports.
@query("t16_structural_chunks")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", F.posexplode(structure.structured("search_text")).alias("chunk_no", "chunk"))


@query("t6_stems")
def t6(spark: SparkSession, d: str) -> DataFrame:
    words = lexical.document_frequencies(frames(spark, d))
    return words.select(lexical.stems("term").alias("stem"), "df", "cf").groupBy("stem").agg(F.sum("cf").alias("cf"), F.count("*").alias("forms"))


SHEETS = "s as (select * from xlsx_sheets qualify row_number() over (partition by sheet_id order by exported_at desc) = 1)"


def sheets(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "xlsx_sheets").select("sheet_id", "workbook_id", "sheet_name", "text", "exported_at"), ["sheet_id"], ["exported_at"])


@query("s20_sheet_rows", f"with {SHEETS} select sheet_id, count(*) as n from (select sheet_id, unnest(regexp_split_to_array(text, '\r?\n')) as line from s) where trim(line) <> '' group by 1")
def s20(spark: SparkSession, d: str) -> DataFrame:
    return tables.sheet_rows(sheets(spark, d)).groupBy("sheet_id").agg(F.count("*").alias("n"))


@query("s20_row_chunks")
def s20b(spark: SparkSession, d: str) -> DataFrame:
    return tables.row_chunks(sheets(spark, d))


@query("s25_csv_export", """select p_partkey || ',' || case when regexp_matches(p_name, '[",]') then '"' || replace(p_name, '"', '""') || '"' else p_name end || ',' || p_size as line from part""")
def s25(spark: SparkSession, d: str) -> DataFrame:
    return sinks.csv_lines(table(spark, d, "part").select("p_partkey", "p_name", "p_size"))


@query("s25_json_export", """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as line from nation""")
def s25b(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_records(table(spark, d, "nation").select("n_nationkey", "n_name"))


# Question answering.
@query("q4_ask")
def q4(spark: SparkSession, d: str) -> DataFrame:
    return ask.answer(frames(spark, d), "Which retriever reads the latest snapshot and ledger?")


@query("q4_retrieve_any", f"""with {bm25_sql(['orphaned'])}, hits as (select * from scored), b as (select *, {BOOST} as boosted from hits)
select frame_id from b order by round(boosted, 9) desc, frame_id limit 10""")
def q4b(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top(lexical.recency(lexical.search(frames(spark, d), ask.ladder("What is orphaned?")[0])), 10).select("frame_id")


# Streams over what is there, against the same in batch.
@query("stream_dedup_count", "select event_type, count(distinct event_id) as n from events group by 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.source(spark, f"{d}/events.parquet").select("event_id", F.to_timestamp("ts").alias("ts"), "event_type")
    return ingest.run_to_table(ingest.deduplicated(s, "event_id", "ts"), spark, "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_tumbling", f"select (({SECONDS}) // 21600 * 21600)::bigint as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.source(spark, f"{d}/events.parquet").select(F.timestamp_seconds(epoch("ts")).alias("ts"), "event_type", "value")
    out = ingest.upsert(ingest.tumbling(s, "ts", "6 hours", ["event_type"]), ["start", "event_type"], "n", spark, "tumbling", mode="update")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("stream_sessions", f"""with e as (select user_id, {SECONDS} as t, case when ({SECONDS}) - lag({SECONDS}) over w < 14400 then 0 else 1 end as new from events window w as (partition by user_id order by {SECONDS})),
s as (select user_id, t, sum(new) over (partition by user_id order by t rows unbounded preceding) as k from e) select user_id, min(t)::bigint as start, max(t)::bigint + 14400 as stop, count(*) as n from s group by user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.source(spark, f"{d}/events.parquet").select(F.timestamp_seconds(epoch("ts")).alias("ts"), "user_id")
    out = ingest.run_to_table(ingest.sessions(s, "ts", "4 hours", "user_id"), spark, "sessions", "complete")
    return out.select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("stop").alias("stop"), "n")


@query("stream_upsert", "select user_id, max(event_id) as event_id from events group by 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.source(spark, f"{d}/events.parquet", 1).select("user_id", "event_id")
    return ingest.upsert(s, "user_id", "event_id", spark, "upsert")


# Further predicates, joins and scalar functions.
WRITTEN = [("2024/05/03 (Fri) 14:30", "2024-05-03 14:30:00"), ("2024-05-03T10:00:00Z", "2024-05-03 10:00:00"), ("2024-05-03", "2024-05-03 00:00:00"), ("May 3rd, 2024", "2024-05-03 00:00:00"), ("3 May 2024", "2024-05-03 00:00:00"), ("1999", "1999-01-01 00:00:00"), ("soon", None)]


@query("j2_value_types", "select value, case when try_cast(value as double) is not null then 'number' when regexp_matches(value, '^\\d{4}-\\d{2}-\\d{2}') then 'datetime' when lower(value) in ('true', 'false', 'yes', 'no') then 'boolean' else 'string' end as kind, count(*) as n from (select n_name as value from nation union all select o_orderstatus from orders union all select l_quantity::varchar from lineitem union all select 'yes' union all select '2024-01-01') group by 1, 2")
def j2(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "nation").select(F.col("n_name").alias("value")).unionByName(table(spark, d, "orders").select(F.col("o_orderstatus").alias("value")))
    v = v.unionByName(table(spark, d, "lineitem").select(F.col("l_quantity").cast("string").alias("value"))).unionByName(spark.createDataFrame([("yes",), ("2024-01-01",)], "value string"))
    return v.groupBy("value", T.value_type(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


@query("filter_p16_index_eligible", "select doc_id as frame_id from documents where trim(text, ' ') <> '' and strlen(text) <= 20000")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).where(T.index_eligible(F.col("search_text"), F.lit("text/plain"), 20000)).select("frame_id")


@query("join_hits_stale", "select count(*) as hits, count(*) filter (h.frame_id not in (select frame_id from sketch_entries)) as stale from (select distinct query_frame_id, frame_id from vec_search_hits) h")
def stale(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "vec_search_hits").select("query_frame_id", "frame_id").distinct()
    known = table(spark, d, "sketch_entries").select("frame_id").distinct().withColumn("known", F.lit(True))
    return hits.join(known, "frame_id", "left").agg(F.count("*").alias("hits"), F.count_if(F.col("known").isNull()).alias("stale"))


@query("range_join_spans_mentions", """with s as (select distinct span_id, frame_id, chunk_range.range_start as a, chunk_range.range_end as b from source_spans where frame_id is not null and chunk_range is not null), m as (select distinct mention_id, frame_id, byte_start, byte_end from extracted_entities)
select span_id, mention_id from s join m using (frame_id) where a < byte_end and byte_start < b""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_spans").where("frame_id is not null and chunk_range is not null").select("span_id", "frame_id", F.col("chunk_range.range_start").alias("a"), F.col("chunk_range.range_end").alias("b")).distinct()
    m = table(spark, d, "extracted_entities").select("mention_id", "frame_id", "byte_start", "byte_end").distinct()
    return s.join(m, "frame_id").where("a < byte_end and byte_start < b").select("span_id", "mention_id")


@query("k9_scoped_similarity", """with v as (select frame_id, arg_max(embedding, added_at)::double[64] as e from vec_documents where len(embedding) = 64 group by 1), q as (select e as qe from v order by frame_id limit 1), s as (select v.* from v join documents d on d.doc_id = v.frame_id where starts_with(capsule, 'atlas'))
select frame_id, round(1 - array_distance(e, qe), 6) as similarity from s, q order by round(array_distance(e, qe), 9), frame_id limit 10""")
def k9(spark: SparkSession, d: str) -> DataFrame:
    v = latest(table(spark, d, "vec_documents").where("size(embedding) = 64").select("frame_id", "embedding", "added_at"), ["frame_id"], ["added_at"])
    q = list(v.orderBy("frame_id").limit(1).select("embedding").first()[0])  # one row
    scope = placed(spark, d).where(compiler.predicate(parser.parse("scope:doc://atlas"))).select("frame_id")
    near = vectors.knn(v.join(scope, "frame_id"), q, 10, "frame_id")
    return near.select("frame_id", F.round("similarity", 6).alias("similarity"))


@query("a15_edge_dedup", "select l_suppkey as src, l_partkey as dst, l_returnflag as link, arg_min(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) as confidence, min(l_orderkey * 10 + l_linenumber) as frame_id from lineitem group by 1, 2, 3")
def a15(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("link"), F.col("l_quantity").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"))
    return mesh.merge_edges(e)


@query("t22_frame_context", "select doc_id as frame_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> ''))::int as words, ((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), 'snapshot', ''))) // 8)::bigint as snapshots from documents")
def t22(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("search_text", F.lit("")), r"\s+"), lambda t: t != ""))
    return frames(spark, d).select("frame_id", words.alias("words"), T.occurrences(F.col("search_text"), "snapshot").alias("snapshots"))


@query("s5_dimension_counts", "select len(embedding)::int as size, count(*) as n from vec_documents where embedding is not null group by 1")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vec_documents").where("embedding is not null").groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))


@query("s12_vacuum", "select doc_id as frame_id, case when doc_id % 4 <> 0 then length(text) end as kept from documents")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return store.vacuum(frames(spark, d), "frame_id % 4 <> 0").select("frame_id", F.length("search_text").cast("bigint").alias("kept"))


from tessera.plans import extended  # noqa: E402, F401  (registers its queries here)
