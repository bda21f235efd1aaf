"""Queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import enrichment, fusion, knn, mixing, names, neardup, packing, pii, sentences, splitting
from tessera.runtime import cut, maybe_broadcast, table


def report_scores(spark: SparkSession, d: str) -> DataFrame:
    """All score lists of the reports that have rows in scored_index, oriented so that higher is better.

    A retriever that is not in the table of retrievers counts as one whose higher scores are better.
    """
    scored = table(spark, d, "scored_index").select("report_id", "retriever", "frame_id", "score")
    ways = table(spark, d, "retrievers").select("retriever", "higher_is_better")
    lists = scored.join(maybe_broadcast(ways), "retriever", "left").select("report_id", F.col("retriever").alias("list_id"), "frame_id", F.expr("if(coalesce(higher_is_better, true), cast(score as double), -cast(score as double))").alias("value"))
    spans = table(spark, d, "source_spans").where("frame_id is not null").select("report_id", F.lit("source_spans").alias("list_id"), "frame_id", F.col("score").cast("double").alias("value"))
    known = scored.select("report_id").distinct()
    return lists.unionByName(spans.join(known, "report_id", "left_semi"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(report_scores(spark, d), "report_id", "list_id", "frame_id", "value")
    return fusion.top_items(fused, "report_id", "frame_id", 3).select("report_id", "frame_id")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(report_scores(spark, d), "report_id", "list_id", "frame_id", "value")
    return fused.select("report_id", "frame_id", F.round("fused_score", 9).alias("fused_score"), F.col("n_lists").cast("bigint").alias("n_lists"))


def sheet_items(spark: SparkSession, d: str) -> DataFrame:
    return splitting.sheet_items(table(spark, d, "xlsx_sheets"), table(spark, d, "source_spans"), table(spark, d, "xlsx_options"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(sheet_items(spark, d), summary=True).select("source_table", "item_id", "cut_kind")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(sheet_items(spark, d))


def p3_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(source_table, item_id, n_chars, too_long, lost): of every oversized text that is not capped, how many pieces break
    the limit, and how many characters other than line ends are in no piece."""
    items = sheet_items(spark, d).select("source_table", "item_id", "text", F.greatest(F.coalesce("max_chars", F.lit(splitting.MAX_CHARS)), F.lit(1)).alias("most"), F.coalesce("max_chunks", F.lit(splitting.MAX_CHUNKS)).alias("chunks"))
    big = items.where("length(text) > most and length(text) <= cast(most as bigint) * chunks")
    pieces = splitting.split(sheet_items(spark, d).withColumn("max_chunks", F.lit(1 << 30)))
    got = pieces.groupBy("source_table", "item_id").agg(F.max(F.length("piece")).alias("longest"), F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("ps"))
    gaps = "aggregate(ps, struct(0L as at, '' as gap), (a, p) -> struct(greatest(a.at, p.char_end) as at, concat(a.gap, substring(text, cast(a.at + 1 as int), cast(p.char_start - a.at as int))) as gap), a -> concat(a.gap, substring(text, cast(a.at + 1 as int))))"
    out = big.join(got, ["source_table", "item_id"], "left")
    return out.select("source_table", "item_id", F.length("text").cast("bigint").alias("n_chars"), F.expr("coalesce(longest > most, true)").alias("too_long"), F.length(F.expr(f"regexp_replace({gaps}, '[\\r\\n]', '')")).cast("bigint").alias("lost"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """(near_true, near_enough, all_true, all_enough) of the frames whose id is divisible by 50 against all rows: how many of
    their 5 nearest there are (nearer than 0.5, and all) and whether at least 0.9 of them are found."""
    vectors = table(spark, d, "vec_documents").select("frame_id", "embedding", "added_at")
    found = knn.nearest(vectors).where("query_frame_id % 50 = 0")
    true = knn.exact(vectors, "frame_id % 50 = 0")
    both = true.join(found.select("query_frame_id", "frame_id", F.lit(1).alias("hit")), ["query_frame_id", "frame_id"], "left")
    sums = both.agg(F.count(F.expr("if(distance < 0.5, 1, null)")).alias("near_true"), F.count(F.expr("if(distance < 0.5, hit, null)")).alias("near_found"), F.count("*").alias("all_true"), F.count("hit").alias("all_found"))
    return sums.select("near_true", F.expr("near_found >= 0.9 * near_true").alias("near_enough"), "all_true", F.expr("all_found >= 0.9 * all_true").alias("all_enough"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest(table(spark, d, "vec_documents").select("frame_id", "embedding", "added_at")).where("distance < 0.5")
    return near.select(F.least("query_frame_id", "frame_id").alias("frame_id_a"), F.greatest("query_frame_id", "frame_id").alias("frame_id_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest(table(spark, d, "vec_documents").select("frame_id", "embedding", "added_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.single_out(table(spark, d, "query_sketches"), table(spark, d, "sketch_entries")).select("query_id", "frame_id")


def p5_worth(spark: SparkSession, d: str) -> DataFrame:
    e = enrichment.enrichment(table(spark, d, "sketch_entries").select("frame_id", "top_terms", "updated_at"))
    return e.select(F.col("record_id").alias("frame_id"), "term", F.col("in_record").cast("bigint").alias("in_record"), "holders", F.round("log_p", 6).alias("log_p"), F.round("score", 6).alias("score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(table(spark, d, "sketch_entries").select("frame_id", "simhash", "term_filter", "updated_at"))


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    return neardup.copies(table(spark, d, "sketch_entries").select("frame_id", "simhash", "term_filter", "updated_at"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.classes(table(spark, d, "sketch_entries").select("frame_id", "simhash", "term_filter", "updated_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts = pii.texts_of(table(spark, d, "replay_actions"), table(spark, d, "audit_reports"))
    return pii.extract(texts, ["source_table", "row_id", "field"]).select("source_table", "row_id", "field", "pii_type", "char_start")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = pii.texts_of(table(spark, d, "replay_actions"), table(spark, d, "audit_reports"))
    keys = ["source_table", "row_id", "field"]
    return pii.redact(texts, keys, pii.extract(texts, keys)).select(*keys, "redacted")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "extracted_entities").where("mention_id is not null").select(F.lit("extracted_entities").alias("source_table"), F.col("mention_id").alias("row_id"), "text")
    r = table(spark, d, "extraction_rules").where("rule_id is not null").select(F.lit("extraction_rules").alias("source_table"), F.col("rule_id").alias("row_id"), F.col("entity").alias("text"))
    return names.link(m.unionByName(r), table(spark, d, "known_entities"), ["source_table", "row_id"])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(packing.token_sizes(table(spark, d, "documents").select("doc_id", "text")))
    return packing.pack(sized)


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """(documents, overfull, split_short, unplaced): every document of the table, containers above the capacity, documents
    that are cut though they fit into a container, and documents with tokens but without one."""
    sized = cut(packing.token_sizes(table(spark, d, "documents").select("doc_id", "text")))
    put = cut(packing.pack(sized))
    full = put.where("container is not null").groupBy("container").agg(F.sum("size").alias("held")).agg(F.count(F.expr(f"if(held > {packing.CAPACITY}, 1, null)")).alias("overfull"))
    each = sized.join(put.groupBy("doc_id").agg(F.count("container").alias("pieces"), F.sum("size").alias("placed")), "doc_id")
    sums = each.agg(F.count("*").alias("documents"), F.count(F.expr(f"if(pieces > 1 and size <= {packing.CAPACITY}, 1, null)")).alias("split_short"), F.count(F.expr("if(size > 0 and placed <> size, 1, null)")).alias("unplaced"))
    return sums.crossJoin(F.broadcast(full))  # one row each


def sized_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their tokens and a quality weight: the share of letters in the text."""
    letters = F.expr("0.05D + length(regexp_replace(text, '[^\\\\p{L}\\\\p{M}]', '')) / length(text)")
    return cut(packing.token_sizes(table(spark, d, "documents").where("text <> ''").select("doc_id", "source", letters.alias("weight"), "text")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(sized_sources(spark, d), table(spark, d, "mix_targets"))


def p9_actual_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sized_sources(spark, d), targets), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """(source, target_share, has_documents, within_cap, close): whether the mixture keeps to each target: no document used
    more than max_repeats times, and a share within a point and half of the source's largest document of the target rescaled
    to the sources with documents."""
    targets = table(spark, d, "mix_targets")
    sized = sized_sources(spark, d)
    reached = mixing.shares(mixing.mix(sized, targets), targets)
    largest = sized.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("size").alias("largest"))
    caps = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("max_repeats").alias("cap"))
    live = reached.agg(F.sum(F.expr("if(tokens > 0, target_share, 0D)")).alias("live"), F.sum("tokens").alias("total"))
    out = reached.join(caps, "source").join(largest, "source", "left").crossJoin(F.broadcast(live))  # one row
    near = F.expr("tokens = 0 or abs(actual_share - target_share / live) <= 0.01 + largest / total / 2")
    return out.select("source", "target_share", F.expr("tokens > 0").alias("has_documents"), F.expr("most_repeats <= cap").alias("within_cap"), near.alias("close"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.units(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "sent_start")


def p10_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.units(table(spark, d, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_ranking": p2_ranking,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_round_trip": p3_round_trip,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_worth": p5_worth,
    "p6_found": p6_found,
    "p6_copies": p6_copies,
    "p6_classes": p6_classes,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_checked": p8_checked,
    "p9_mixture": p9_mixture,
    "p9_actual_shares": p9_actual_shares,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_units": p10_units,
}

LISTS = """
scores as (
  select s.report_id, s.retriever as list_id, s.frame_id, case when coalesce(r.higher_is_better, true) then s.score::double else -s.score::double end as value
  from scored_index s left join retrievers r using (retriever)
  union all
  select report_id, 'source_spans', frame_id, score::double from source_spans where frame_id is not null and report_id in (select report_id from scored_index)),
best as (select report_id, list_id, frame_id, max(value) as value from scores where value is not null and not isnan(value) group by all),
ranked as (select report_id, frame_id, rank() over (partition by report_id, list_id order by value desc) as r from best),
fused as (select report_id, frame_id, sum(1.0::double / (60.0::double + r)) as fused_score, count(*) as n_lists from ranked group by all)
"""

ITEMS = """
opts as (select workbook_id, coalesce(arg_max_null(max_chars, set_at), 1200) as max_chars, coalesce(arg_max_null(max_chunks, set_at), 500) as max_chunks from xlsx_options group by 1),
sheets as (select sheet_id, arg_max(workbook_id, exported_at) as workbook_id, arg_max(text, exported_at) as text from xlsx_sheets where text is not null group by 1),
cites as (select distinct span_id, chunk_range.range_start as a, chunk_range.range_end as b, regexp_extract(uri, 'workbooks/(\\d+)/(\\d+)$', 2) as s from source_spans where frame_id is null and chunk_range is not null),
cited as (select c.span_id, t.workbook_id, t.text, c.a, c.b, encode(t.text) as bytes from cites c join sheets t on t.sheet_id = try_cast(c.s as bigint) where c.a >= 0 and c.b > c.a and c.b <= strlen(t.text)),
items as (
  select 'xlsx_sheets' as source_table, sheet_id as item_id, workbook_id, text from sheets
  union all
  select 'source_spans', span_id, workbook_id, decode(bytes[a + 1:b]) from cited)
"""

AGREEING = """
u as (select frame_id, any_value(simhash) as s, any_value(term_filter) as f from sketch_entries where simhash is not null and regexp_matches(hex(term_filter), '[^0]') group by 1),
n as (select frame_id, s, octet_length(f) as len, f::bit as b, case when octet_length(f) = 64 then unhex(hex(f)[1:64])::bit | unhex(hex(f)[65:128])::bit else f::bit end as h from u),
agreeing as (select a.frame_id as frame_id_a, b.frame_id as frame_id_b from n a join n b on a.frame_id < b.frame_id and bit_count(xor(a.s, b.s)) <= 8
  where case when a.len = b.len then bit_count(a.b & b.b)::double / bit_count(a.b | b.b) else bit_count(a.h & b.h)::double / bit_count(a.h | b.h) end >= 0.8)
"""

ENRICHED = """
latest as (select frame_id, list_filter(arg_max(top_terms, updated_at), lambda t: t <> 0) as ts from sketch_entries where top_terms is not null group by 1),
c as (select frame_id, len(ts) as slots, t.term, len(list_filter(ts, lambda x: x = t.term)) as in_record from (select frame_id, ts, unnest(list_distinct(ts)) as term from latest) t),
size as (select sum(in_record)::double as population from c),
held as (select term, sum(in_record) as holders from c group by 1),
cases as (select slots, in_record, holders, population, count(*) as tests from c join held using (term), size group by all),
chances as (select *, ln(list_sum(list_transform(range(in_record, least(slots, holders)::bigint + 1), lambda x: exp(
    lgamma(holders + 1) - lgamma(x + 1) - lgamma(holders - x + 1) + lgamma(population - holders + 1) - lgamma(slots - x + 1) - lgamma(population - holders - slots + x + 1)
    - lgamma(population + 1) + lgamma(slots + 1) + lgamma(population - slots + 1))))) as log_p from cases),
upto as (select *, sum(tests) over (order by log_p, slots, in_record, holders) as n, sum(tests) over () as m from chances),
tied as (select *, log_p + ln(m / max(n) over (partition by log_p)) as raw from upto),
fixed as (select slots, in_record, holders, log_p, -least(0, min(raw) over (order by log_p desc, slots, in_record, holders)) / ln(10) as score from tied),
enriched as (select frame_id, term, in_record, holders, log_p, score from c join held using (term) join fixed using (slots, in_record, holders))
"""

ORACLE: dict[str, str] = {
    "p2_found": f"with {LISTS} select report_id, frame_id from fused qualify row_number() over (partition by report_id order by round(fused_score, 12) desc, frame_id) <= 3",
    "p2_ranking": f"with {LISTS} select report_id, frame_id, round(fused_score, 9) as fused_score, n_lists from fused",
    "p3_found": f"""with {ITEMS}
select source_table, item_id, case when length(text) > max_chars::bigint * max_chunks then 'capped'
  when list_max(list_transform(regexp_split_to_array(text, '\\r\\n|\\n'), lambda l: length(l))) > max_chars then 'inside_row' else 'between_rows' end as cut_kind
from (select i.source_table, i.item_id, i.text, coalesce(o.max_chars, 1200) as max_chars, coalesce(o.max_chunks, 500) as max_chunks from items i left join opts o using (workbook_id))
where length(text) > max_chars""",
    "p4_found": """with v as (select frame_id, any_value(embedding)::double[64] as e from vec_documents where len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by 1),
d as (select a.frame_id as q, b.frame_id as f, array_distance(a.e, b.e) as d from v a join v b on a.frame_id <> b.frame_id),
n as (select q, f, d from d qualify row_number() over (partition by q order by d, f) <= 5)
select distinct least(q, f) as frame_id_a, greatest(q, f) as frame_id_b from n where d < 0.5""",
    "p3_round_trip": f"""with {ITEMS}
select source_table, item_id, length(text)::bigint as n_chars, false as too_long, 0::bigint as lost
from (select i.source_table, i.item_id, i.text, coalesce(o.max_chars, 1200) as max_chars, coalesce(o.max_chunks, 500) as max_chunks from items i left join opts o using (workbook_id))
where length(text) > max_chars and length(text) <= max_chars::bigint * max_chunks""",
    "p4_recall": """with v as (select frame_id, arg_max(embedding, added_at)::double[64] as e from vec_documents where len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by 1),
n as (select a.frame_id as q, array_distance(a.e, b.e) as d from v a join v b on a.frame_id <> b.frame_id where a.frame_id % 50 = 0 qualify row_number() over (partition by a.frame_id order by d, b.frame_id) <= 5)
select count(*) filter (where d < 0.5) as near_true, true as near_enough, count(*) as all_true, true as all_enough from n""",
    "p8_checked": "select count(*) as documents, 0::bigint as overfull, 0::bigint as split_short, 0::bigint as unplaced from documents",
    "p9_shares": """with t as (select lower(trim(source)) as source, max(target_share) as target_share from mix_targets group by 1),
live as (select source, target_share from t where source in (select lower(trim(source)) from documents where text <> ''))
select source, target_share, coalesce(source in (select source from live), false) as has_documents, true as within_cap, true as close from t""",
    "p5_worth": f"""with {ENRICHED} select frame_id, term, in_record::bigint as in_record, holders::bigint as holders, round(log_p, 6) as log_p, round(score, 6) as score from enriched""",
    "p5_found": f"""with {ENRICHED}, q as (select distinct query_id, unnest(top_terms) as term from query_sketches)
select query_id, frame_id from (select query_id, frame_id, sum(score) as s from q join enriched using (term) where term <> 0 group by all)
qualify row_number() over (partition by query_id order by round(s, 7) desc, frame_id) = 1""",
    "p6_found": f"with {AGREEING} select frame_id_a, frame_id_b from agreeing",
    "p6_copies": """with u as (select frame_id, arg_max(simhash, updated_at) as s, arg_max(term_filter, updated_at) as f from sketch_entries where simhash is not null and regexp_matches(hex(term_filter), '[^0]') group by 1)
select frame_id, min(frame_id) over w as rep, count(*) over w as copies, case when count(*) over w <= 64 then 'pairs' else 'representative' end as listed from u window w as (partition by s, f)""",
    "p6_classes": f"""with recursive {AGREEING},
both_ways as (select frame_id_a as a, frame_id_b as b from agreeing union select frame_id_b, frame_id_a from agreeing),
walk(id, seen) as (select frame_id, frame_id from n union select w.id, e.b from walk w join both_ways e on e.a = w.seen),
least_of as (select id, min(seen) as class_id from walk group by 1),
reps as (select frame_id, min(frame_id) over (partition by s, b, len) as rep from n),
degree as (select rep, count(*) as links from (select distinct r.rep, q.rep as other from agreeing g join reps r on r.frame_id = g.frame_id_a join reps q on q.frame_id = g.frame_id_b where r.rep <> q.rep
  union select q.rep, r.rep from agreeing g join reps r on r.frame_id = g.frame_id_a join reps q on q.frame_id = g.frame_id_b where r.rep <> q.rep) group by 1)
select r.frame_id, l.class_id, coalesce(d.links, 0) as links from reps r join least_of l on l.id = r.frame_id left join degree d on d.rep = r.rep""",
}
