"""More registered queries with SQL: each drives its operator on rows of the tables, whole tables each time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import structure
from tessera.functions import text as T
from tessera.model import epoch, event_log, frames
from tessera.operators import access, ask, facts, lexical, mesh, ranking, search, sketches, store, tables, temporal, vectors
from tessera.plans.catalog import BOOST, FRAMES, GUARDED, LISTS, MAY, SECONDS, SHEETS, TOKENS, _has, _query_vector, bm25_sql, guarded, query, sheets
from tessera.runtime import checkpoint_dir, cut, latest, table
from tessera.sources import readers, sinks

# Facts: the cards of the events, with slots of known predicates and values of several types.
SLOTS = ["age", "birthday", "employer", "Nickname"]


def typed_cards(spark: SparkSession, d: str) -> DataFrame:
    e = event_log(spark, d)
    slot = F.element_at(F.array(*[F.lit(s) for s in SLOTS]), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.expr("case event_id % 4 when 0 then if(event_id % 3 = 0, 'old', cast(event_id % 90 as string)) when 1 then if(event_id % 5 = 0, 'soon', '2001-02-03') when 2 then concat('v', event_id % 7) else 'same' end")
    out = e.select(F.col("event_id").alias("card_id"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("entity"), slot.alias("slot"), value.alias("value"), F.when(F.col("event_id") % 11 == 0, "retracts").otherwise("sets").alias("relation"), F.col("ts").alias("created_at"), (F.col("event_id") % 997).alias("frame_id"), F.lit("preference").alias("kind"), F.when(F.col("event_id") % 2 == 0, "positive").alias("polarity"))
    return facts.effective(out)


TYPED = f"""cards as (select event_id as card_id, 'user' || user_id as entity, ['age', 'birthday', 'employer', 'nickname'][event_id % 4 + 1] as slot, {SECONDS} as eff_ts, event_id % 997 as frame_id, case when event_id % 2 = 0 then 'positive' end as polarity,
 case event_id % 4 when 0 then case when event_id % 3 = 0 then 'old' else (event_id % 90)::varchar end when 1 then case when event_id % 5 = 0 then 'soon' else '2001-02-03' end when 2 then 'v' || (event_id % 7) else 'same' end as value, case when event_id % 11 = 0 then 'retracts' else 'sets' end as relation from events)"""
CURRENT = f"{TYPED}, c as (select * from cards where relation <> 'retracts' qualify row_number() over (partition by entity, slot order by eff_ts desc, card_id desc) = 1)"


@query("f1_validate_cards", f"with {TYPED} select card_id, case when slot = 'age' and try_cast(value as double) is null then 'not a number' when slot = 'birthday' and not regexp_matches(value, '\\d') then 'not a date' end as problem from cards")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return facts.validate(typed_cards(spark, d)).select("card_id", "problem")


@query("f2_predicates", f"""with {TYPED} select slot, count(distinct entity) as entities, count(*)::bigint as values, count(distinct value) as distinct_values, case slot when 'age' then 'string' when 'birthday' then 'string' else 'string' end as value_type,
 case when max(n) > 1 or count(distinct value) > 1 then 'multiple' else 'single' end as cardinality, slot in ('age', 'birthday', 'employer') as is_builtin from (select *, count(*) over (partition by entity, slot) as n from cards) group by slot""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return facts.schema_of(typed_cards(spark, d))


@query("a10_schema_of_nations", """select * from (select 'region' as slot, count(*) as entities, count(*)::bigint as values, count(distinct n_regionkey) as distinct_values, 'number' as value_type, 'multiple' as cardinality, false as is_builtin from nation
 union all select 'planet', count(*), count(*)::bigint, 1, 'string', 'single', false from nation union all select 'country', count(*), count(*)::bigint, 1, 'boolean', 'single', true from nation)""")
def a10b(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    every = F.array(F.struct(F.lit("Region").alias("slot"), F.col("n_regionkey").cast("string").alias("value")), F.struct(F.lit("planet").alias("slot"), F.lit("Earth").alias("value")), F.struct(F.lit("country").alias("slot"), F.lit("yes").alias("value")))
    return facts.schema_of(n.select(F.col("n_name").alias("entity"), F.explode(every).alias("x")).select("entity", "x.*"))


@query("a7_slot_fold", f"""with {TYPED}, last as (select * from cards qualify row_number() over (partition by entity, slot, value order by eff_ts desc, card_id desc) = 1)
select entity, slot, array_to_string(list_sort(list(value)), ',') as vals from last where relation <> 'retracts' group by 1, 2""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return facts.slot_fold(typed_cards(spark, d)).select("entity", "slot", F.array_join("values", ",").alias("vals"))


@query("a7_slot_fold_newest_first", f"""with {TYPED}, first as (select * from cards qualify row_number() over (partition by entity, slot, value order by card_id) = 1)
select entity, slot, array_to_string(list_sort(list(value)), ',') as vals from first where relation <> 'retracts' group by 1, 2""")
def a7b(spark: SparkSession, d: str) -> DataFrame:
    return facts.slot_fold(typed_cards(spark, d), newest_first=True).select("entity", "slot", F.array_join("values", ",").alias("vals"))


@query("a9_distinct_lists", f"with {TYPED} select entity, array_to_string(list_sort(list(distinct slot)), ',') as slots from cards group by 1")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return facts.by_entity(typed_cards(spark, d)).select("entity", F.array_join("slots", ",").alias("slots"))


@query("f3_preferences", f"with {CURRENT} select entity, slot, value, polarity from c")
def f3_preferences(spark: SparkSession, d: str) -> DataFrame:
    return facts.preferences(typed_cards(spark, d))


@query("f3_history", f"with {TYPED} select card_id, slot, value from cards where entity = 'user7'")
def f3_history(spark: SparkSession, d: str) -> DataFrame:
    return facts.history(typed_cards(spark, d), "USER7").select("card_id", F.lower("slot").alias("slot"), "value")


@query("f4_superseded_cards", f"""with {TYPED}, n as (select entity, slot, eff_ts, min(card_id) as by_id from cards where relation in ('updates', 'retracts') group by all)
select a.card_id, arg_min(n.by_id, n.eff_ts) as superseded_by from cards a join n on n.entity = a.entity and n.slot = a.slot and n.eff_ts > a.eff_ts group by 1""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return facts.superseded(typed_cards(spark, d))


@query("g3_planned_triples", f"with {CURRENT} select 'where' as question, entity, value from c where entity = 'user7' and slot = 'employer' union all select 'possessive', entity, value from c where entity = 'user9' and slot = 'age' union all select 'who', entity, value from c where slot = 'employer' and contains(value, 'v3')")
def g3(spark: SparkSession, d: str) -> DataFrame:
    current = cut(facts.slot_values(typed_cards(spark, d)))
    asked = [("where", "Where does User7 work?"), ("possessive", "What is User9's age?"), ("who", "Who works at V3?")]
    out = None
    for name, q in asked:
        one = facts.match_triple(current, *ask.triple(q)).select(F.lit(name).alias("question"), "entity", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("g5_hybrid_search", f"""with {bm25_sql(['ledger'])}, {CURRENT}, t as (select frame_id, row_number() over (order by round(score, 9) desc, frame_id) as rank from scored order by rank limit 20),
g as (select frame_id, row_number() over (order by frame_id) as rank from (select distinct frame_id from c where slot = 'employer' and contains(value, 'v3')) order by rank limit 20)
select 'hybrid' as mode, frame_id, round(sum(1.0::double / (60.0::double + rank)), 9) as fused from (select * from t union all select * from g) group by 2
union all select 'text', frame_id, round(1.0::double / (60.0::double + rank), 9) from t union all select 'graph', frame_id, round(1.0::double / (60.0::double + rank), 9) from g""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    cards = typed_cards(spark, d)
    current = facts.slot_values(cards).join(cards.select("card_id", "frame_id"), "card_id")
    modes = [search.hybrid(frames(spark, d), current, "ledger", "Who works at V3?", m, 20).select(F.lit(m).alias("mode"), "frame_id", F.round("fused", 9).alias("fused")) for m in ("hybrid", "text", "graph")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


# The graph: suppliers, parts and their nations, with a confidence for each edge.
def weighted(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.format_string("n%d", "n_nationkey").alias("src"), F.format_string("r%d", "n_regionkey").alias("dst"), F.lit("located_in").alias("link"), (1 - F.col("n_nationkey") / 100).alias("confidence"))
    s = table(spark, d, "supplier").select(F.format_string("s%d", "s_suppkey").alias("src"), F.format_string("n%d", "s_nationkey").alias("dst"), F.lit("location").alias("link"), (1 - F.col("s_suppkey") % 10 / 20).alias("confidence"))
    return n.withColumn("link", F.lit("location")).unionByName(s).unionByName(s.select("src", F.lit("hub").alias("dst"), F.lit("member").alias("link"), F.lit(0.5).alias("confidence")))


WEIGHTED = """edges as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'location' as link, 1 - n_nationkey / 100.0::double as confidence from nation
 union all select 's' || s_suppkey, 'n' || s_nationkey, 'location', 1 - s_suppkey % 10 / 20.0::double from supplier union all select 's' || s_suppkey, 'hub', 'member', 0.5 from supplier)"""


@query("g2_follow_link", f"""with recursive {WEIGHTED}, e as (select a, b, max(c) as c from (select src as a, dst as b, confidence as c from edges where link = 'location' union all select dst, src, confidence from edges where link = 'location') group by 1, 2),
w(node, hops, conf) as (select 's1', 0, 1.0::double union all select e.b, w.hops + 1, w.conf * e.c from w join e on e.a = w.node where w.hops < 3), l as (select node, min(hops) as hops from w group by 1)
select l.node, l.hops::int as hops, round(max(w.conf), 6) as confidence from l join w on w.node = l.node and w.hops = l.hops group by all""")
def g2_link(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("s1",)], "node string")
    return mesh.follow(weighted(spark, d), start, 3, "located_in").withColumn("confidence", F.round("confidence", 6))


@query("g2_follow_all_paths", f"""with recursive {WEIGHTED}, e as (select src as a, dst as b from edges union select dst, src from edges), w(node, hops) as (select 's1', 0 union select e.b, w.hops + 1 from w join e on e.a = w.node where w.hops < 3) select node, hops::int as hops from w""")
def g2_paths(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("s1",)], "node string")
    return mesh.follow(weighted(spark, d), start, 3, all_paths=True).select("node", "hops")


@query("g2_follow", """with recursive edges as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
e as (select src as a, dst as b from edges union select dst, src from edges), w(node, hops) as (select 's1', 0 union select e.b, w.hops + 1 from w join e on e.a = w.node where w.hops < 2) select node, min(hops)::int as hops from w group by 1""")
def g2(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.catalog import graph

    return mesh.follow(graph(spark, d), spark.createDataFrame([("s1",)], "node string"), 2).select("node", "hops")


MENTIONS = "m as (select distinct mention_id, frame_id, text, entity_type, confidence from extracted_entities where text is not null)"


def mention_nodes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "extracted_entities").select("mention_id", "frame_id", "text", "entity_type", "confidence").distinct().where("text is not null")
    return m.select(F.col("text").alias("name"), F.coalesce("entity_type", F.lit("unknown")).alias("kind"), "frame_id", F.col("confidence").cast("double").alias("confidence"))


@query("g1_find_nodes", f"with {MENTIONS} select lower(trim(text)) as name, list_sort(list(distinct frame_id)) as frame_ids from m where coalesce(entity_type, 'unknown') = 'person' group by lower(trim(text))")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return mesh.find(mesh.merge_nodes(mention_nodes(spark, d)), kind="person").select("name", "frame_ids")


@query("join_entities_or_parents", f"""with {MENTIONS}, h as (select distinct frame_id from source_spans where frame_id is not null), n as (select frame_id, list_sort(list(distinct lower(trim(text)))) as names from m group by 1)
select h.frame_id, array_to_string(coalesce(a.names, b.names, []), '|') as entities from h left join n a on a.frame_id = h.frame_id left join n b on b.frame_id = h.frame_id // 2""")
def entities_or_parents(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "source_spans").where("frame_id is not null").select("frame_id").distinct()
    names = mention_nodes(spark, d).select("frame_id", F.lower(F.trim("name")).alias("name"))
    return mesh.entities_of(hits, names, hits.select("frame_id", F.expr("frame_id div 2").alias("parent_id"))).select("frame_id", F.array_join("entities", "|").alias("entities"))


# Store.
@query("s13_reassembled", "select doc_id as parent_id, sha256(text) as hash from documents where length(text) >= 2400")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return store.reassembled(store.chunk_frames(frames(spark, d))).select("parent_id", F.sha2("search_text", 256).alias("hash"))


@query("join_parent_chunks", "select doc_id as frame_id, length(text)::bigint as chars, true as numbered, true as in_bounds from documents where length(text) >= 2400")
def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    parts = store.chunk_frames(frames(spark, d)).groupBy("parent_id").agg(F.sum(F.length("search_text")).alias("chars"), (F.max("chunk_index") + 1 == F.count("*")).alias("numbered"), (F.max(F.length("search_text")) <= 1440 + 240).alias("in_bounds"))
    return frames(spark, d).select("frame_id").join(parts, F.col("frame_id") == F.col("parent_id")).select("frame_id", "chars", "numbered", "in_bounds")


@query("t13_sections_cover", "select doc_id as frame_id, length(text)::bigint as chars, true as in_order, true as short from documents where length(text) > 0")
def t13_cover(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).where("length(search_text) > 0").select("frame_id", "search_text", T.sections("search_text").alias("s"))
    joined = F.expr("size(s) = 1 or forall(sequence(1, size(s) - 1), i -> s[i].start = s[i - 1].stop)")
    return s.select("frame_id", F.expr("cast(s[size(s) - 1].stop as bigint)").alias("chars"), joined.alias("in_order"), F.expr("forall(s, x -> x.stop - x.start <= 1400)").alias("short"))


@query("s14_by_id", "select doc_id as frame_id, uri from documents where doc_id in (3, 77, 900000000)")
def s14_id(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).where(F.col("frame_id").isin(3, 77, 900000000)).select("frame_id", "uri")


@query("s14_by_uri_active", f"with {FRAMES}, u as (select *, regexp_replace(uri, '[0-9]+$', '') as place from frames) select place as uri, arg_max(frame_id, ((case when frame_id % 3 = 0 then 1 else 0 end)::hugeint * 100000000000 + ts) * 1000000000 + frame_id) as frame_id from u where place is not null group by 1")
def s14_active(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("uri", F.regexp_replace("uri", "[0-9]+$", "")).select("uri", "frame_id", "ts")
    return store.by_uri(f, "frame_id % 3 = 0").select("uri", "frame_id")


@query("s15_media_manifest", "select p_partkey as frame_id, 'image' as kind, p_size::int as width, (p_size * 2)::int as height, p_retailprice as seconds from part where p_partkey % 3 > 0")
def s15(spark: SparkSession, d: str) -> DataFrame:
    media = F.struct(F.lit("image").alias("kind"), F.col("p_size").alias("width"), (F.col("p_size") * 2).alias("height"), F.col("p_retailprice").alias("seconds"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("frame_id"), F.to_json(F.struct(F.when(F.col("p_partkey") % 3 > 0, media).alias("media"), F.lit("x").alias("other"))).alias("metadata"))
    return store.media_manifest(f)


@query("s16_formats", """select doc_id as frame_id, case when doc_id % 5 = 0 then 'pdf' when doc_id % 7 = 0 then 'xlsx' when doc_id % 11 = 0 then 'pdf' when doc_id % 4 = 1 then 'xls' else 'text' end as format from documents where text is not null""")
def s16(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).where("search_text is not null")
    magic = F.expr("case when frame_id % 5 = 0 then x'25504446' when frame_id % 7 = 0 then x'504B0304' else encode(concat('t', search_text), 'utf-8') end")
    name = F.expr("concat('f', frame_id, case when frame_id % 7 = 0 then '.XLSX' when frame_id % 4 = 1 then '.xls' when frame_id % 4 = 2 then '.docx' else '.txt' end)")
    return f.select("frame_id", readers.file_format(magic, name, F.expr("if(frame_id % 11 = 0, 'application/PDF', null)")).alias("format"))


@query("s5_one_width", "select len(embedding)::int as size, count(*) as n from vec_documents where embedding is null or len(embedding) = 64 group by 1")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return vectors.of_width(table(spark, d, "vec_documents"), 64, strict=False).groupBy(F.expr("if(embedding is null, null, size(embedding))").alias("size")).agg(F.count("*").alias("n"))


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks as XLSX files: for each brand its parts, with a header row."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("rows"))

    @F.pandas_udf("binary")
    def run(brands, rows):
        import pandas as pd

        return pd.Series([sinks.xlsx_bytes([("Parts", [["Key", "Name", "Size"], *[[str(r["p_partkey"]), r["p_name"], str(r["p_size"])] for r in rs]])]) for rs in rows])

    return p.select("brand", run("brand", "rows").alias("content"))


@query("s20_xlsx_cells", "select p_brand as brand, p_partkey::varchar as key, p_name as name, p_size::varchar as size from part")
def s20(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<array<string>>")
    def cells(contents):
        return contents.map(lambda c: [r for _, rows in readers.xlsx_sheets(bytes(c)) for r in rows[1:]])

    rows = workbooks(spark, d).select("brand", F.explode(cells("content")).alias("r"))
    return rows.select("brand", F.col("r")[0].alias("key"), F.col("r")[1].alias("name"), F.col("r")[2].alias("size"))


@query("s21_s22_extracted_once", "select count(*) as files, count(distinct text) as texts, true as complete from documents where text is not null")
def s22(spark: SparkSession, d: str) -> DataFrame:
    files = frames(spark, d).where("search_text is not null").select(F.concat(F.lit("f"), F.col("frame_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("search_text", "utf-8").alias("content"))
    return readers.extract(files).agg(F.count("*").alias("files"), F.count_distinct("text").alias("texts"), F.bool_and("complete").alias("complete"))


@query("s24_column_types", f"""with {SHEETS}, l as (select sheet_id, unnest(regexp_split_to_array(text, '\r?\n')[3:]) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n')[3:], 1) - 1 as row from s), p as (select sheet_id, row, unnest(string_split(line, ' | ')) as pair from l),
c as (select sheet_id, row, regexp_extract(pair, '^([^:]+): (.*)$', 1) as col, trim(regexp_extract(pair, '^([^:]+): (.*)$', 2)) as value from p),
k as (select sheet_id, col, case when try_cast(replace(value, ',', '') as double) is not null then 'number' when regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'date' when lower(value) in ('true', 'false', 'yes', 'no') then 'boolean' else 'text' end as kind from c where col <> '' and value <> '' and row < 100),
n as (select sheet_id, col, kind, count(*) as n from k group by all), b as (select sheet_id, col, arg_max(kind, n::varchar.lpad(9, '0') || kind) as kind, max(n) as top, sum(n) as total from n group by 1, 2)
select sheet_id as table_id, col, case when total > top and total - top >= ceil(total * 0.3) then 'mixed' else kind end as value_type from b""")
def s24(spark: SparkSession, d: str) -> DataFrame:
    lines = sheets(spark, d).select("sheet_id", F.posexplode(F.slice(F.split("text", r"\r?\n"), 3, 1 << 30)).alias("row", "line"))
    pairs = lines.select("sheet_id", "row", F.explode(F.split("line", r" \| ")).alias("pair"))
    cells = pairs.select(F.col("sheet_id").alias("table_id"), "row", F.regexp_extract("pair", r"^([^:]+): (.*)$", 1).alias("col"), F.trim(F.regexp_extract("pair", r"^([^:]+): (.*)$", 2)).alias("value")).where("col <> ''")
    return tables.column_types(cells)


@query("s26_audit_markdown", """with a as (select * from audit_reports qualify row_number() over (partition by report_id order by generated_at desc) = 1),
l as (select distinct report_id, cite_index, cite_index || '. ' || coalesce(title, 'untitled') || ' (' || coalesce(uri, 'no uri') || ')' as line from source_spans), s as (select report_id, string_agg(line, chr(10) order by cite_index, line) as lines from l group by 1)
select a.report_id, '# ' || coalesce(question, '') || chr(10) || chr(10) || coalesce(answer, 'No answer was found.') || case when lines is null then '' else chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || lines end as markdown from a left join s using (report_id)""")
def s26(spark: SparkSession, d: str) -> DataFrame:
    a = latest(table(spark, d, "audit_reports").select("report_id", "question", "answer", "generated_at"), ["report_id"], ["generated_at"])
    return sinks.audit_markdown(a, table(spark, d, "source_spans"))


@query("s27_encrypted_round_trip", "select report_id, question, true as refused from audit_reports qualify row_number() over (partition by report_id order by generated_at desc) = 1")
def s27(spark: SparkSession, d: str) -> DataFrame:
    key, other = sinks.derive_key("a test password", b"fixed salt 16 by"), sinks.derive_key("another one", b"fixed salt 16 by")
    a = latest(table(spark, d, "audit_reports").select("report_id", "question", "generated_at"), ["report_id"], ["generated_at"])
    closed = sinks.encrypted(a, "question", key).withColumn("wrong", F.col("question"))
    return sinks.decrypted(sinks.decrypted(closed, "question", key), "wrong", other, strict=False).select("report_id", "question", F.col("wrong").isNull().alias("refused"))


@query("s28_capacity", "select coalesce(sum(strlen(text)), 0)::bigint as bytes, 1000000::bigint as most_bytes, coalesce(sum(strlen(text)), 0) > 1000000 as over from documents")
def s28(spark: SparkSession, d: str) -> DataFrame:
    return store.capacity(frames(spark, d), 1_000_000)


@query("s30_vector_segments", "select vec_id // 128 as segment, count(*) as n, min(vec_id) as first_id, max(vec_id) as last_id, max(len(embedding))::int as width from embeddings where embedding is not null group by 1")
def s30(spark: SparkSession, d: str) -> DataFrame:
    return vectors.segments(table(spark, d, "embeddings"), "vec_id", 128)


@query("s11_new_frames", "select doc_id as frame_id from documents where doc_id % 2 = 1 and text is not null and text not in (select text from documents where doc_id % 2 = 0 and text is not null)")
def s11b(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).where("search_text is not null")
    return store.new_frames(f.where("frame_id % 2 = 1"), f.where("frame_id % 2 = 0")).select("frame_id")


@query("anti_unenriched_by_version", "select doc_id as frame_id from documents where doc_id not in (select frame_id from extracted_entities where frame_id is not null and mention_id % 2 = 0 and mention_id % 3 > 0)")
def unenriched(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "extracted_entities").where("frame_id is not null").select("frame_id", F.expr("if(mention_id % 2 = 0, 'rules', 'other')").alias("engine"), F.expr("if(mention_id % 3 = 0, '1', '2')").alias("version"))
    return store.unenriched(frames(spark, d), ledger, "rules", "2").select("frame_id")


@query("union_merge_unique", "select doc_id as frame_id, array_to_string(list_concat(list_filter(a, lambda x, i: list_position(a, x) = i), list_filter(b, lambda x, i: list_position(b, x) = i and not list_contains(a, x))), ',') as merged from (select doc_id, coalesce(labels, []) as a, [coalesce(lower(source), 'none'), coalesce(lower(lang), 'none'), 'harbor'] as b from documents)")
def merge_unique(spark: SparkSession, d: str) -> DataFrame:
    second = F.array(F.coalesce("track", F.lit("none")), F.coalesce("lang", F.lit("none")), F.lit("harbor"))
    return frames(spark, d).select("frame_id", F.array_join(T.merge_unique(F.col("labels"), second), ",").alias("merged"))


@query("join_candidate_intersection", "select doc_id as frame_id from documents where doc_id in (select frame_id from sketch_entries) and doc_id in (select frame_id from extracted_entities) and doc_id in (select frame_id from vec_documents)")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    return store.intersected(frames(spark, d), table(spark, d, "sketch_entries"), None, table(spark, d, "extracted_entities"), table(spark, d, "vec_documents")).select("frame_id")


@query("filter_p18_images", "select p_partkey as frame_id from part where least(p_size * 40, p_partkey % 50 * 30) >= 64 and greatest(p_size * 40, p_partkey % 50 * 30)::double / least(p_size * 40, p_partkey % 50 * 30) <= 10 and p_partkey % 7 / 100.0 >= 0.01")
def images(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("frame_id"), (F.col("p_size") * 40).alias("width"), (F.col("p_partkey") % 50 * 30).cast("int").alias("height"), (F.col("p_partkey") % 7 / 100).alias("variance"))
    return p.where(T.worthwhile_image(F.col("width"), F.col("height"), F.col("variance"))).select("frame_id")


@query("t23_media_preview", "select doc_id as frame_id, case when doc_id % 10 = 0 then 'a picture' when doc_id % 10 = 1 then 'a film' else left(text, 120) end as preview from documents")
def t23(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", T.media_preview(F.col("search_text"), F.expr("if(frame_id % 10 = 0, 'a picture', '  ')"), F.expr("if(frame_id % 10 < 2, 'a film', null)")).alias("preview"))


# Tables over page breaks: sheets of a workbook as tables on pages.
@query("m11_table_merge", f"""with {SHEETS}, h as (select sheet_id, workbook_id, sheet_id % 10 as page_start, sheet_id % 10 + sheet_id % 2 as page_end, string_split(regexp_split_to_array(text, '\r?\n')[2], ' | ') as headers from s where text is not null),
p as (select a.sheet_id as left_id, b.sheet_id as right_id, a.headers as l, b.headers as r from h a join h b on a.workbook_id = b.workbook_id and a.sheet_id <> b.sheet_id and b.page_start - a.page_end in (1, 2) and len(a.headers) = len(b.headers)),
v as (select left_id, right_id, list_sum(list_transform(list_zip(l, r), lambda x: case when lower(trim(x[1], ' ')) = lower(trim(x[2], ' ')) then 1.0 when contains(lower(x[1]), lower(x[2])) or contains(lower(x[2]), lower(x[1])) then 0.5 else 0.0 end))::double / len(l) as similarity from p)
select left_id, right_id, round(similarity, 6) as similarity from v where similarity >= 0.2""")
def m11(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d).where("text is not null")
    t = s.select(F.col("sheet_id").alias("table_id"), F.col("workbook_id").alias("source"), (F.col("sheet_id") % 10).alias("page_start"), (F.col("sheet_id") % 10 + F.col("sheet_id") % 2).alias("page_end"), F.split(F.coalesce(F.try_element_at(F.split("text", r"\r?\n"), F.lit(2)), F.lit(None).cast("string")), r" \| ").alias("headers"))
    return tables.merge_candidates(t, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("m12_compression", "select count(*) as vectors, sum(len(embedding) * 4)::bigint as plain_bytes, (count(*) * 16)::bigint as code_bytes, sum(len(embedding) * 4) / (count(*) * 16)::double as ratio from vec_documents where len(embedding) = 64")
def m12(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vec_documents").select("embedding")
    sample = np.stack([np.asarray(r[0], dtype=float) for r in v.where("size(embedding) = 64").limit(256).collect()])  # bounded training sample
    return vectors.compression(vectors.encode(v, vectors.train_codebook(sample, 16, 16, 3)))


@query("a5_identity_summary", "select count(distinct vec_model) as identities, case when count(distinct vec_model) = 0 then 'unknown' when count(distinct vec_model) = 1 then 'single' else 'mixed' end as verdict from vec_documents")
def a5b(spark: SparkSession, d: str) -> DataFrame:
    return vectors.identity_summary(table(spark, d, "vec_documents").select(F.lit(None).cast("string").alias("provider"), "vec_model"), "provider", "vec_model")


@query("k7_lists_recall", "select count(*) as queries, true as enough from embeddings where vec_id % 50 = 0 and embedding is not null")
def k7(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search by lists, 10 nearest, against exact search: queries are the ids divisible by 50."""
    v = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    sample = np.stack([np.asarray(r[0], dtype=float) for r in v.orderBy(F.xxhash64("vec_id")).limit(1024).select("embedding").collect()])  # bounded training sample
    centroids = vectors.train_codebook(sample, 1, 32)[0]
    centroids = centroids[np.isfinite(centroids).all(axis=1)]
    return vectors.lists_recall(cut(vectors.assign_lists(v, centroids)), centroids, "vec_id % 50 = 0", 10, 24)


# Dates and times.
WRITTEN = "case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y/%m/%d (%a) 08:30') when 2 then strftime(o_orderdate, '%B %-d, %Y') else strftime(o_orderdate, '%-d %B %Y') end"


@query("d1_content_dates", "select o_orderkey, epoch_us(o_orderdate::date::timestamp) // 1000000 + case when o_orderkey % 4 = 1 then 30600 else 0 end as ts, epoch_us(o_orderdate::date::timestamp + interval 40 day) // 1000000 as latest from orders")
def d1(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    form = lambda c: F.expr(f"case o_orderkey % 4 when 0 then date_format({c}, 'yyyy-MM-dd') when 1 then concat(date_format({c}, 'yyyy/MM/dd (EEE)'), ' 08:30') when 2 then date_format({c}, 'MMMM d, yyyy') else date_format({c}, 'd MMMM yyyy') end")
    o = table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.date_add(day, 40).alias("later"))
    return o.select("o_orderkey", T.content_date(form("day")).alias("ts"), T.latest_content_date(F.array(form("day"), F.date_format("later", "yyyy-MM-dd"), F.lit("soon"))).alias("latest"))


PHRASES = ["yesterday", "today", "two weeks from now", "last month", "3 days ago", "no such time"]


@query("d3_phrases", f"""with {FRAMES}, t as (select frame_id, frame_id % 6 as k, date_trunc('day', make_timestamp(ts * 1000000)) as day from frames where ts is not null)
select frame_id, epoch_us(case k when 0 then day - interval 1 day when 1 then day when 2 then day + interval 14 day when 3 then date_trunc('month', day) - interval 1 month when 4 then day - interval 3 day end) // 1000000 as start,
 epoch_us(case k when 0 then day - interval 1 second when 1 then day + interval 1 day - interval 1 second when 2 then day + interval 15 day - interval 1 second when 3 then date_trunc('month', day) - interval 1 second when 4 then day - interval 2 day - interval 1 second end) // 1000000 as stop from t""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("frame_id") % 6 + 1).cast("int"))
    f = frames(spark, d).where("ts is not null").select("frame_id", temporal.resolved(phrase, F.col("ts")).alias("r"))
    return f.select("frame_id", "r.start", "r.stop")


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose texts name a day relative to their own, two of three of them."""
    said = F.expr("case frame_id % 3 when 0 then 'The ledger was read yesterday by us.' when 1 then 'It runs again tomorrow.' else 'Nothing here.' end")
    return frames(spark, d).where("ts is not null").select("frame_id", "ts", said.alias("search_text"))


SPOKEN = f"""{FRAMES}, d as (select frame_id, ts, date_trunc('day', make_timestamp(ts * 1000000)) as day, frame_id % 3 as k from frames where ts is not null),
spoken as (select frame_id, case k when 0 then 20 else 14 end as char_start, case k when 0 then 29 else 22 end as char_end, case k when 0 then 'yesterday' else 'tomorrow' end as phrase,
 epoch_us(case k when 0 then day - interval 1 day else day + interval 1 day end) // 1000000 as start, epoch_us(case k when 0 then day - interval 1 second else day + interval 2 day - interval 1 second end) // 1000000 as stop from d where k < 2)"""


@query("d4_spoken_mentions", f"with {SPOKEN} select frame_id, char_start::bigint as char_start, char_end::bigint as char_end, phrase, start, stop from spoken")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return temporal.mentions(spoken(spark, d)).drop("confidence")


@query("filter_p13_temporal", f"""with {SPOKEN} select frame_id from frames where frame_id in (select frame_id from spoken where start <= 1746000000 and stop >= 1745600000) or (frame_id not in (select frame_id from spoken) and ts between 1745600000 and 1746000000)""")
def p13(spark: SparkSession, d: str) -> DataFrame:
    said = spoken(spark, d)
    return temporal.within(said, cut(temporal.mentions(said)), 1745600000, 1746000000).select("frame_id")


@query("d7_mention_window", f"with {SPOKEN} select frame_id, start from spoken where start between 1736000000 and 1752000000")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return temporal.mention_window(temporal.mentions(spoken(spark, d)), 1736000000, 1752000000).select("frame_id", "start")


@query("d6_temporal_context", f"""with {SPOKEN} select frame_id, case k when 0 then 'The ledger was read yesterday by us.' || chr(10) || '[Temporal Context: yesterday = ' || strftime(day - interval 1 day, '%Y-%m-%d') || ']' when 1 then 'It runs again tomorrow.' || chr(10) || '[Temporal Context: tomorrow = ' || strftime(day + interval 1 day, '%Y-%m-%d') || ']' else 'Nothing here.' end as text from d""")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return spoken(spark, d).select("frame_id", temporal.enriched_text(F.col("search_text"), F.col("ts")).alias("text"))


@query("d5_anchor_lines", """with l as (select o_orderkey as frame_id, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate + interval 3 day, '%Y-%m-%d') as later from orders)
select frame_id, 0::bigint as line_no, day as anchor from l where frame_id % 2 = 0 union all select frame_id, 1, case when frame_id % 2 = 0 then day else later end from l union all select frame_id, 2, case when frame_id % 2 = 0 then day else later end from l""")
def d5(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.to_date("o_orderdate").alias("day"))
    head = F.when(F.col("frame_id") % 2 == 0, F.concat(F.lit("Session "), F.date_format("day", "yyyy-MM-dd"))).otherwise(F.lit("Notes of the team"))
    text = F.concat_ws("\n", head, F.concat(F.lit("Seen on "), F.date_format(F.date_add("day", 3), "yyyy-MM-dd")), F.lit("and nothing on 25/12/2001 more"))
    return temporal.anchors(o.select("frame_id", text.alias("search_text")))


@query("d8_rfc3339", f"select event_id, strftime(make_timestamp(({SECONDS}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as written from events")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", T.rfc3339(F.col("ts")).alias("written"))


@query("d9_effective_ts", f"with {FRAMES} select frame_id, case when frame_id % 4 = 0 then 1700000000 + frame_id else ts end as effective_ts from frames")
def d9(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    anchored = f.where("frame_id % 4 = 0").select("frame_id", (F.col("frame_id") + 1700000000).alias("anchor_ts"))
    return temporal.effective(f, anchored).select("frame_id", "effective_ts")


@query("join_range_marks", "with s as (select distinct span_id, chunk_range.range_start as a, chunk_range.range_end as b from source_spans where chunk_range is not null) select span_id as frame_id, min(a) as start, max(b) as stop from s group by 1 having min(a) <= max(b)")
def range_marks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_spans").where("chunk_range is not null").select(F.col("span_id").alias("frame_id"), F.lit(0).alias("char_start"), F.lit(5).alias("char_end"), "chunk_range")
    marks = s.select("frame_id", "char_start", "char_end", F.explode(F.expr("array(struct('start' as side, chunk_range.range_start as moment), struct('end' as side, chunk_range.range_end as moment))")).alias("x")).select("frame_id", "char_start", "char_end", "x.*")
    return temporal.paired(marks).select("frame_id", "start", "stop")


# Structure.
@query("t15_structure", """select n_nationkey::bigint as frame_id, k.kind as kind, k.n::bigint as n from nation, (values ('heading', 2), ('paragraph', 2), ('list', 1), ('code', 1), ('table', 1), ('rule', 1)) as k(kind, n)""")
def t15(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("# "), F.col("n_name"), F.lit("\n\nA paragraph of\ntwo lines.\n\n- one\n- two\n\n```\n# no heading\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n\n## Next\n\nEnd."))
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("frame_id"), F.explode(structure.structure(said)).alias("e"))
    return e.groupBy("frame_id", F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("t16_table_chunks", "select n_nationkey::bigint as frame_id, 90::bigint as table_rows, true as headed, true as short from nation")
def t16(spark: SparkSession, d: str) -> DataFrame:
    """A table of 90 rows is cut between rows, every chunk repeats the header, and no row is lost."""
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("| row "), i.cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))), "\n")
    c = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("frame_id"), F.explode(structure.structured(F.concat(F.lit("| id | name |\n|---|---|\n"), rows))).alias("chunk"))
    return c.groupBy("frame_id").agg(F.sum(F.size(F.split("chunk", r"\| row ")) - 1).alias("table_rows"), F.bool_and(F.col("chunk").startswith("| id | name |")).alias("headed"), (F.max(F.length("chunk")) <= 1300).alias("short"))


# Sketches.
@query("m8_bloom", f"""with {FRAMES}, t as (select distinct frame_id, unnest(list_filter({TOKENS}, lambda x: strlen(x) >= 2)) as term from frames), h as (select frame_id, ('0x' || sha256(term)[1:15])::bigint as h from t),
p as (select distinct frame_id, unnest([h % 256, (h >> 16) % 256, (h >> 32) % 256]) as p from h) select frame_id, count(*) as bits, sum(p)::bigint as total, true as holds from p group by 1""")
def m8(spark: SparkSession, d: str) -> DataFrame:
    w = cut(sketches.term_weights(frames(spark, d)))
    b = cut(sketches.bloom(w))
    bits = b.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p"), "filter").where("shiftrightunsigned(filter[p div 64], p % 64) & 1 = 1").groupBy("frame_id").agg(F.count("*").alias("bits"), F.sum("p").alias("total"))
    held = w.join(b, "frame_id").groupBy("frame_id").agg(F.bool_and(sketches.may_contain(F.col("filter"), F.col("term"))).alias("holds"))
    return bits.join(held, "frame_id")


@query("a12_keywords", f"""with w as (select doc_id as frame_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9][a-z0-9''-]+)')) as word from documents),
c as (select frame_id, word, count(*) as n from w where length(word) >= 3 and word not in ({', '.join(repr(w) for w in sorted(T.KEYWORD_STOPS))}) group by all)
select frame_id, word, n from c qualify row_number() over (partition by frame_id order by n desc, word) <= 12""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_keywords(frames(spark, d), 12)


# Search.
@query("k5_fallback_score", f"""with {FRAMES} select frame_id, ((length(lower(search_text)) - length(replace(lower(search_text), 'merged', ''))) // 6
 + (length(lower(search_text)) - length(replace(lower(search_text), 'index', ''))) // 5 + case when contains(lower(search_text), 'merged index') then 1000 else 0 end)::bigint as score
 from frames where contains(lower(search_text), 'merged') and contains(lower(search_text), 'index') and length(search_text) <= 900""")
def k5(spark: SparkSession, d: str) -> DataFrame:
    """Texts of up to 900 characters are one section, so SQL can say what their best section scores."""
    return lexical.fallback_score(frames(spark, d).where("length(search_text) <= 900"), ["merged", "index"]).select("frame_id", F.col("score").cast("bigint").alias("score"))


def indexed(spark: SparkSession, d: str, stemmed: bool) -> str:
    from tessera.streaming.ingest import workspace

    path = workspace(spark, "index")
    lexical.build_index(frames(spark, d), path, 64, stemmed)
    return path


for _name, _text, _words, _where in [
    ("k1_index_and", "snapshot AND ledger", ["snapshot", "ledger"], f"{_has('snapshot')} and {_has('ledger')}"),
    ("k1_index_or_not", "(retriever OR capsule) NOT token", ["retriever", "capsule"], f"({_has('retriever')} or {_has('capsule')}) and not {_has('token')}"),
    ("p2_index_phrase", '"the log said"', ["the", "log", "said"], f"contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' the log said ')"),
]:
    query(_name, f"with {bm25_sql(_words)} select frame_id, round(score, 6) as score from scored where {_where}")(lambda s, d, t=_text: lexical.search_index(s, indexed(s, d, False), t).select("frame_id", F.round("score", 6).alias("score")))


@query("q1_search_request", f"""with {bm25_sql(['cache', 'index'])}, {GUARDED}, hits as (select scored.* from scored where ({_has('cache')} or {_has('index')}) and track = 'kb_article' and frame_id <= 900000 and ts <= 1760000000 and frame_id in (select frame_id from g where {MAY}) and frame_id in (select frame_id from sketch_entries)),
b as (select *, {BOOST} as boosted, count(*) over () as total_hits from hits), r as (select *, row_number() over (order by round(boosted, 9) desc, frame_id) as rank from b)
select rank, frame_id, round(score, 6) as score, total_hits from r where rank > 2 and rank <= 7""")
def q1(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).join(guarded(spark, d), "frame_id")
    request = search.Request("(cache OR index) AND track:kb_article", top_k=5, cursor=2, as_of_frame=900000, as_of_ts=1760000000, tenant="thicket", roles=("harbor",), groups=("ops",), principal="ana")
    found = search.run(f, request, candidates=(table(spark, d, "sketch_entries"),))
    return found.select("rank", "frame_id", F.round("score", 6).alias("score"), "total_hits")


@query("q2_find", f"""with {FRAMES} select frame_id, length(search_text)::bigint as chars from frames where contains(lower(search_text), 'merged') and length(search_text) <= 900""")
def q2(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).where("length(search_text) <= 900")
    return search.find(f, ["merged"], 10**6).select("frame_id", F.length("search_text").cast("bigint").alias("chars")).distinct()


@query("q5_semantic_rerank", """with q as (select embedding::double[64] as e from embeddings where vec_id = 3), h as (select vec_id as frame_id, row_number() over (order by vec_id) as rank, array_cosine_similarity(embedding::double[64], e) as c from embeddings, q where vec_id % 7 = 1 and embedding is not null),
s as (select *, row_number() over (order by round(c, 9) desc, frame_id) as sem from h)
select frame_id, row_number() over (order by round(c + 1.0::double / (60 + rank) + 1.0::double / (60 + sem), 9) desc, rank)::bigint as rank from s""")
def q5(spark: SparkSession, d: str) -> DataFrame:
    hits = ranking.ranked(table(spark, d, "embeddings").where("vec_id % 7 = 1 and embedding is not null").select(F.col("vec_id").alias("frame_id"), "embedding"), [F.asc("frame_id")])
    return search.semantic_rerank(hits, _query_vector(spark, d, 3), "hybrid").select("frame_id", "rank")


@query("k15_context", f"""with {bm25_sql(['cache', 'index'])}, h as (select *, row_number() over (order by round(score, 9) desc, frame_id) as r from scored where {_has('cache')} or {_has('index')} order by r limit 60),
v as (select *, (row_number() over (partition by capsule order by r) > 1)::int as later from h), p as (select *, row_number() over (order by later, r) as place from v)
select string_agg('[' || place || '] ' || left(search_text, 400), chr(10) order by place) as context, count(*) as n_hits from p where place <= 24""")
def k15(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.top(lexical.search(frames(spark, d), "cache OR index"), 60, "score")
    return ranking.context(ranking.diversify(hits, "capsule", 24))


@query("q7_citations", f"""with {bm25_sql(['snapshot', 'ledger'])}, hits as (select * from scored where {_has('snapshot')} and {_has('ledger')}), b as (select *, {BOOST} as boosted from hits), r as (select *, row_number() over (order by round(boosted, 9) desc, frame_id) as rank from b)
select string_agg(left(search_text, 160) || ' [' || rank || ']', ' ' order by rank) as answer, count(*) as n_citations from r where rank <= 3""")
def q7(spark: SparkSession, d: str) -> DataFrame:
    return ranking.citations(lexical.top(lexical.recency(lexical.search(frames(spark, d), "snapshot ledger")), 10))


@query("a6_embedding_quality", """with v as (select vec_id, embedding::double[64] as e from embeddings where embedding is not null and vec_id % 1 = 0), c as (select greatest(-1, least(1, array_cosine_similarity(a.e, b.e))) as c from v a join v b on a.vec_id < b.vec_id)
select count(*) as n_pairs, round(avg(c), 6) as mean, round(min(c), 6) as low, round(max(c), 6) as high, round(stddev_pop(c), 6) as spread, round(avg((c > (select avg(c) from c))::int), 6) as above_mean from c""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    q = vectors.all_pairs_quality(table(spark, d, "embeddings"))
    return q.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "spread", "above_mean")])


@query("v2_doctor_plan", f"""with {FRAMES}, c as (select 'null_ts' as finding, count(*) filter (ts is null) as n from frames union all select 'empty_text', count(*) filter (trim(coalesce(search_text, ''), ' ') = '') from frames union all select 'repeated_text', coalesce(sum(k - 1), 0) from (select count(*) as k from frames where search_text <> '' group by search_text having count(*) > 1)
 union all select 'sketch_without_frame', count(distinct frame_id) from sketch_entries where frame_id not in (select frame_id from frames) union all select 'frame_without_sketch', count(*) from frames where frame_id not in (select frame_id from sketch_entries))
select finding, n::bigint as n, case when n = 0 then 'none' else case finding when 'null_ts' then 'restore_ts' when 'empty_text' then 'skip_index' when 'repeated_text' then 'dedup' when 'sketch_without_frame' then 'drop_sketch' else 'build_sketch' end end as action from c""")
def v2(spark: SparkSession, d: str) -> DataFrame:
    return store.doctor(frames(spark, d), table(spark, d, "sketch_entries").select("frame_id"))


@query("filter_p14_offsets", "select * from (values ('UTC', 0), ('Z', 0), ('+02', 120), ('-0530', -330), ('+05:45', 345)) as t(zone, minutes)")
def p14(spark: SparkSession, d: str) -> DataFrame:
    zones = ["UTC", "Z", "+02", "-0530", "+05:45"]
    return spark.createDataFrame([(z, temporal.offset_minutes(z)) for z in zones], "zone string, minutes int")


@query("acl_audit", f"with {GUARDED} select frame_id, {MAY} as acl_allowed from g")
def acl_audit(spark: SparkSession, d: str) -> DataFrame:
    return access.enforce(guarded(spark, d), "thicket", ["harbor"], ["ops"], "ana", mode="audit").select("frame_id", "acl_allowed")


@query("m3_normalised_all", LISTS and """with s as (select report_id, retriever, frame_id, max(score::double) as score from scored_index where score is not null and not isnan(score) group by all),
b as (select *, min(score) over w as lo, max(score) over w as hi from s window w as (partition by report_id, retriever))
select report_id, retriever, frame_id, round(case when hi - lo < 1.1920929e-07 then 1.0 else (score - lo) / (hi - lo) end, 6) as norm from b""")
def m3(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scored_index").where("score is not null and not isnan(score)").groupBy("report_id", "retriever", "frame_id").agg(F.max(F.col("score").cast("double")).alias("score"))
    return vectors.normalised_scores(s, ["report_id", "retriever"]).select("report_id", "retriever", "frame_id", F.round("norm", 6).alias("norm"))
