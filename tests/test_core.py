"""The core: query language, text functions, facts, time in words, structure, readers, sinks, vectors, store, streams."""

import io
import zipfile
from datetime import datetime, timezone

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import graph, hooks, structure, text
from tessera.functions.stemmer import stem
from tessera.operators import access, ask, facts, lexical, mesh, ranking, search, sketches, store, tables, temporal, vectors
from tessera.plans import compiler, parser
from tessera.runtime import latest, prefix_sums
from tessera.sources import readers, sinks
from tessera.streaming import ingest

NOW = 1700000000


@pytest.fixture(scope="module")
def memory(spark):
    rows = [
        (1, NOW, "mem://physics/quantum", "quantum", "Quantum mechanics is a branch of physics.", ["science"], "a"),
        (2, NOW, "mem://physics/classical", "classical", "Classical mechanics describes motion.", ["Science"], "a"),
        (3, NOW + 100, "mem://biology/cells", "cells", "Cells are the units of life", ["life"], "b"),
        (4, NOW + 200, "mem://chemistry/atoms", "atoms", None, None, None),
        (5, NOW + 300, "mem://math/sets", "sets", "", [], "b"),
    ]
    return spark.createDataFrame(rows, "frame_id bigint, ts bigint, uri string, title string, search_text string, labels array<string>, track string")


def ids(df):
    return sorted(r.frame_id for r in df.collect())


@pytest.mark.parametrize(
    "query,want",
    [
        ("quantum", [1]), ("mechanics", [1, 2]), ("mechanics physics", [1]), ("quantum OR cells", [1, 3]), ("mechanics AND NOT quantum", [2]), ("NOT mechanics", [3, 4, 5]), ('"classical mechanics"', [2]),
        ("mech*", [1, 2]), ("qu?ntum", [1]), ("scope:mem://physics/", [1, 2]), ("uri:MEM://MATH/SETS", [5]), ("label:science", [1, 2]), ("track:B", [3, 5]), ("(quantum OR cells) track:a", [1]), ("unknown", []), ("date:[2030 TO *]", []), ("date:[2023-11-14 TO 2023-11-14]", [1, 2, 3, 4, 5]), ("physics?", [1]),
    ],
)
def test_search(memory, query, want):
    assert ids(lexical.search(memory, query)) == want


def test_substring_matching_and_errors(memory):
    assert ids(memory.where(compiler.predicate(parser.parse("mechan"), "substring"))) == [1, 2]
    for bad in ("", "   ", "(a", "a)", "NOT", "AND"):
        with pytest.raises(parser.QueryError):
            parser.parse(bad)
    assert parser.required_dates(parser.parse("a date:[2020 TO 2021-05]")) == (1577836800, 1622505599)
    assert parser.required_dates(parser.parse("a OR date:2020")) is None
    assert parser.terms(parser.parse('a NOT b ("c d" OR e)')) == ["a", "c", "d", "e"]
    assert ids(memory.where(compiler.uri_filter("MEM://physics"))) == [1, 2]
    assert ids(memory.where(compiler.time_travel(2, NOW))) == [1, 2]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "AND", "OR", "NOT", "(", ")", '"p q"', "tag:x", "date:[* TO 2020]"]), max_size=8))
def test_parser_never_crashes(words):
    try:
        parser.parse(" ".join(words))
    except parser.QueryError:
        pass


def test_top_and_recency(spark):
    rows = [(i, NOW + i * 86400, "doc word " * (1 + i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "frame_id bigint, ts bigint, search_text string")
    hits = lexical.top(lexical.recency(lexical.search(df, "word")), 5)
    assert [r["rank"] for r in hits.collect()] == [1, 2, 3, 4, 5]
    assert lexical.recency(lexical.search(df.limit(0), "word")).count() == 0
    assert ids(lexical.fallback_score(df, ["doc", "word"]).where("score > 1000")) == list(range(20))
    assert lexical.postings(df).where("term = 'word' and frame_id = 2").first().positions == [1, 3, 5]


def test_text_functions(spark):
    assert text.normalise_text("ﬁne\r\n\r\n\tx  y\x00") == "fine\nx y" and text.normalise_text(" ") is None and text.normalise_text(None) is None
    assert text.normalise_text("é" * 10, 5) == "éé" and text.truncation_point("👩‍👩‍👧x", 8) == 0
    assert text.fix_spacing("the qu ic k fox is on it") == "the quick fox is on it" or text.fix_spacing("plain text here") == "plain text here"
    body = "One sentence here. " * 300
    spans = text.chunk_spans(body)
    assert spans[0][0] == 0 and spans[-1][1] == len(body) and all(a == b for (_, a), (b, _) in zip(spans, spans[1:])) and max(b - a for a, b in spans) <= 1440
    assert text.chunk_spans("short") == []
    assert "".join(body[a:b] for a, b in text.section_spans(body)) == body
    assert text.snippet_spans("no match at all", ["zzz"]) == [(0, 15)]
    row = spark.createDataFrame([("Mail john@example.com or 555-123-4567, ssn 123-45-6789, ip 10.0.0.1",)], "t string")
    assert row.select(text.mask(F.col("t")).alias("m")).first().m == "Mail [EMAIL] or [PHONE], ssn [SSN], ip [IP_ADDRESS]"
    assert row.select(text.inferred_title(F.lit("mem://a/b/report.v2.md#page-1")).alias("t")).first().t == "report.v2"


@pytest.mark.parametrize("word,want", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("sky", "sky"), ("national", "nation"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("conformability", "conform")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_structure_and_chunks():
    doc = "# Title\n\nIntro line\nmore.\n\n- a\n- b\n\n```\ncode\n```\n\n| h1 | h2 |\n|---|---|\n" + "".join(f"| Employee {i} | Dept {i % 3} |\n" for i in range(100)) + "\n---\nEnd."
    assert [k for k, _, _ in structure.elements(doc)] == ["heading", "paragraph", "list", "code", "table", "rule", "paragraph"]
    parts = structure.structural_chunks(doc, 600)
    rows = [p for p in parts if "Employee" in p]
    assert len(rows) > 3 and all("| h1 | h2 |" in p for p in rows) and sum(p.count("Employee") for p in rows) == 100
    assert structure.structural_chunks("") == []


def test_rules_and_slots(spark):
    df = spark.createDataFrame([(1, "I work at Acme Labs. I am 34 years old."), (2, None), (3, "nothing")], "frame_id bigint, search_text string")
    assert {(r.slot, r.value) for r in facts.extract(df).collect()} == {("employer", "Acme Labs"), ("age", "34")}
    rows = [(1, "user", "location", "New York", "sets", None, 1000), (2, "User", "Location", "San Francisco", "updates", None, 2000), (3, "user", "location", "Paris", "retracts", None, 3000), (4, "user", "likes", "tea", "extends", None, 1), (5, "user", "likes", "tea", "retracts", None, 2), (6, "user", "likes", "nuts", "extends", 5, 1)]
    c = facts.effective(spark.createDataFrame(rows, "card_id bigint, entity string, slot string, value string, relation string, event_date bigint, document_date bigint"))
    now = {r.slot: r.value for r in facts.slot_values(c).collect()}
    assert now["location"] == "San Francisco"
    assert {r.slot: r.value for r in facts.slot_values(c, 1500).collect()}["location"] == "New York"
    assert {r.slot: r["values"] for r in facts.slot_fold(c).collect()} == {"location": ["New York", "San Francisco"], "likes": ["nuts"]}
    assert {r.slot: r["values"] for r in facts.slot_fold(c, newest_first=True).collect()} == {"location": ["New York", "San Francisco"], "likes": ["nuts", "tea"]}
    kinds = {r.slot: (r.cardinality, r.is_builtin) for r in facts.schema_of(c.where("card_id < 3").unionByName(c.where("card_id = 6"))).collect()}
    assert kinds == {"location": ("multiple", True), "likes": ("single", True)}
    assert {r.entity: r.slots for r in facts.by_entity(c).collect()} == {"user": ["likes", "location"]}
    assert {(r.card_id, r.superseded_by) for r in facts.superseded(c).collect()} == {(1, 2), (2, 3), (4, 5), (6, 4)} - {(6, 4)}
    assert facts.match_triple(facts.slot_values(c), value="francisco").count() == 1
    bad = spark.createDataFrame([(1, "u", "age", "old"), (2, "u", "age", "7")], "card_id bigint, entity string, slot string, value string")
    assert {r.card_id: r.problem for r in facts.validate(bad).collect()} == {1: "not a number", 2: None}
    with pytest.raises(Exception, match="not a number"):
        facts.validate(bad, strict=True).collect()


def test_phrases():
    now = datetime(2025, 10, 15, 12, tzinfo=timezone.utc)
    assert temporal.resolve("  Last  Week ", now)[0].date().isoformat() == "2025-10-06"
    assert temporal.resolve("friday at 3:30 pm", now)[0].isoformat() == "2025-10-17T15:30:00+00:00"
    assert temporal.resolve("31/12/2024", now)[0].date().isoformat() == "2024-12-31"
    for bad in ("", "someday", "q5 2020"):
        with pytest.raises(temporal.PhraseError):
            temporal.resolve(bad, now)
    assert temporal.offset_minutes("+0530") == 330 and temporal.offset_minutes("Z") == 0
    found, state = temporal.track(["Session 2024-05-01", "talk", "on 3/4/2023 we met", "Session 2024-06-02"])
    assert found == ["2024-05-01", "2024-05-01", "2024-05-01", "2024-06-02"] and state[0] == "2024-06-02"
    assert "yesterday = 2025-10-14" in temporal.enriched("we met yesterday", now)


def test_mentions(spark):
    df = spark.createDataFrame([(1, NOW, "see you tomorrow, not 10/12/2025"), (2, None, "today"), (3, NOW, None)], "frame_id bigint, ts bigint, search_text string")
    assert [r.phrase for r in temporal.mentions(df).orderBy("char_start").collect()] == ["tomorrow", "10/12/2025"]
    assert temporal.mentions(df.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, None), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [r.vec_id for r in vectors.knn(df, [1.0, 0.0], 2).collect()] == [1, 3]
    c = {r.vec_id: r.c for r in df.where("vec_id < 5").select("vec_id", vectors.cosine(F.col("embedding"), vectors.literal([1.0, 0.0])).alias("c")).collect()}
    assert c[1] == 1 and c[2] == 0
    lists = spark.createDataFrame([("q", i, s) for i, s in enumerate([1.0, 0.9, 0.85, 0.2, 0.1])] + [("r", 0, 0.4)], "query_id string, pos int, score double")
    got = lambda *a, **k: {r.query_id: r.kept for r in vectors.cutoff(lists, *a, **k).collect()}
    assert got("cliff", max_drop=0.5) == {"q": 3, "r": 1} and got("relative", min_ratio=0.5)["q"] == 3 and got("absolute", min_score=0.95)["q"] == 1 and got("elbow")["q"] in (3, 4)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8))
    book = vectors.train_codebook(x, 2, 16)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    near = vectors.code_distance(vectors.encode(v, book), book, x[3].tolist()).orderBy("distance").limit(20)
    assert 3 in [r.vec_id for r in near.collect()]


def test_store(spark):
    log = spark.createDataFrame([(1, "a", 1, "put"), (2, "a", 2, "delete"), (3, "b", 1, "put"), (4, "b", 1, "put")], "id bigint, key string, ts bigint, kind string")
    assert [(r.key, r.id) for r in store.current_versions(log, "key", ["ts", "id"], "kind = 'delete'").collect()] == [("b", 4)]
    assert store.tombstones(log, "key", ["ts", "id"], "kind = 'delete'").count() == 1
    f = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "frame_id bigint, search_text string")
    assert [(r.frame_id, r.copies) for r in store.dedup(f).collect()] == [(1, 2)]
    assert store.new_frames(f.where("frame_id = 2"), f.where("frame_id = 1")).count() == 0
    assert latest(log.limit(0), ["key"], ["ts"]).count() == 0


def test_prefix_sums(spark):
    df = spark.createDataFrame([(g, i, (i * 7) % 5 + 1) for g in "ab" for i in range(200)], "g string, i bigint, n bigint")
    out = prefix_sums(df, ["g"], F.col("i"), F.col("n"), F.expr("i div 16"), ["i"])
    for g in "ab":
        total = 0
        for r in out.where(f"g = '{g}'").orderBy("i").collect():
            assert r._before == total
            total += r.n


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (10, 11), (11, 12), (12, 13), (13, 1), (None, 3)], "a bigint, b bigint")
    got = {r.id: r.component for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 12: 1, 13: 1, 4: 4, 5: 4, 7: 7}


def test_mesh(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hops for r in mesh.follow(e, start, 2, both=False).collect()} == {"a": 0, "b": 1, "c": 2}
    w = spark.createDataFrame([("a", "b", "manager", 0.9), ("b", "c", "manager", 0.5), ("a", "c", "owner", 0.1), ("a", "d", "manager", None), (None, "d", "manager", 1.0)], "src string, dst string, link string, confidence double")
    assert {(r.node, r.hops, round(r.confidence, 3)) for r in mesh.follow(w, start, 2, "managed_by").collect()} == {("a", 0, 1.0), ("b", 1, 0.9), ("d", 1, 1.0), ("c", 2, 0.45)}
    assert sorted((r.node, r.hops) for r in mesh.follow(w, start, 2, both=False, all_paths=True).collect()) == [("a", 0), ("b", 1), ("c", 1), ("c", 2), ("d", 1)]
    assert mesh.follow(w, start.limit(0), 2).count() == 0


def test_sketches(spark):
    f = spark.createDataFrame([(1, "cats are wonderful pets and friends"), (2, "cats are wonderful pets and fiends"), (3, "programming in a rusty language")], "frame_id bigint, search_text string")
    h = {r.frame_id: r.simhash for r in sketches.simhash(sketches.term_weights(f)).collect()}
    assert (h[1] ^ h[2]).bit_count() < (h[1] ^ h[3]).bit_count()
    b = sketches.bloom(sketches.term_weights(f))
    assert all(len(r["filter"]) == 4 and 1 <= sum((x & (1 << 64) - 1).bit_count() for x in r["filter"]) <= 18 for r in b.collect())
    assert {r.frame_id for r in b.where(sketches.may_contain(F.col("filter"), F.lit("wonderful"))).collect()} >= {1, 2}
    one = b.where("frame_id = 1").select(F.col("filter").alias("other"))
    agreement = {r.frame_id: r.a for r in b.crossJoin(one).select("frame_id", sketches.filter_overlap(F.col("filter"), F.col("other")).alias("a")).collect()}
    assert agreement[1] == 1.0 and agreement[2] > agreement[3]


def test_access(spark):
    rows = [(1, "t", "public", None, None, None), (2, "t", "restricted", '["r"]', None, None), (3, "t", "restricted", "oops", "[]", '["p"]'), (4, "u", "public", None, None, None), (5, None, None, None, None, None), (6, "t", "restricted", None, '["g"]', None)]
    df = spark.createDataFrame(rows, "frame_id bigint, tenant string, visibility string, roles string, groups string, principals string")
    assert ids(access.enforce(df, "t", ["r"], ["g"], "p")) == [1, 2, 3, 6] and ids(access.enforce(df, "t", [], [], "x")) == [1]
    with pytest.raises(ValueError):
        access.enforce(df, None, [], [], "x")
    c = access.counters(df, "t", ["r"], [], "q").first()
    assert (c.allowed, c.denied, c.cross_tenant, c.missing) == (2, 4, 1, 1)


def test_ask(memory):
    assert ask.sanitise("What is the quantum mechanics?") == "quantum mechanics" and ask.sanitise("who is it") == "who is it"
    assert ask.ladder("What are cells?")[0] == "cells"
    assert ask.kinds("Is it nowhere in the countless summaries?") == set()
    assert "aggregation" in ask.kinds("How many cells are there?") and ask.triple("Where does Alice work?") == ("alice", "employer", None)
    r = ask.answer(memory, "What are quantum mechanics?").first()
    assert "Quantum mechanics" in r.answer and "[1]" in r.answer
    assert ask.answer(memory, "???").count() == 1


def test_ranking(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "frame_id bigint, rank bigint")
    b = spark.createDataFrame([(2, 1), (3, 2)], "frame_id bigint, rank bigint")
    assert [r.frame_id for r in ranking.reciprocal_ranks([a, b]).collect()] == [2, 1, 3]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_readers(spark, tmp_path):
    w, a, s = (x.strip("{}") for x in (readers.W, readers.A, readers.S))
    docx = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>'})
    pptx = _zip({f"ppt/slides/slide{i}.xml": f'<p xmlns:a="{a}"><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></p>' for i in (2, 1)})
    sheet = f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Amount</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2"><v>3.5</v></c></row></sheetData></worksheet>'
    xlsx = _zip({"xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Name</t></si></sst>', "xl/worksheets/sheet1.xml": sheet})
    for name, data in {"a.docx": docx, "b.pptx": pptx, "c.xlsx": xlsx, "d.txt": "plain é".encode(), "e.pdf": b"%PDF-1.4", "f.docx": b"PK\x03\x04broken", "copy.txt": "plain é".encode()}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hello\nWorld" and got["b.pptx"].text == "Slide 1\n\nSlide 2" and got["d.txt"].text == got["copy.txt"].text == "plain é"
    assert "Name: 7 | Amount: 3.5" in got["c.xlsx"].text and got["e.pdf"].problem == "no reader for pdf" and got["f.docx"].text is None and got["f.docx"].problem


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "x", 3)], "i int, s string, n int")
    assert [r.line for r in sinks.csv_lines(df).collect()] == ['1,"a ""b"", c",', "2,x,3"]
    key = sinks.derive_key("p", b"0123456789abcdef")
    secret = sinks.encrypted(df, "s", key)
    assert secret.first().s != 'a "b", c' and sinks.decrypted(secret, "s", key).first().s == 'a "b", c'
    f = spark.createDataFrame([(1, NOW, "x")], "frame_id bigint, ts bigint, search_text string")
    path = str(tmp_path / "store")
    sinks.write_store(f, path)
    files = sinks.snapshot_files(spark.read.parquet(path))
    sinks.write_store(f, path)
    assert sinks.open_snapshot(spark, path, files).count() == 1 and sinks.open_snapshot(spark, path).count() == 2


def test_tables(spark):
    cells = spark.createDataFrame([("t", r, "a", v) for r, v in enumerate(["1", "2", "3,000", ""])] + [("t", r, "b", v) for r, v in enumerate(["1", "x", "y", "2024-01-02"])], "table_id string, row int, col string, value string")
    assert {r.col: r.value_type for r in tables.column_types(cells).collect()} == {"a": "number", "b": "mixed"}
    s = spark.createDataFrame([(1, "T\nh\n" + "\n".join(f"row {i}" for i in range(50))), (2, None)], "sheet_id bigint, text string")
    parts = [r.text for r in tables.row_chunks(s, 100).orderBy("chunk_no").collect()]
    assert all(p.startswith("T\nh\n") for p in parts) and sum(p.count("row") for p in parts) == 50


def test_hooks(spark):
    df = spark.createDataFrame([(1, "aa", 1), (2, None, 2), (3, "a", 3)], "frame_id bigint, search_text string, rank bigint")
    assert {r.frame_id: r.embedding for r in hooks.embed(df, lambda ts: [[float(len(t))] for t in ts]).collect()} == {1: [2.0], 2: None, 3: [1.0]}
    assert [r.frame_id for r in hooks.rerank(df, lambda q, ts: [-len(t) for t in ts], "q").orderBy("rank").collect()] == [2, 3, 1]
    ledger = spark.createDataFrame([(1, "e", "1")], "frame_id bigint, engine string, version string")
    todo = hooks.enrich(df.select("frame_id"), lambda b: b.assign(n=1), "frame_id bigint, n int", ledger, "e", "1")
    assert ids(todo) == [2, 3]


def test_streams(spark, tmp_path):
    a, b = str(tmp_path / "in"), str(tmp_path / "in")
    spark.createDataFrame([(1, "Session 2024-05-01"), (2, "no date")], "doc_id bigint, line string").coalesce(1).write.parquet(a)
    first = ingest.source(spark, b, 1)
    got = {(r.doc_id, r.anchor) for r in ingest.run_to_table(ingest.anchored(first), spark, "anchors").collect()}
    assert got == {(1, "2024-05-01"), (2, None)}
    spark.createDataFrame([(1, "later")], "doc_id bigint, line string").coalesce(1).write.mode("append").parquet(a)
    newest = ingest.upsert(ingest.source(spark, b, 1), "doc_id", "line", spark, "newest")
    assert {(r.doc_id, r.line) for r in newest.collect()} == {(1, "later"), (2, "no date")}




def test_best_section_counts(spark):
    far = "merged once. " + "filler words here. " * 100 + "the index is there."
    near = "filler words here. " * 100 + "merged index and merged again."
    df = spark.createDataFrame([(1, far), (2, near), (3, None), (4, "")], "frame_id bigint, search_text string")
    assert {r.frame_id: r.score for r in lexical.fallback_score(df, ["merged", "index"]).collect()} == {2: 1003}
    assert ids(lexical.fallback_score(df, ["merged", "index"], section=False)) == [1, 2]


def test_index_search_equals_scan(memory, spark, tmp_path):
    for stemmed in (False, True):
        lexical.build_index(memory, str(tmp_path / f"i{stemmed}"), 4, stemmed)
    for q in ("mechanics physics", "quantum OR cells", "mechanics AND NOT quantum", '"classical mechanics"', "unknown"):
        want = {r.frame_id: round(r.score, 9) for r in lexical.search(memory, q).collect()}
        assert {r.frame_id: round(r.score, 9) for r in lexical.search_index(spark, str(tmp_path / "iFalse"), q).collect()} == want
    assert ids(lexical.search_index(spark, str(tmp_path / "iTrue"), "mechanic unit")) == [] and ids(lexical.search_index(spark, str(tmp_path / "iTrue"), "describe AND motions")) == [2]
    with pytest.raises(parser.QueryError):
        lexical.search_index(spark, str(tmp_path / "iTrue"), "scope:mem://a")


def test_search_requests(memory):
    assert ids(search.run(memory, search.Request("mechanics", scope="mem://physics/q"))) == [1]
    assert ids(search.run(memory, search.Request("mechanics", uri="MEM://PHYSICS"))) == [1, 2]
    assert ids(search.run(memory, search.Request("mechanics OR cells", as_of_ts=NOW))) == [1, 2]
    assert ids(search.run(memory, search.Request("mechanics", active="frame_id <> 1"))) == [2]
    page = search.run(memory, search.Request("mechanics OR cells OR physics", top_k=1, cursor=1)).collect()
    assert len(page) == 1 and page[0]["rank"] == 2 and page[0].total_hits == 3
    assert ids(search.run(memory, search.Request("mechanics", cursor=5))) == []
    assert ids(search.run(memory, search.Request("mechanics"), candidates=(memory.where("frame_id = 2"), None))) == [2]
    assert ids(search.run(memory, search.Request("mechanics"), candidates=(memory.limit(0),))) == []
    with pytest.raises(ValueError):
        search.run(memory, search.Request("mechanics", cursor=-1))


def test_store_views(spark):
    long = "One line of text here.\n" * 200
    f = spark.createDataFrame([(1, 10, "u", "T", long), (2, 20, "u", None, "short"), (3, 30, None, None, None)], "frame_id bigint, ts bigint, uri string, title string, search_text string")
    parts = store.chunk_frames(f)
    assert parts.where("chunk_index = 0").first().uri == "u#page-1" and parts.first().title.startswith("T (page 1/")
    assert [(r.parent_id, r.search_text) for r in store.reassembled(parts).collect()] == [(1, long)]
    assert [(r.frame_id) for r in store.by_uri(f, "frame_id = 1").collect()] == [1] and [(r.frame_id) for r in store.by_uri(f, "false").collect()] == [2]
    assert store.capacity(f, 10).first().over and not store.capacity(f.limit(0), 10).first().over
    with pytest.raises(Exception, match="numbers"):
        vectors.of_width(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id bigint, embedding array<float>"), 3).collect()


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0]), (2, None), (3, [1.0])], "vec_id bigint, embedding array<float>")
    book = vectors.train_codebook(np.array([[0.0, 1, 2, 3], [1, 1, 1, 1]]), 2, 2)
    e = vectors.encode(df, book)
    assert {r.vec_id: r.codes is None for r in e.collect()} == {1: False, 2: True, 3: True}
    assert [r.vec_id for r in vectors.code_distance(e, book, [0.0, 1, 2, 3]).where("distance is not null").collect()] == [1]


def test_workbooks_round_trip():
    sheets = [("A & B", [["x", "", "1"], [], ["<y>", "z"]]), ("Two", [["q"] * 30])]
    back = readers.xlsx_sheets(sinks.xlsx_bytes(sheets))
    assert [n for n, _ in back] == ["A & B", "Two"] and back[0][1] == [["x", "", "1"], [], ["<y>", "z"]] and back[1][1] == [["q"] * 30]


def test_checkpoint_folder_is_shared(spark):
    from tessera import runtime

    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        runtime.checkpoint_dir(Cluster)


def test_streams_go_on_and_rewrite_their_buckets(spark, tmp_path):
    from tessera.streaming import ingest as streams

    folder = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "k bigint, at bigint").coalesce(1).write.mode("append").parquet(folder)
    put([(i, 1) for i in range(50)])
    name = tmp_path.name.replace("-", "")
    assert streams.upsert(streams.source(spark, folder), "k", "at", spark, "go", run=name).count() == 50
    put([(3, 2), (3, 1), (77, 1)])
    rows = {r.k: r.at for r in streams.upsert(streams.source(spark, folder), "k", "at", spark, "go", run=name).collect()}
    assert len(rows) == 51 and rows[3] == 2 and rows[4] == 1
    again = streams.upsert(streams.source(spark, folder), "k", "at", spark, "go", run=name)  # nothing new
    assert again.count() == 51
