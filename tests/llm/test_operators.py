"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import enrichment, fusion, knn, mixing, names, neardup, packing, pii, sentences, splitting


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


# 1. Personal information
PEOPLE = ["Daniel", "Rebecca", "Thomas", "Valerie", "Oliver", "Susan"]


def corpus():
    out = []
    for i in range(40):
        n = f"{PEOPLE[i % 6]} {['Bramholt', 'Carvane', 'Dunsley', 'Eskmere', 'Fennwick', 'Graldahl', 'Hexbach'][i % 7]}"
        ids = [f"9{i:02d}-41-{1000 + i}", f"9{i:02d} 41 {1000 + i}", f"6661{i:02d}5{i:02d}"][i % 3]
        out += [f"owner: {n}, patient id {ids}, call (415) 555-01{i:02d} now", f"patient id {ids} was seen", f"call 415-555-01{i:02d} now"]
        out += ["Victoria Falls demo moved", f"build 481-22-{10000 + i} is green", f"ask owner: {n}, please"]
    return out


def test_pii_learns_layouts_from_contexts(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row bigint, text string")
    found = rows(pii.extract(df, ["row"]), "row", "pii_type", "char_start", "char_end")
    said = {(t, texts[i][a:b]) for i, t, a, b in found}
    assert ("ID_NUMBER", "902 41 1002") not in said and ("ID_NUMBER", "901 41 1001") in said
    assert ("ID_NUMBER", "666102502") in said and ("PHONE", "415-555-0103") in said and ("PHONE", "(415) 555-0103") in said
    assert ("NAME", "Daniel Bramholt") in said
    assert not any("Falls" in v or v.startswith("481") for _, v in said)


def test_pii_dirty_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "x", 1), (2, "", "x", 1), (3, "mail a.b@example.org, " + "word " * 30000 + "c@example.net", "x", 1), (4, "b.c at mail dot example dot org", "x", 1), (4, "b.c at mail dot example dot org", "x", 1), (None, "d@example.com", "x", 1)],
        "start bigint, text string, value string, key int",
    )
    found = rows(pii.extract(df, ["start"]), "start", "pii_type", "char_start")
    assert found == sorted([(3, "EMAIL", 5), (3, "EMAIL", 150022), (4, "EMAIL", 0), (None, "EMAIL", 0)], key=repr)
    red = {r["start"]: r["redacted"] for r in pii.redact(df, ["start"], pii.extract(df, ["start"])).collect()}
    assert red[1] is None and red[2] == "" and red[4] == "[EMAIL]" and red[None] == "[EMAIL]"
    assert pii.extract(df.limit(0), ["start"]).count() == 0


# 2. Fusion
def test_fusion_against_brute_force(spark):
    rng = random.Random(3)
    data = [(g, s, i, rng.choice([None, float("nan"), rng.randint(0, 9) * 1.0, rng.random() * 1000])) for g in range(4) for s in "abc" for i in range(30)]
    data += data[:20] + [(None, "a", 1, 1.0), (0, None, 1, 1.0), (0, "a", None, 1.0)]
    df = spark.createDataFrame(data, "group_id bigint, list_id string, item_id bigint, value double").selectExpr("*", "1 as _n", "2 as fused_score")
    best = {}
    for g, s, i, v in data:
        if None not in (g, s, i, v) and not math.isnan(v):
            best[g, s, i] = max(v, best.get((g, s, i), -math.inf))
    want = {}
    for (g, s, i), v in best.items():
        rank = 1 + sum(1 for (a, b, _), w in best.items() if (a, b) == (g, s) and w > v)
        want[g, i] = want.get((g, i), 0) + 1 / (60 + rank)
    got = {(r.group_id, r.item_id): r.fused_score for r in fusion.fuse(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    top = fusion.top_items(fusion.fuse(df), "group_id", "item_id", 3)
    for g in range(4):
        order = sorted((-round(v, 12), i) for (a, i), v in want.items() if a == g)[:3]
        assert [i for _, i in order] == [r.item_id for r in top.where(f"group_id = {g}").orderBy("fused_rank").collect()]
    assert fusion.fuse(df.limit(0)).count() == 0


# 3. Splitting
def greedy(text, most, overlap):
    """Pieces one after another, the plain way."""
    import re

    import regex

    rows_, at = [], 0
    for m in re.finditer(r"\r\n|\n", text):
        rows_.append((at, m.start()))
        at = m.end()
    rows_.append((at, len(text)))
    out, b = [], 0
    while b <= len(text) and (b < len(text) or not out):
        r = max(i for i, (s, _) in enumerate(rows_) if s <= b)
        s, e = rows_[r]
        room = most - (e - s) if e - s <= most else overlap
        a = b - min(overlap, b, max(room, 0))
        last = max((i for i, (_, x) in enumerate(rows_) if x <= a + most), default=-1)
        if last >= r:
            stop = rows_[last][1]
            nxt = rows_[last + 1][0] if last + 1 < len(rows_) else len(text) + 1
        else:
            row, limit = text[s:e], a + most
            inside = lambda ps: max((s + p for p in ps if b < s + p <= limit), default=-1)  # noqa: B023, E731
            sentence = inside([m.end() for m in re.finditer(r"[.!?]+\s+", row)])
            word = inside([m.end() for m in re.finditer(r"\s+", row)])
            stop = nxt = sentence if 2 * (sentence - b) >= limit - b else word if word > 0 else inside([m.end() for m in regex.finditer(r"\X", row)])
            if stop < 0:
                stop = nxt = limit
        if stop > a:
            out.append((a, stop))
        b = nxt
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abé .", max_size=24), max_size=10), st.integers(1, 12), st.integers(0, 5), st.sampled_from(["\n", "\r\n"]))
def test_split_equals_the_plain_way(lines, most, overlap, end):
    text = end.join(lines)
    if not text:
        return
    p = splitting.split_batch([text], [most], [overlap])
    got = list(zip(p.start.tolist(), p.end.tolist()))
    assert got == greedy(text, most, min(overlap, most - 1))
    assert all(b - a <= most for a, b in got)
    covered = set().union(*[range(a, b) for a, b in got]) if got else set()
    assert all(text[i] in "\r\n" for i in set(range(len(text))) - covered)


def test_long_rows_are_cut_at_sentences_then_words():
    text = "First sentence here. Second one follows it. " + "word " * 8 + "x" * 30
    p = splitting.split_batch([text], [24], [0])
    assert [text[a:b] for a, b in zip(p.start, p.end)][:5] == ["First sentence here. ", "Second one follows it. ", "word word word word ", "word word word word ", "x" * 24]


def test_split_dirty_rows(spark):
    long = "x" * 250000
    df = spark.createDataFrame(
        [("a", 1, None, 10, 0, 5, 1), ("a", 2, "", 10, 0, 5, 1), ("a", 3, "12345678901\nab", 5, 2, 100, 1), ("a", 4, long, 1000, None, 3, 1), ("a", 5, "z" * 1300, None, None, None, 1), ("a", 6, "q" * 20, 0, 9, 2, 1), ("a", 7, "short", 10, 1, 1, 1)],
        "source_table string, item_id bigint, text string, max_chars int, overlap_chars int, max_chunks int, piece int",
    )
    kinds = rows(splitting.split(df, summary=True), "item_id", "cut_kind")
    assert kinds == [(3, "inside_row"), (4, "capped"), (5, "inside_row"), (6, "capped")]
    assert splitting.split(df).where("item_id = 4").count() == 3
    assert splitting.split(df.limit(0)).count() == 0


def test_sheet_items_ranges(spark):
    sheets = spark.createDataFrame([(1, 9, "äöü" * 10, 1), (1, 9, "äöü" * 10, 1), (2, 9, None, 1)], "sheet_id bigint, workbook_id bigint, text string, exported_at int")
    uri = "mem://workbooks/9/1"
    spans = spark.createDataFrame([(1, None, uri, (0, 60)), (2, None, uri, (0, 61)), (3, None, uri, (8, 4)), (4, None, uri, None), (5, 7, uri, (0, 60)), (1, None, uri, (0, 60)), (6, None, uri, (2, 44))], "span_id bigint, frame_id bigint, uri string, chunk_range struct<range_start: bigint, range_end: bigint>")
    options = spark.createDataFrame([(9, 10, None, None, 2), (9, 99, 1, 1, 1)], "workbook_id bigint, max_chars int, max_chunks int, overlap_chars int, set_at int")
    items = splitting.sheet_items(sheets, spans, options)
    assert rows(items, "source_table", "item_id", "max_chars") == [("source_spans", 1, 10), ("source_spans", 6, 10), ("xlsx_sheets", 1, 10)]
    assert {r.text for r in items.where("item_id = 6").collect()} == {("äöü" * 10)[1:22]}


# 4. Nearest vectors
def test_hilbert_order_is_a_walk():
    cells = np.array(list(itertools.product(range(8), repeat=2)))
    order = cells[np.argsort(knn.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_knn_recall_and_dirty_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 64)).astype(np.float32)
    v[500:1000] = v[:500] + 0.05 * rng.standard_normal((500, 64)).astype(np.float32)
    v[1000:1012] = v[1000]
    data = [(i, [float(x) for x in r], 1, "m") for i, r in enumerate(v)]
    bad = [(2000, None, 1, "m"), (2001, [0.0] * 64, 1, "m"), (2002, [1.0] * 32, 1, "m"), (2003, [float("nan")] * 64, 1, "m"), (2004, [None] * 64, 1, "m"), (5, data[5][1], 1, "m")]
    df = spark.createDataFrame(data + bad, "frame_id bigint, embedding array<float>, added_at int, distance string")
    got = {}
    for r in knn.nearest(df, 5).collect():
        got.setdefault(r.query_frame_id, []).append((r.hit_rank, r.frame_id, r.distance))
    d = np.sqrt(((v[:, None, :].astype(float) - v[None].astype(float)) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    hit = sum(len({f for _, f, _ in got[i]} & {j}) for i in range(500) for j in [i + 500])
    assert hit >= 0.99 * 500
    assert set(got) == set(range(1500)) and all(len(x) == 5 for x in got.values())
    assert all(abs(d[i, f] - x) < 1e-9 for i in range(0, 1500, 7) for _, f, x in got[i])
    assert all(x == 0 for _, _, x in got[1003])
    assert knn.nearest(df.limit(0)).count() == 0
    assert knn.nearest(df.limit(1)).count() == 0


@pytest.mark.parametrize("tasks", [1, 7])
def test_knn_window_reaches_over_partition_edges(spark, monkeypatch, tasks):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 8)).astype(np.float32)
    v[300:320] = v[300]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "frame_id bigint, embedding array<float>")
    monkeypatch.setattr(knn, "MOST_TASKS", tasks)
    monkeypatch.setattr(knn, "TILE", 16)
    got = {}
    for r in knn.nearest(df, 4, width=8, curves=1, window=60, dims=8).collect():
        got.setdefault(r.query_frame_id, []).append(round(r.distance, 9))
    # all rows within the window in the one ordering, the plain way
    norm = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1.0)
    at = np.lexsort((np.arange(900), knn.curve_keys(v / norm, 0, 2.0 / np.sqrt(8), 8, 3)))
    for place in range(900):
        others = [j for j in range(max(0, place - 60), min(900, place + 61)) if j != place]
        want = sorted(float(np.sqrt(((v[at[place]].astype(float) - v[at[j]].astype(float)) ** 2).sum())) for j in others)[:4]
        assert len(got[at[place]]) == 4 and all(x <= y + 1e-6 for x, y in zip(sorted(got[at[place]]), want))


# 5. Enrichment
def test_upper_tail_is_exact():
    for population, holders, draws, count in [(50, 7, 6, 1), (50, 7, 6, 3), (40, 40, 5, 2), (30, 1, 4, 1), (30, 3, 4, 0), (10, 2, 5, 3)]:
        want = sum(math.comb(holders, x) * math.comb(population - holders, draws - x) for x in range(count, min(holders, draws) + 1)) / math.comb(population, draws)
        got = math.exp(enrichment.upper_tail(*(np.array([z]) for z in (population, holders, draws, count)))[0])
        assert abs(got - want) < 1e-9


def test_enrichment_and_single_out(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i, [rng.choice([0, 1, 2, 3]) for _ in range(3)] + [10 + rng.randint(0, 40)], 1, 0.5) for i in range(200)] + [(900, None, 1, 0.1), (901, [0, 0], 1, 0.2), (902, [None, 7, 7], 1, 0.3), (3, [5, 5, 5, 5], 0, 0.4)]
    df = spark.createDataFrame(data, "frame_id bigint, top_terms array<bigint>, updated_at int, score double")
    e = enrichment.enrichment(df)
    got = {(r.record_id, r.term): r for r in e.collect()}
    assert (902, 7) in got and got[902, 7].in_record == 2 and not any(k[0] in (900, 901) for k in got) and (3, 5) not in got
    ordered = sorted(got.values(), key=lambda r: r.log_p)
    m = len(ordered)
    # Benjamini-Hochberg by hand
    q, want = 0.0, {}
    for at in range(m - 1, -1, -1):
        r = ordered[at]
        upto = sum(1 for x in ordered if x.log_p <= r.log_p)
        q = min(q, r.log_p + math.log(m / upto))
        want[r.record_id, r.term] = -q / math.log(10)
    assert all(abs(got[k].score - want[k]) < 1e-6 for k in got)
    queries = spark.createDataFrame([(1, data[0][1]), (2, [7, 99, 0]), (3, [12345]), (4, None), (1, data[0][1]), (5, [1, 2, 3])], "query_id bigint, top_terms array<bigint>")
    held = {}
    for i, t in got:
        held.setdefault(i, set()).add(t)
    out = {r.query_id: r for r in enrichment.single_out(queries, df).collect()}
    for q, terms in [(1, set(data[0][1]) - {0}), (2, {7, 99}), (5, {1, 2, 3})]:
        best = max((round(sum(got[i, t].score for t in s & terms), 6), -i) for i, s in held.items() if s & terms)
        assert out[q].frame_id == -best[1] and abs(out[q].worth - best[0]) < 1e-5
    monkeypatch.setattr(enrichment, "HOT", 10)
    assert {r.query_id: r.frame_id for r in enrichment.single_out(queries, df).collect()} == {q: r.frame_id for q, r in out.items()}
    assert enrichment.single_out(queries, df).count() == 3
    assert enrichment.enrichment(df.limit(0)).count() == 0 and enrichment.single_out(queries, df.limit(0)).count() == 0


# 6. Near duplicates
@pytest.mark.parametrize("chunk", [16384, 40])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = random.Random(9)
    base = [(rng.getrandbits(64), rng.getrandbits(256) & rng.getrandbits(256) | 1) for _ in range(40)]
    data = []
    for i in range(200):
        s, f = rng.choice(base)
        for _ in range(rng.randint(0, 7)):
            s ^= 1 << rng.randrange(64)
        for _ in range(rng.randint(0, 12)):
            f ^= 1 << rng.randrange(256)
        wide = rng.random() < 0.3
        b = f.to_bytes(32, "little")
        data.append((i, s - (1 << 64) if s >> 63 else s, b + (bytes(32) if rng.random() < 0.5 else b) if wide else b, 1, "x"))
    data += [(500, None, bytes([1] * 32), 1, "x"), (501, 5, bytes(32), 1, "x"), (502, 5, None, 1, "x"), (503, 5, b"abc", 1, "x"), (0, data[0][1], data[0][2], 1, "x")]
    df = spark.createDataFrame(data, "frame_id bigint, simhash bigint, term_filter binary, updated_at int, rep string")
    clean = {i: (s & (1 << 64) - 1, f) for i, s, f, _, _ in data if i < 500}
    want = []
    for a, b in itertools.combinations(sorted(clean), 2):
        (s, f), (t, g) = clean[a], clean[b]
        if (s ^ t).bit_count() <= 8:
            if len(f) != len(g):
                f, g = (bytes(x | y for x, y in zip(z[:32], z[32:])) if len(z) == 64 else z for z in (f, g))
            x, y = int.from_bytes(f, "big"), int.from_bytes(g, "big")
            if (x & y).bit_count() >= 0.8 * (x | y).bit_count():
                want.append((a, b))
    assert len(want) > 50 and rows(neardup.pairs(df), "frame_id_a", "frame_id_b") == sorted(want, key=repr)
    parent = {i: i for i in clean}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.frame_id: r.class_id for r in neardup.classes(df).collect()} == {i: find(i) for i in clean}
    assert neardup.pairs(df.limit(0)).count() == 0 and neardup.classes(df.limit(0)).count() == 0


def test_many_copies_keep_their_links(spark):
    f = bytes([3] * 32)
    data = [(i, 77, f, 1) for i in range(100)] + [(i, 76, f, 1) for i in range(200, 300)] + [(400, 79, f, 1), (401, 79, f, 1), (500, ~77, f, 1)]
    df = spark.createDataFrame(data, "frame_id bigint, simhash bigint, term_filter binary, updated_at int")
    got = set(rows(neardup.pairs(df)))
    assert neardup.pairs(df).count() == len(got)
    want = {(0, i) for i in range(1, 100)} | {(200, i) for i in range(201, 300)} | {(400, 401)}
    want |= {(i, j) for i in (*range(100), *range(200, 300)) for j in (400, 401)}  # every copy to every copy of a small group
    want |= {(i, 200) for i in range(100)} | {(0, i) for i in range(200, 300)}  # and to the least of a large one
    assert got == want
    assert {r.class_id for r in neardup.classes(df).collect()} == {0, 500}
    groups = {r.frame_id: (r.rep, r.copies, r.listed) for r in neardup.copies(df).collect()}
    assert groups[99] == (0, 100, "representative") and groups[401] == (400, 2, "pairs") and groups[500] == (500, 1, "pairs")


@pytest.mark.parametrize("copies", [65, 1000])
def test_copies_are_pairs_or_members(spark, copies):
    df = spark.createDataFrame([(i, 5, bytes([7] * 32), 1) for i in range(copies)], "frame_id bigint, simhash bigint, term_filter binary, updated_at int")
    assert set(rows(neardup.pairs(df))) == {(0, i) for i in range(1, copies)}


@pytest.mark.parametrize("number", [10, 11, 12, 13])
def test_every_close_pair_is_under_one_choice(number):
    blocks = neardup.Blocks(number)
    rng = random.Random(number)
    for _ in range(60):
        d = 0
        for _ in range(rng.randint(0, 8)):
            d |= 1 << rng.randrange(64)
        same = {k for k in range(number) if not (d >> blocks.edges[k]) & ((1 << blocks.edges[k + 1] - blocks.edges[k]) - 1)}
        hits = [c for c in range(len(blocks.choices)) if same.issuperset(blocks.choices[c]) and blocks.first(np.array([d], np.uint64), c)[0]]
        assert len(hits) == 1
    assert [neardup.blocks_for(n).number for n in (10**3, 3 * 10**5, 10**7, 10**9)] == [10, 10, 11, 13]


# 7. Names
def test_name_variants(spark):
    known = spark.createDataFrame([(1, "Katherine Norreenenko", "person"), (2, "Samuel Norreenenko", "person"), (3, "Glasswater Foods Inc.", "organization"), (4, "Glasswater Research", "organization"), (5, "Ann Bo", None), (6, None, "person"), (7, "Wei Li", "person"), (8, "Katherine Li", "person"), (9, "Joe Ng", "person"), (10, "Anna Maria Luisa Petra Carla Rosa Nina Olga Vera Rita Zita Quorrimond", "person")], "entity_id bigint, display_name string, kind string")
    said = {
        "Kate Norreenenko": 1, "norreenenko, katherine": 1, "K. Norreenenko": 1, "Norreenenko S": 2, "Dr. Samuel T. Norreenenko": 2, "SamuelNorreenenko": 2, "Samuel Norreennko": 2, "Smauel Norreenenko": 2,
        "Rebecca Norreenenko": None, "Norreenenko": None, "Glasswater Food.": 3, "GLASSWATER FOODS LTD": 3, "Glas swater Foods": 3, "Foods, Glasswater": 3, "Glasswater Rsch": 4, "Glasswater Health": None, "": None, "  ": None, "$1": None, "user": None, "Wei Li": 7, "Li, Wei": 7, "WeiLi": 7, "Kate Li": 8, "K. Li": 8, "Joe Ng": 9, "Joe Nga": None, "Li": None,
        "Quorrimond, Rita Zita Vera Olga Nina Rosa Carla Petra Luisa Maria Anna": 10, "x" * 50000: None,
    }
    data = [(i, t, 0) for i, t in enumerate(said)] + [(0, "Kate Norreenenko", 0), (99, None, 0)]
    df = spark.createDataFrame(data, "row bigint, text string, entity_id int")
    got = {r.row: r.entity_id for r in names.link(df, known, ["row"]).collect()}
    assert got == {i: e for i, e in enumerate(said.values()) if e}
    assert names.link(df.limit(0), known, ["row"]).count() == 0 and names.link(df, known.limit(0), ["row"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.lists(st.sampled_from([0.0, 0.1, 0.2, 1.0, 1.4, 9.0]), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_optimal(cost):
    n = len(cost)
    assert abs(names.least_assignment(cost) - min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=4, max_size=9), st.text("abcd", min_size=4, max_size=9))
def test_delete_index_finds_every_small_edit(a, b):
    for most in (1, 2):
        if names.distance(a, b, most) <= most:
            assert names.deletes(a, most) & names.deletes(b, most)


# 8. Containers
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), min_size=1))
def test_plan_uses_every_item_once(lengths):
    plans = packing.plan_containers(dict(lengths), 24)
    used = {}
    for layout, times in plans:
        assert sum(x * m for x, m in layout.items()) <= 24
        for x, m in layout.items():
            used[x] = used.get(x, 0) + m * times
    assert used == lengths


def test_packing(spark):
    rng = random.Random(2)
    data = [(i, rng.randint(1, 40), 1.0) for i in range(500)] + [(900, 250, 1.0), (901, 0, 1.0), (902, None, 1.0), (903, 200, 1.0), (904, -3, 1.0)]
    df = spark.createDataFrame(data, "doc_id bigint, size int, fill double")
    out = packing.pack(df, capacity=100).collect()
    by = {}
    for r in out:
        if r.container is not None:
            by.setdefault(r.container, []).append(r)
    assert all(sum(r["size"] for r in c) <= 100 and abs(sum(r["size"] for r in c) / 100 - c[0].fill) < 1e-9 for c in by.values())
    sizes = {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r["size"]
    assert sizes == {i: max(s or 0, 0) for i, s, _ in data}
    assert {r.doc_id for r in out if r.container is None} == {901, 902, 904}
    assert sum(1 for r in out if r.doc_id == 900) == 3 and sum(1 for r in out if r.doc_id == 903) == 2
    assert len(by) <= math.ceil(sum(sizes.values()) / 100) + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_token_sizes(spark):
    enc = packing.encoder()
    df = spark.createDataFrame([(1, "Hello world, hello."), (2, ""), (3, None), (4, "語" * 3000)], "doc_id bigint, text string")
    assert {r.doc_id: r["size"] for r in packing.token_sizes(df).collect()} == {1: len(enc.encode_ordinary("Hello world, hello.")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("語" * 3000))}


# 9. Mixtures
def test_mixture_shares(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["a", " A ", "b", "b", "b", "c", None]), rng.randint(1, 50), rng.choice([None, 0.0, 0.5, 2.0]), "x") for i in range(3000)] + [(5000, "a", 0, 1.0, "x"), (5001, "zz", 7, 1.0, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, source string, size int, weight double, key string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.2, 1), ("c", 0.2, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets)
    got = {r.source: r for r in mixing.shares(m, targets).collect()}
    assert got["none"].tokens == 0 and "zz" not in got
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.2)):
        assert abs(got[s].actual_share - share / 0.9) < 0.002
    assert all(r.repeats <= {"a": 3, "b": 1, "c": 2}[r.source] for r in m.collect())
    assert rows(m) == rows(mixing.mix(df, targets))
    capped = {r.source: r for r in mixing.shares(mixing.mix(df, targets, total=10**9), targets).collect()}
    assert capped["b"].most_repeats == 1 and capped["a"].most_repeats == 3
    assert mixing.mix(df.limit(0), targets).count() == 0


# 10. Sentences
CASES = [
    ("Dr. Ruiz met Mr. Li at 9.30 a.m. on Apr. 3. They left.", ["Dr. Ruiz met Mr. Li at 9.30 a.m. on Apr. 3.", "They left."]),
    ('He said "no, not yet!" to us. The log said "ok." We left?! 🙂 Then: v2.1 came.', ['He said "no, not yet!" to us.', 'The log said "ok."', "We left?! 🙂", "Then: v2.1 came."]),
    ("“Stop it. Then wait,” she wrote. (It works. Really.) Fine", ["“Stop it. Then wait,” she wrote.", "(It works. Really.)", "Fine"]),
    ("他写道：“先停下。然后检查。”再离开了。真奇怪！等等……会话还在a.md里。", ["他写道：“先停下。然后检查。”再离开了。", "真奇怪！", "等等……会话还在a.md里。"]),
    ("「止めて。見ます。」と書いた。本当に？はい", ["「止めて。見ます。」と書いた。", "本当に？", "はい"]),
    ("पहला वाक्य। दूसरा वाक्य है। क्यों?", ["पहला वाक्य।", "दूसरा वाक्य है।", "क्यों?"]),
    ("ระบบพบดัชนี เราสร้างแคช", ["ระบบพบดัชนี", "เราสร้างแคช"]),
    ("# Title\n\n- first item. And more\n- second\n\nuser: hi there. ok\nagent: z. B. so, d. h. gut.\n", ["# Title", "- first item.", "And more", "- second", "user: hi there.", "ok", "agent: z. B. so, d. h. gut."]),
    ("One line\nwrapped here. Next line\nis on.", ["One line\nwrapped here.", "Next line\nis on."]),
    ("Наш кадр весит ок. 3 МБ и т. п. В 8 г. новый кэш! См. рис. 4.", ["Наш кадр весит ок. 3 МБ и т. п.", "В 8 г. новый кэш!", "См. рис. 4."]),
    ("¡Nadie vio! ¿Dónde está? El Sr. X. Paz cita el núm. 3, p. ej. a.rs.", ["¡Nadie vio!", "¿Dónde está?", "El Sr. X. Paz cita el núm. 3, p. ej. a.rs."]),
    ("done cleanly.Nobody asked about Kadex.Fepim today.", ["done cleanly.", "Nobody asked about Kadex.Fepim today."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    at = sentences.sentence_starts(text)
    assert [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])] == want


def test_chunks_compose_to_the_whole(spark):
    text = "".join(f'The "odd one. Not two" ran on v1.{i} (see p. {i}. Or not) for Dr. Li. Was it {i}? ' for i in range(300)) + "「あ。い。」と。" * 200
    numbered = "\n".join(f"{i % 900 + 1}. Item {i} is here. It has two sentences" for i in range(700))
    wrapped = "\n".join(f"{i}. is wrapped" for i in range(60))
    quote = "He said “" + "Stop here now. " * 220 + "Done,” and left. Then: „erst. dann“ kam. Ein “zweites” Zeichen."
    mixed = f"{numbered}\r\n\r\nText {wrapped}\n\n{quote}\n\n   \n{quote} A \"b. c\" d. \"e. f\n\ng. H"
    texts = {1: text, 2: numbered, 3: quote, 4: mixed, 5: " \n" * 900 + "Late. Text", 6: "Ends here. " + "\n" * 2000, 7: "." * 3000, 8: "Short. One."}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, key bigint")
    whole = {i: sentences.sentence_starts(t) for i, t in texts.items()}
    assert len(whole[2]) == 1400  # every item begins a unit, and so does each further sentence
    assert len(whole[3]) == 3  # a quotation inside a sentence belongs to it, however long it is
    for chunk in (70, 1111, 10**6):
        got = {}
        for r in sentences.units(df, chunk=chunk).collect():
            got.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end, r.sent_no))
        for i, t in texts.items():
            at = whole[i]
            assert sorted(got[i]) == [(p, p + len(t[p:q].rstrip()), k) for k, (p, q) in enumerate(zip(at, [*at[1:], len(t)]))], (chunk, i)


@pytest.mark.parametrize("size", [32767, 32769])
def test_no_size_has_rules_of_its_own(spark, size):
    text = "\n".join(f"{i % 900 + 1}. Entry {i} was read" for i in range(2000))[:size]
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r.sent_start for r in sentences.units(df).orderBy("sent_start").collect()] == sentences.sentence_starts(text)
    assert len(sentences.sentence_starts(text)) == text.count("\n") + 1


def test_units_dirty_rows(spark):
    big = "This is one. " * 9000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "One. Two.", "x"), (4, "One. Two.", "x"), (5, big, "x"), (None, "Hm", "x")], "doc_id bigint, text string, sent_start string")
    got = sentences.units(df)
    count = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert count == {4: 4, 5: 9000, None: 1}
    assert sentences.units(df.limit(0)).count() == 0
