"""Splitting oversized items at natural boundaries by pointer doubling over successor tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MAX_CHUNKS = 1200, 500
ROW_END = re.compile(r"\r\n|\n")
SENTENCE_END = re.compile(r"[.!?…؟۔।]+[\"'”’»)\]]*\s+|[。！？｡][」』”’）]*\s*")
SPACE = re.compile(r"\s+")


def inner_places(row: str, room: int) -> list[np.ndarray]:
    """Sentence starts, word starts, graphemes and other places inside a long row at which a piece may be cut.

    Graphemes are those of stretches without a word start that are longer than ``room``, the other places those inside a
    grapheme that is longer itself.
    """
    sentence = np.array([m.end() for m in SENTENCE_END.finditer(row)], dtype=np.int64)
    word = np.array([m.end() for m in SPACE.finditer(row)], dtype=np.int64)
    grapheme: list[int] = []
    other: list[int] = []
    stops = np.unique(np.concatenate([[0], word, [len(row)]]))
    for i in np.flatnonzero(np.diff(stops) > room):
        at = int(stops[i])
        for m in regex.finditer(r"\X", row[at : int(stops[i + 1])]):
            grapheme.append(at + m.end())
            if m.end() - m.start() > room:
                other += range(at + m.start() + 1, at + m.end())
    return [sentence, word, np.array(grapheme, dtype=np.int64), np.array(other, dtype=np.int64)]


def farthest(places: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The last of the sorted places that is not beyond each reach, -1 if there is none."""
    at = np.searchsorted(places, reach, side="right") - 1
    return np.where(at >= 0, np.append(places, 0)[at], -1)


def boundaries(text: str, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, piece start or -1 for none, piece end, successor node index, cut inside a row) of every boundary of one text.

    Boundaries are the row starts, and inside rows longer than ``most`` sentence starts, word starts and, where these are
    too far apart, graphemes. The successor of a boundary is the start of the row after the last row that still ends
    within ``most`` of the piece's start. Where that row alone is too long, it is the farthest sentence start within
    reach if that is at least half way, else the farthest word start, else the farthest grapheme. The overlap shrinks
    where the first row after a cut would not fit beside it, since a row that fits is never cut.
    """
    ends = [(m.start(), m.end()) for m in ROW_END.finditer(text)]
    end = np.array([a for a, _ in ends] + [len(text)], dtype=np.int64)
    start = np.array([0] + [b for _, b in ends], dtype=np.int64)
    length = end - start
    none = np.empty(0, np.int64)
    kinds = [[none], [none], [none], [none]]
    for s, e in zip(start[length > most].tolist(), end[length > most].tolist()):
        for kind, found in zip(kinds, inner_places(text[s:e], most - overlap)):
            kind.append(found + s)
    places = [np.concatenate(k) for k in kinds]
    node = np.unique(np.concatenate([start, *places]))
    node = node[np.isin(node, start) | ~np.isin(node, end)]
    row = np.searchsorted(start, node, side="right") - 1
    fits = length[row] <= most
    room = np.where(fits, most - length[row], overlap)
    begin = node - np.minimum(np.minimum(overlap, node), np.maximum(room, 0))
    reach = begin + most
    last = np.searchsorted(end, reach, side="right") - 1
    whole = last >= row
    after = np.append(start, len(text) + 1)[np.minimum(last + 1, len(start))]
    by_sentence, by_word, by_grapheme, by_other = (farthest(p, reach) for p in places)
    natural = np.where(by_word > node, by_word, np.where(by_grapheme > node, by_grapheme, by_other))
    natural = np.where(2 * (by_sentence - node) >= reach - node, by_sentence, natural)
    target = np.where(whole, after, natural)
    stop = np.where(whole, end[np.maximum(last, 0)], natural)
    begin = np.where(node >= len(text), -1, begin)  # an empty last row adds nothing
    return node, begin, stop, np.searchsorted(node, target), ~whole


def greedy_cuts(successor: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks every node on the chains from ``starts``: successor tables are squared, all chains advance at once."""
    on = np.zeros(len(successor), dtype=bool)
    on[starts] = True
    jump = successor
    while True:
        new = on.copy()
        new[jump[on]] = True
        if (new == on).all() and (jump == jump[jump]).all():
            return on
        on, jump = new, jump[jump]


def split_batch(texts: list[str], most: list[int], overlap: list[int]) -> pd.DataFrame:
    """All pieces of a batch of texts: item (position in the batch), start, end, inside (ends inside a row)."""
    parts, base, owner, heads = [], 0, [], []
    for i, (t, m, o) in enumerate(zip(texts, most, overlap)):
        m = max(int(m), 1)
        node, begin, stop, succ, inside = boundaries(t, m, min(max(int(o), 0), m - 1))
        n = len(node)
        parts.append((begin, stop, np.where(succ >= n, base + n, base + succ), inside))
        # a last node of its own ends each chain
        parts.append((np.array([-1]), np.array([-1]), np.array([base + n]), np.array([False])))
        owner.append(np.full(n + 1, i))
        heads.append(base)
        base += n + 1
    begin, stop, succ, inside = (np.concatenate(c) for c in zip(*parts))
    on = greedy_cuts(succ, np.array(heads)) & (begin >= 0) & (stop > begin)
    item = np.concatenate(owner)
    return pd.DataFrame({"item": item[on], "start": begin[on], "end": stop[on], "inside": inside[on]})


def split(items: DataFrame, summary: bool = False) -> DataFrame:
    """Pieces of the items (source_table, item_id, text, max_chars, overlap_chars, max_chunks) longer than max_chars.

    Pieces: (source_table, item_id, piece_no, char_start, char_end, piece); each has at most max_chars code points, is
    cut at row ends unless a row alone is longer (that one at sentence starts, else word starts, else graphemes), starts
    overlap_chars before the cut (less where the next row would not fit, at most max_chars - 1), and pieces after the first max_chunks of a text are left out, as asked for. The
    line end at a cut belongs to no piece. With ``summary``: (source_table, item_id, n_chars, n_pieces, n_inside,
    cut_kind) of each oversized item instead: n_inside counts the pieces that end inside a row; cut_kind is capped if
    the text is longer than max_chars * max_chunks, else inside_row if there is such a piece, else between_rows.

    Null text, and texts within the limit, give nothing; null max_chars is 1200, null max_chunks 500, null overlap 0;
    limits under 1 count as 1. Texts are whole, of any length. Rows repeat if items repeat. Other columns are ignored.
    """
    limit = F.greatest(F.coalesce("max_chars", F.lit(MAX_CHARS)), F.lit(1)).cast("bigint")
    chunks = F.greatest(F.coalesce("max_chunks", F.lit(MAX_CHUNKS)), F.lit(1)).cast("bigint")
    big = items.select("source_table", "item_id", "text", limit.alias("most"), F.coalesce("overlap_chars", F.lit(0)).cast("bigint").alias("overlap"), chunks.alias("chunks"))
    big = big.where(F.length("text") > F.col("most"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.iloc[at : at + 256].reset_index(drop=True)
                if b.empty:
                    continue
                texts = b.text.tolist()
                p = split_batch(texts, b.most.tolist(), b.overlap.tolist())
                own = b.loc[p["item"].to_numpy()].reset_index(drop=True)
                number = p.groupby("item").cumcount() + 1
                if summary:
                    n = np.array([len(t) for t in texts])
                    got = p.groupby("item").agg(n_pieces=("start", "size"), inside=("inside", "sum")).reindex(range(len(b)), fill_value=0)
                    kind = np.where(n > b.most * b.chunks, "capped", np.where(got.inside.to_numpy() > 0, "inside_row", "between_rows"))
                    yield pd.DataFrame({"source_table": b.source_table, "item_id": b.item_id, "n_chars": n, "n_pieces": np.minimum(got.n_pieces.to_numpy(), b.chunks), "n_inside": got.inside.to_numpy(), "cut_kind": kind})
                    continue
                out = pd.DataFrame({"source_table": own.source_table, "item_id": own.item_id, "piece_no": number, "char_start": p.start, "char_end": p.end})
                out["piece"] = [texts[i][s:e] for i, s, e in zip(p["item"], p["start"], p["end"])]
                yield out[(number <= own.chunks).to_numpy()]

    if summary:
        return big.mapInPandas(pieces, "source_table string, item_id bigint, n_chars bigint, n_pieces bigint, n_inside bigint, cut_kind string")
    return big.mapInPandas(pieces, "source_table string, item_id bigint, piece_no bigint, char_start bigint, char_end bigint, piece string")


def sheet_items(sheets: DataFrame, spans: DataFrame, options: DataFrame) -> DataFrame:
    """The items of the sheet tables: whole sheets, and the valid byte ranges that spans cite out of them.

    The latest options row (set_at) of a workbook holds. A range counts if it is within the sheet's UTF-8 bytes and not
    empty; ranges that cannot be oversized are left out before the sheets' texts are joined.
    """
    from tessera.runtime import latest, maybe_broadcast

    opts = maybe_broadcast(latest(options.where("workbook_id is not null").select("workbook_id", "max_chars", "max_chunks", "overlap_chars", "set_at"), ["workbook_id"], ["set_at"]).drop("set_at"))
    one = latest(sheets.where("sheet_id is not null").select("sheet_id", "workbook_id", "text", "exported_at"), ["sheet_id"], ["exported_at"]).drop("exported_at").where("text is not null")
    whole = one.join(opts, "workbook_id", "left").select(F.lit("xlsx_sheets").alias("source_table"), F.col("sheet_id").alias("item_id"), "text", "max_chars", "overlap_chars", "max_chunks")
    cites = spans.select("span_id", "uri", F.col("chunk_range.range_start").alias("a"), F.col("chunk_range.range_end").alias("b"), F.regexp_extract("uri", r"workbooks/(\d+)/(\d+)$", 1).alias("w"), F.regexp_extract("uri", r"workbooks/(\d+)/(\d+)$", 2).alias("s"), F.col("frame_id"))
    cites = cites.where("frame_id is null and s <> '' and a >= 0 and b > a and span_id is not null").dropDuplicates(["span_id"]).select("span_id", "a", "b", F.col("w").cast("bigint").alias("workbook_id"), F.col("s").cast("bigint").alias("sheet_id"))
    cites = cites.join(opts, "workbook_id", "left").where(f"b - a > greatest(coalesce(max_chars, {MAX_CHARS}), 1)")
    cited = cites.drop("workbook_id").join(one.select("sheet_id", "text"), "sheet_id").where("b <= octet_length(text)")
    part = F.expr("make_valid_utf8(cast(substring(cast(text as binary), cast(a + 1 as int), cast(b - a as int)) as string))")
    return whole.unionByName(cited.select(F.lit("source_spans").alias("source_table"), F.col("span_id").alias("item_id"), part.alias("text"), "max_chars", "overlap_chars", "max_chunks"))
