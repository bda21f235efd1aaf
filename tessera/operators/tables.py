"""Tables in documents: column types, detection of sheets' tables, merging over pages, row chunks, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_types(cells: DataFrame, sample: int = 100) -> DataFrame:
    """(table_id, col, value_type): the majority type of the first ``sample`` data rows; mixed if others reach 30 %.

    ``cells`` has table_id, row, col, value; empty cells do not count.
    """
    c = cells.where(F.col("row") < sample).where(F.trim("value") != "")
    kind = (
        F.when(F.expr("try_cast(replace(value, ',', '') as double) is not null"), "number")
        .when(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}"), "date")
        .when(F.lower("value").isin("true", "false", "yes", "no"), "boolean")
        .otherwise("text")
    )
    counts = c.groupBy("table_id", "col", kind.alias("kind")).agg(F.count("*").alias("n"))
    best = counts.groupBy("table_id", "col").agg(F.max_by(F.struct("kind", "n"), F.struct("n", "kind")).alias("b"), F.sum("n").alias("all"))
    other = F.col("all") - F.col("b.n")
    return best.select("table_id", "col", F.when((other > 0) & (other >= F.ceil(F.col("all") * 0.3)), "mixed").otherwise(F.col("b.kind")).alias("value_type"))


def header_similarity(left, right):
    """Share of columns whose names are equal (1) or contain one another (.5), null for different numbers of columns."""
    pair = F.zip_with(left, right, lambda a, b: F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).when(F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a)), 0.5).otherwise(0.0))
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), F.aggregate(pair, F.lit(0.0), lambda s, x: s + x) / F.size(left))


def merge_candidates(tables: DataFrame, least: float = 0.8, gap: int = 2) -> DataFrame:
    """(left_id, right_id, similarity): tables of one source that may go on over a page break.

    ``tables`` has table_id, source, page_start, page_end, headers. Joined on source and the page a table must begin on,
    so only tables close to each other meet.
    """
    step = F.explode(F.sequence(F.lit(1), F.lit(gap)))
    a = tables.select(F.col("table_id").alias("left_id"), "source", F.col("headers").alias("lh"), "page_end").select("*", step.alias("s")).withColumn("page", F.col("page_end") + F.col("s"))
    b = tables.select(F.col("table_id").alias("right_id"), "source", F.col("headers").alias("rh"), F.col("page_start").alias("page"))
    both = a.join(b, ["source", "page"]).where("left_id <> right_id").withColumn("similarity", header_similarity(F.col("lh"), F.col("rh")))
    return both.where(F.col("similarity") >= least).select("left_id", "right_id", "similarity")


def sheet_rows(sheets: DataFrame) -> DataFrame:
    """(sheet_id, row_no, line) of sheet texts, line ends of either kind, blank lines left out."""
    lines = sheets.select("sheet_id", F.posexplode(F.split("text", r"\r?\n")).alias("row_no", "line"))
    return lines.where(F.trim("line") != "")


def row_chunks(sheets: DataFrame, most: int = 1200, limit: int = 500) -> DataFrame:
    """(sheet_id, chunk_no, text): rows packed in order up to ``most`` bytes, the title and header rows repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b.sheet_id, b.text):
                lines = [x for x in (t or "").splitlines() if x.strip()]
                head, body = lines[:2], lines[2:]
                prefix = "\n".join(head)
                held, size, number = [], len(prefix.encode()), 0
                for line in [*body, None]:
                    if held and (line is None or size + len(line.encode()) + 1 > most):
                        if number < limit:
                            out.append((i, number, "\n".join([prefix, *held])))
                        number, held, size = number + 1, [], len(prefix.encode())
                    if line is not None:
                        held.append(line)
                        size += len(line.encode()) + 1
            yield pd.DataFrame(out, columns=["sheet_id", "chunk_no", "text"])

    return sheets.select("sheet_id", "text").mapInPandas(run, "sheet_id bigint, chunk_no bigint, text string")


def csv_line(*columns):
    """One RFC 4180 line of the columns: quoted where needed, quotes doubled, nulls empty."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
    out = quoted[0]
    for q in quoted[1:]:
        out = F.concat(out, F.lit(","), q)
    return out
