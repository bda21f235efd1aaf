"""Document readers: format inference and text extraction from binary files, in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extraction stops after this many characters, and says so: a budget that does not depend on the machine's speed.
BUDGET = 10_000_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def file_format(content: Column, path: Column, mime: Column | None = None) -> Column:
    """pdf, docx, pptx, xlsx, xls or text: by magic bytes first, then the mime type if given, then the name."""
    head, low = F.substring(content, 1, 4), F.lower(path)
    kind = F.coalesce(F.lower(mime), F.lit("")) if mime is not None else F.lit("")
    zipped = head == F.unhex(F.lit("504B0304"))
    return (
        F.when(head == F.unhex(F.lit("25504446")), "pdf")
        .when(zipped & low.endswith(".docx"), "docx")
        .when(zipped & low.endswith(".pptx"), "pptx")
        .when(zipped & (low.endswith(".xlsx") | low.endswith(".xlsm")), "xlsx")
        .when(kind == "application/pdf", "pdf")
        .when(kind == "application/vnd.ms-excel", "xls")
        .when(low.endswith(".xls"), "xls")
        .otherwise("text")
    )


def docx_text(data: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in root.iter(f"{W}p")).strip()


def pptx_text(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    parts = []
    for n in slides:
        root = ElementTree.fromstring(z.read(n))
        parts.append("\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in root.iter(f"{A}p")).strip())
    return "\n\n".join(p for p in parts if p)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of every sheet."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out = []
    for name, file in zip(names, files):
        rows = []
        for r in ElementTree.fromstring(z.read(file)).iter(f"{S}row"):
            cells: list[str] = []
            for c in r.iter(f"{S}c"):
                v = c.find(f"{S}v")
                text = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                at = _column(c.get("r", "A")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells)) + [shared[int(text)] if c.get("t") == "s" and text else text]
            rows.append(cells)
        out.append((name, rows))
    return out


def xlsx_text(data: bytes) -> str:
    """Sheets as lines: a title, the header, and rows written as 'header: value' pairs."""
    parts = []
    for name, rows in xlsx_sheets(data):
        rows = [r for r in rows if any(c.strip() for c in r)]
        head = rows[0] if rows else []
        lines = [f"[Sheet: {name}]", " | ".join(head)]
        lines += [" | ".join(f"{head[i] if i < len(head) else i}: {c}" for i, c in enumerate(r) if c.strip()) for r in rows[1:]]
        parts.append("\n".join(lines))
    return "\n\n".join(parts)


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "text": plain_text}


def register(kind: str, reader: Callable[[bytes], str]) -> None:
    """Adds a reader for a format; the function travels to the executors with the query."""
    READERS[kind] = reader


def extract(files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(path, format, text, complete, problem) of (path, content) rows. Equal contents are read once.

    A format without a reader, and a file that its reader cannot read, give null text and the reason.
    """
    readers = dict(READERS)
    kinds = files.select("path", "content", file_format(F.col("content"), F.col("path")).alias("format"), F.sha2("content", 256).alias("hash"))
    once = kinds.groupBy("hash", "format").agg(F.first("content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, kind, data in zip(b["hash"], b["format"], b["content"]):
                try:
                    text = readers[kind](bytes(data))
                    out.append((h, kind, text[:budget], len(text) <= budget, None))
                except KeyError:
                    out.append((h, kind, None, False, f"no reader for {kind}"))
                except Exception as e:  # a broken file is a row, not a failed job
                    out.append((h, kind, None, False, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["hash", "format", "text", "complete", "problem"])

    read = once.mapInPandas(run, "hash string, format string, text string, complete boolean, problem string")
    return kinds.select("path", "format", "hash").join(read, ["hash", "format"]).drop("hash")


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder, recursively, as extracted texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return extract(files.select("path", "content"))
