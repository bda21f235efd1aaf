"""Structure of texts: headings, lists, code, tables, paragraphs; chunks that respect it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

HEADING = re.compile(r"^(#{1,6})\s+\S")
ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+\S")
RULE = re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$")
TABLE = re.compile(r"^\s*\|.*\|\s*$|^[^|\n]+\|[^|\n]+(?:\|[^|\n]*)*$")
DIVIDER = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
FENCE = re.compile(r"^\s*(```|~~~)")


def elements(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of every element in order; kinds: heading, list, code, table, rule, paragraph."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line), line.rstrip("\r\n")))
        at += len(line)
    out: list[tuple[str, int, int]] = []
    i = 0
    while i < len(lines):
        a, b, s = lines[i]
        j = i + 1
        if not s.strip():
            i = j
            continue
        fence = FENCE.match(s)
        if fence:
            while j < len(lines) and not lines[j][2].lstrip().startswith(fence[1]):
                j += 1
            j, kind = min(j + 1, len(lines)), "code"
        elif HEADING.match(s):
            kind = "heading"
        elif RULE.match(s):
            kind = "rule"
        elif TABLE.match(s) and j < len(lines) and (DIVIDER.match(lines[j][2]) or TABLE.match(lines[j][2])):
            while j < len(lines) and (TABLE.match(lines[j][2]) or DIVIDER.match(lines[j][2])):
                j += 1
            kind = "table"
        elif ITEM.match(s):
            while j < len(lines) and (ITEM.match(lines[j][2]) or (lines[j][2].startswith((" ", "\t")) and lines[j][2].strip())):
                j += 1
            kind = "list"
        else:
            while j < len(lines) and lines[j][2].strip() and not (HEADING.match(lines[j][2]) or FENCE.match(lines[j][2]) or ITEM.match(lines[j][2]) or RULE.match(lines[j][2])):
                j += 1
            kind = "paragraph"
        out.append((kind, a, lines[j - 1][1]))
        i = j
    return out


def structural_chunks(text: str, most: int = 1200) -> list[str]:
    """Chunks of at most ``most`` characters where elements allow it.

    A heading opens a chunk and goes with what follows; rules end one; a table that is too long is cut between rows,
    its header repeated; long code and paragraphs are cut between lines, a single line stays whole.
    """
    out: list[str] = []
    held = ""

    def flush() -> None:
        nonlocal held
        if held.strip():
            out.append(held.strip("\n"))
        held = ""

    for kind, a, b in elements(text):
        part = text[a:b]
        if kind in ("heading", "rule"):
            flush()
            held = part if kind == "heading" else ""
            continue
        if len(held) + len(part) <= most:
            held += part
            continue
        lines = part.splitlines(keepends=True)
        head = ""
        if kind == "table":
            head = "".join(lines[: 2 if len(lines) > 1 and DIVIDER.match(lines[1]) else 1])
            if held and not HEADING.match(held.splitlines()[-1]):
                flush()
        elif len(part) <= most:
            flush()
            held = part
            continue
        for n, line in enumerate(lines):
            if held and len(held) + len(line) > most:
                flush()
                held = head if head and n >= head.count("\n") else ""
            held += line
        if kind == "table":
            flush()
    flush()
    return out


ELEMENTS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())]))


@pandas_udf(ELEMENTS)
def structure(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "start": a, "stop": b} for k, a, b in elements(t)] if t else [])


@pandas_udf(ArrayType(StringType()))
def structured(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: structural_chunks(t) if t else [])
