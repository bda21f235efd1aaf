"""Sinks: Parquet stores with snapshots, CSV and JSON exports, encrypted columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import csv_line


def write_store(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames as Parquet by day, so that time bounds prune folders."""
    frames.withColumn("day", F.to_date(F.timestamp_seconds("ts"))).write.mode(mode).partitionBy("day").parquet(path)


def open_snapshot(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The store, or a pinned list of its files as of an earlier read."""
    return spark.read.option("basePath", path).parquet(*files) if files else spark.read.parquet(path)


def snapshot_files(store: DataFrame) -> list[str]:
    """The files a snapshot is made of: one entry a file, not a row."""
    return sorted(store.inputFiles())


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(csv_line(*[F.col(c) for c in rows.columns]).alias("line"))


def json_records(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def xlsx_bytes(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook of text cells as an XLSX file."""
    import io
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    def letters(n: int) -> str:
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        names = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}"/>' for i, (name, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets>{names}</sheets></workbook>')
        for i, (_, rows) in enumerate(sheets, 1):
            cells = lambda r, row: "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v)
            body = "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return held.getvalue()


def audit_markdown(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """(report_id, markdown): each report (report_id, question, answer) with its sources (report_id, cite_index, title,
    uri) as a numbered list; a report without an answer says so."""
    line = F.concat(F.col("cite_index").cast("string"), F.lit(". "), F.coalesce("title", F.lit("untitled")), F.lit(" ("), F.coalesce("uri", F.lit("no uri")), F.lit(")"))
    lists = sources.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("cite_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("_sources"))
    head = F.concat(F.lit("# "), F.coalesce("question", F.lit("")), F.lit("\n\n"), F.coalesce("answer", F.lit("No answer was found.")))
    return reports.join(lists, "report_id", "left").select("report_id", F.concat(head, F.when(F.col("_sources").isNotNull(), F.concat(F.lit("\n\n## Sources\n\n"), F.col("_sources"))).otherwise("")).alias("markdown"))


def derive_key(password: str, salt: bytes) -> bytes:
    """A 256-bit key from a password by scrypt, on the driver."""
    return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32)


def encrypted(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    """The column as AES-256-GCM ciphertext, base64."""
    return rows.withColumn(column, F.base64(F.aes_encrypt(F.col(column), F.lit(key), F.lit("GCM"))))


def decrypted(rows: DataFrame, column: str, key: bytes, strict: bool = True) -> DataFrame:
    """The column in clear; a wrong key or a changed ciphertext raises, or with ``strict`` off gives null."""
    opened = F.aes_decrypt if strict else F.try_aes_decrypt
    return rows.withColumn(column, opened(F.unbase64(column), F.lit(key), F.lit("GCM")).cast("string"))
