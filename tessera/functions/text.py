"""Text functions: tokenisers, masking, tags, dates, previews, chunking and the like.

Column functions stay inside code generation; what SQL cannot express is an Arrow-batched function over one column.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

PREVIEW, TEXT_LIMIT = 120, 32768
CHUNK_TARGET, CHUNK_LEAST = 1200, 2400
SECTION_SOFT, SECTION_HARD = 900, 1400

# Patterns of personal data and secrets, in the order in which they are masked.
MASKS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN]"),
    (r"\b(?:\d{4}[-\s]?\d{6}[-\s]?\d{5}|\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}|\d{15,16})\b", "[CREDIT_CARD]"),
    (r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\b\d{3}[-.\s]\d{4}\b|\b\d{10}\b", "[PHONE]"),
    (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "[IP_ADDRESS]"),
    (r"(?i)\b(?:sk_live_[a-zA-Z0-9]{24,}|pk_test_[a-zA-Z0-9]{24,}|ghp_[a-zA-Z0-9]{36}|gho_[a-zA-Z0-9]{36}|AKIA[A-Z0-9]{16}|api[-_]?key[:=]\s*['\"]?[a-zA-Z0-9_\-]{20,}['\"]?)\b", "[API_KEY]"),
    (r"\b[A-Za-z0-9_\-]{40,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\b", "[TOKEN]"),
]

# Words that carry no content in a question.
STOP_WORDS = set(
    """a an and are as at be been being but by does do did else for from had have has he her here hers him his how i if in is it its it's many me mine more
    most much my no not of on or our ours she so that the their them there these they this those through to us was we were what when where which who whom why with you
    your yours""".split()
)


# Words that are no keywords of a text.
KEYWORD_STOPS = set(
    """the and for with that from this were have has will shall into about without within between because over under after before until while their there these those your such been
    where when which using also than could would should might cannot however therefore thereof hereby herein hereof based system application service provide provided including
    include includes version update updates usage""".split()
)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def lex_tokens(text: Column) -> Column:
    """Tokens of the fallback index: letters, digits and & @ + / _, with at least one letter or digit."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}&@+/_]+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def sketch_tokens(text: Column) -> Column:
    """Tokens of sketches: at least two bytes long."""
    return F.filter(tokens(text), lambda t: F.octet_length(t) >= 2)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a lower-case word in the lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("bigint")


def mask(text: Column) -> Column:
    """Personal data replaced by placeholders, pattern after pattern."""
    for pattern, name in MASKS:
        text = F.regexp_replace(text, pattern, name)
    return text


def has_personal_data(text: Column) -> Column:
    found = F.lit(False)
    for pattern, _ in MASKS:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW)


def media_preview(text: Column, caption: Column, summary: Column) -> Column:
    """What is shown of a frame: an image's caption, else a video's summary, else the head of its text."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(caption), filled(summary), preview(text))


def merge_unique(first: Column, second: Column) -> Column:
    """The values of two arrays in their order, each once."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))


def rfc3339(ts: Column) -> Column:
    """Unix seconds as a time in UTC, like 2024-05-03T10:00:00Z, whatever the session's zone is."""
    return F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def latest_content_date(written: Column) -> Column:
    """The latest of an array of written dates, in unix seconds; null if none can be read."""
    return F.array_max(F.transform(written, content_date))


def base_uri(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def default_uri(frame_id: Column) -> Column:
    return F.concat(F.lit("mem://frames/"), frame_id.cast("string"))


def inferred_title(uri: Column) -> Column:
    """The stem of the last path segment of a uri; null if it is empty."""
    last = F.regexp_extract(base_uri(uri), r"([^/]+)/*$", 1)
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    return F.nullif(F.when(stem == "", last).otherwise(stem), F.lit(""))


def keywords(text: Column) -> Column:
    """Lower-case words and numbers of three characters and more that are no stop words of keywords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9'-]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(sorted(KEYWORD_STOPS)))


def label_lines(text: Column) -> Column:
    """Up to six heading-like lines (capitalised, at most six words), sorted."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: x.rlike(r"^[A-Z][A-Za-z0-9 &/-]{3,}$") & (F.size(F.split(x, r"\s+")) <= 6))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, 6)


def date_mentions(text: Column) -> Column:
    """Years, ISO, US, spelled and European dates as written, sorted and distinct."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
    t = F.coalesce(text, F.lit(""))
    found = [
        F.regexp_extract_all(t, F.lit(r"\b((?:19|20)\d{2})\b"), 1),
        F.regexp_extract_all(t, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1),
        F.regexp_extract_all(t, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), 1),
        F.regexp_extract_all(t, F.lit(rf"\b((?:{months})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})\b"), 1),
        F.regexp_extract_all(t, F.lit(rf"\b(\d{{1,2}} (?:{months}) \d{{4}})\b"), 1),
    ]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def augmented(text: Column, title: Column, uri: Column, track: Column, labels: Column) -> Column:
    """The text with its metadata as lines, as it is indexed; missing parts are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", text, part("title", title), part("uri", uri), part("track", track), part("labels", F.array_join(labels, " ")))


def content_date(written: Column) -> Column:
    """Unix seconds of a date as people write it: ISO with or without time, Y/M/D, spelled (ordinals too), European, a bare year."""
    t = F.regexp_replace(F.trim(written), r"(\d)(?:st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\([A-Za-z]+\)", ""), r"[,.]", "")
    forms = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy-MM-dd", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]
    parsed = [F.unix_seconds(F.try_to_timestamp(t, F.lit(f))) for f in forms]
    year = F.when(t.rlike(r"^(?:19|20)\d{2}$|^2100$"), F.unix_seconds(F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd"))))
    return F.coalesce(*parsed, year)


def value_type(value: Column) -> Column:
    """number, datetime, boolean or string, by what the whole value can be read as."""
    return (
        F.when(value.try_cast("double").isNotNull(), "number")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), "datetime")
        .when(F.lower(value).isin("true", "false", "yes", "no"), "boolean")
        .otherwise("string")
    )


def index_eligible(text: Column, mime: Column, most_bytes: int = 10_000_000) -> Column:
    """Whether a frame is indexed: some text, of a text type, not too large."""
    return F.coalesce((F.trim(text) != "") & (F.coalesce(mime, F.lit("text/plain")).startswith("text/")) & (F.octet_length(text) <= most_bytes), F.lit(False))


def worthwhile_image(width: Column, height: Column, variance: Column) -> Column:
    """Whether an image is more than an icon, a line or a flat colour."""
    short, long = F.least(width, height), F.greatest(width, height)
    return F.coalesce(width.isNotNull() & height.isNotNull() & (short >= 64) & (long / short <= 10) & (variance >= 0.01), F.lit(False))


def normalise_text(text: str | None, limit: int = TEXT_LIMIT) -> str | None:
    """NFKC, plain spaces and single newlines, no control characters, at most ``limit`` bytes; None if nothing is left."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    t = "".join(c for c in t if c == "\n" or unicodedata.category(c) != "Cc")
    t = re.sub(r"[  ]+", " ", t)
    t = re.sub(r" ?\n[ \n]*", "\n", t).strip()
    return t[: truncation_point(t, limit)] or None


def truncation_point(text: str, limit: int) -> int:
    """Characters of the longest prefix of whole grapheme clusters within ``limit`` bytes of UTF-8."""
    if len(text.encode()) <= limit:
        return len(text)
    import regex

    used = end = 0
    for m in regex.finditer(r"\X", text):
        used += len(m.group().encode())
        if used > limit:
            break
        end = m.end()
    return end


@pandas_udf(StringType())
def normalised(texts: pd.Series) -> pd.Series:
    return texts.map(normalise_text)


BREAK = re.compile(r"[.!?…。！？]['\"”»)\]]*(?=\s)|\n")


def section_spans(text: str) -> list[tuple[int, int]]:
    """Sections of about 900 and at most 1,400 characters that end at sentence ends or newlines where there is one."""
    out, at = [], 0
    while at < len(text):
        stop = min(at + SECTION_HARD, len(text))
        if len(text) - at > SECTION_HARD:
            m = BREAK.search(text, at + SECTION_SOFT, stop)
            if m:
                stop = m.end()
            else:
                space = text.rfind(" ", at + SECTION_SOFT, stop)
                stop = space + 1 if space > 0 else stop
        elif len(text) - at > SECTION_SOFT:
            m = BREAK.search(text, at + SECTION_SOFT, len(text))
            stop = m.end() if m else len(text)
        out.append((at, stop))
        at = stop
    return out


def chunk_spans(text: str, target: int = CHUNK_TARGET) -> list[tuple[int, int]]:
    """Chunks of a text of at least 2,400 characters: near ``target``, at a newline, sentence end or space close to it."""
    if len(text) < CHUNK_LEAST:
        return []
    slack, out, at = max(target // 5, 32), [], 0
    while at < len(text):
        aim = at + target
        if aim + slack >= len(text):
            out.append((at, len(text)))
            break
        low, high = max(at + 1, aim - slack), min(len(text), aim + slack)
        line = text.find("\n", aim, high)
        if line >= 0:
            stop = line + 1
        else:
            ends = [m.end() for m in BREAK.finditer(text, low, high)]
            spaces = [m.end() for m in re.compile(r"\s").finditer(text, low, high)]
            near = ends or spaces
            stop = min(near, key=lambda x: abs(x - aim)) if near else aim
        out.append((at, stop))
        at = stop
    return out


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))


@pandas_udf(SPANS)
def sections(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "stop": b} for a, b in section_spans(t)] if t else [])


@pandas_udf(SPANS)
def chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "stop": b} for a, b in chunk_spans(t)] if t else [])


def snippet_spans(text: str, words: list[str], window: int = 160, gap: int = 20) -> list[tuple[int, int]]:
    """Windows around the words, widened to sentence ends and merged where they nearly touch; the head if none is there."""
    low, spans = text.lower(), []
    for w in words:
        at = low.find(w) if w else -1
        while at >= 0:
            spans.append((at, at + len(w)))
            at = low.find(w, at + len(w))
    if not spans:
        return [(0, min(len(text), window))] if text else []
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        start, stop = max(0, a - window // 2), min(len(text), b + window // 2)
        before = [m.end() for m in BREAK.finditer(text, max(0, start - window // 2), a)]
        after = BREAK.search(text, b, min(len(text), stop + window // 2))
        start = max(before) if before and max(before) <= a else start
        stop = after.end() if after else stop
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def snippets(words: list[str], window: int = 160):
    """An Arrow function from text to its snippet spans for fixed words."""

    @pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b} for a, b in snippet_spans(t, words, window)] if t else [])

    return run


SMALL = {"a", "i", "an", "as", "at", "be", "by", "do", "go", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we"}


def fix_spacing(text: str | None) -> str | None:
    """Joins words that an extractor broke into runs of very short fragments; common short words stay apart."""
    if not text:
        return text
    out: list[str] = []
    for word in text.split(" "):
        short = word.isalpha() and len(word) <= 2 and word.lower() not in SMALL
        if out and short and out[-1].isalpha() and (len(out[-1]) <= 3 and out[-1].lower() not in SMALL):
            out[-1] += word
        else:
            out.append(word)
    return " ".join(out)
