"""Time in words: phrases to ranges, mentions in texts, running anchor dates, overlap filters."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1}
NUM = r"(\d+|" + "|".join(NUMBERS) + ")"
DAY = "(" + "|".join(DAYS) + ")"
CERTAIN, RELATIVE, VAGUE = 950, 900, 700

Range = tuple[datetime, datetime, int]


def _number(text: str) -> int:
    return NUMBERS[text] if text in NUMBERS else int(text)


def _day(d: date, confidence: int = CERTAIN) -> Range:
    start = datetime(d.year, d.month, d.day, tzinfo=timezone.utc)
    return start, start + timedelta(days=1, seconds=-1), confidence


def _days(a: date, b: date, confidence: int) -> Range:
    return _day(a)[0], _day(b)[1], confidence


def _at(d: date, hour: int, minute: int = 0, confidence: int = CERTAIN) -> Range:
    t = datetime(d.year, d.month, d.day, hour, minute, tzinfo=timezone.utc)
    return t, t, confidence


def _months(d: date, n: int) -> date:
    at = d.year * 12 + d.month - 1 + n
    year, month = divmod(at, 12)
    return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


def _month_end(d: date) -> date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


def _after(d: date, weekday: int) -> date:
    return d + timedelta(days=(weekday - d.weekday() - 1) % 7 + 1)


def _before(d: date, weekday: int) -> date:
    return d - timedelta(days=(d.weekday() - weekday - 1) % 7 + 1)


def _hour(hour: str, half: str | None) -> int:
    h = int(hour)
    return h % 12 + (12 if half == "pm" else 0) if half else h


def _quarter(year: int, q: int, confidence: int = CERTAIN) -> Range:
    first = date(year, 3 * q - 2, 1)
    return _days(first, _month_end(_months(first, 2)), confidence)


def _business(d: date) -> date:
    first = _months(d.replace(day=1), 1)
    while first.weekday() > 4:
        first += timedelta(days=1)
    return first


def _dst(d: date) -> Range:
    first = date(d.year, 11, 1)
    return _at(first + timedelta(days=(6 - first.weekday()) % 7), 1)


def _week(d: date, n: int) -> Range:
    monday = d - timedelta(days=d.weekday()) + timedelta(weeks=n)
    return _days(monday, monday + timedelta(days=6), RELATIVE)


def _month(d: date, n: int) -> Range:
    first = _months(d.replace(day=1), n)
    return _days(first, _month_end(first), RELATIVE)


def _slash(a: int, b: int, year: int) -> Range:
    year += 2000 if year < 100 else 0
    if a > 12:
        a, b = b, a
    return _day(date(year, a, b), VAGUE if a <= 12 and b <= 12 and a != b else CERTAIN)


# What a phrase means, given the moment and the match.
PHRASES: list[tuple[str, Callable[[datetime, re.Match], Range]]] = [
    (r"today", lambda n, m: _day(n.date())),
    (r"yesterday", lambda n, m: _day(n.date() - timedelta(days=1))),
    (r"tomorrow", lambda n, m: _day(n.date() + timedelta(days=1))),
    (rf"in {NUM} days?|{NUM} days? from now", lambda n, m: _day(n.date() + timedelta(days=_number(m[1] or m[2])), RELATIVE)),
    (rf"{NUM} days? ago", lambda n, m: _day(n.date() - timedelta(days=_number(m[1])), RELATIVE)),
    (rf"in {NUM} weeks?|{NUM} weeks? from now", lambda n, m: _day(n.date() + timedelta(weeks=_number(m[1] or m[2])), RELATIVE)),
    (rf"{NUM} weeks? ago", lambda n, m: _day(n.date() - timedelta(weeks=_number(m[1])), RELATIVE)),
    (rf"in {NUM} months?", lambda n, m: _day(_months(n.date(), _number(m[1])), RELATIVE)),
    (rf"{NUM} months? ago", lambda n, m: _day(_months(n.date(), -_number(m[1])), RELATIVE)),
    (rf"in {NUM} years?", lambda n, m: _day(_months(n.date(), 12 * _number(m[1])), RELATIVE)),
    (rf"{NUM} years? ago", lambda n, m: _day(_months(n.date(), -12 * _number(m[1])), RELATIVE)),
    (rf"in {NUM} minutes?", lambda n, m: (n + timedelta(minutes=_number(m[1])),) * 2 + (CERTAIN,)),
    (rf"in {NUM} hours?", lambda n, m: (n + timedelta(hours=_number(m[1])),) * 2 + (CERTAIN,)),
    (rf"in the last {NUM} hours?", lambda n, m: (n - timedelta(hours=_number(m[1])), n, RELATIVE)),
    (rf"{NUM} {DAY}s ago", lambda n, m: _day(_before(n.date(), DAYS.index(m[2])) - timedelta(weeks=_number(m[1]) - 1))),
    (rf"on the {DAY} after next", lambda n, m: _day(_after(n.date(), DAYS.index(m[1])) + timedelta(days=7))),
    (rf"next {DAY}", lambda n, m: _day(_after(n.date(), DAYS.index(m[1])))),
    (rf"last {DAY}", lambda n, m: _day(_before(n.date(), DAYS.index(m[1])))),
    (rf"(?:this )?{DAY}", lambda n, m: _day(n.date() - timedelta(days=n.date().weekday()) + timedelta(days=DAYS.index(m[1])))),
    (rf"noon next {DAY}", lambda n, m: _at(_after(n.date() + timedelta(days=6 - n.date().weekday()), DAYS.index(m[1])), 12)),
    (rf"next {DAY} at (\d{{1,2}})(?::(\d{{2}}))? ?(am|pm)?", lambda n, m: _at(_after(n.date(), DAYS.index(m[1])), _hour(m[2], m[4]), int(m[3] or 0))),
    (rf"{DAY} at (\d{{1,2}})(?::(\d{{2}}))? ?(am|pm)?", lambda n, m: _at(n.date() + timedelta(days=(DAYS.index(m[1]) - n.date().weekday()) % 7), _hour(m[2], m[4]), int(m[3] or 0))),
    (r"at (\d{1,2})(?::(\d{2}))? ?(am|pm)? today", lambda n, m: _at(n.date(), _hour(m[1], m[3]), int(m[2] or 0))),
    (r"today at (\d{1,2})(?::(\d{2}))? ?(am|pm)?", lambda n, m: _at(n.date(), _hour(m[1], m[3]), int(m[2] or 0))),
    (r"this morning", lambda n, m: (_at(n.date(), 6)[0], _at(n.date(), 11, 59)[0] + timedelta(seconds=59), CERTAIN)),
    (r"midnight tomorrow", lambda n, m: _at(n.date() + timedelta(days=1), 0)),
    (r"next week", lambda n, m: _week(n.date(), 1)),
    (r"last week", lambda n, m: _week(n.date(), -1)),
    (r"this week", lambda n, m: _week(n.date(), 0)),
    (r"next month", lambda n, m: _month(n.date(), 1)),
    (r"last month", lambda n, m: _month(n.date(), -1)),
    (r"this month", lambda n, m: _month(n.date(), 0)),
    (r"end of this month", lambda n, m: _day(_month_end(n.date()))),
    (r"start of next month", lambda n, m: _day(_months(n.date().replace(day=1), 1))),
    (r"(?:the )?first business day of next month", lambda n, m: _day(_business(n.date()))),
    (r"next daylight saving change", lambda n, m: _dst(n.date())),
    (r"q([1-4]) (\d{4})", lambda n, m: _quarter(int(m[2]), int(m[1]))),
    (r"end of q([1-4])", lambda n, m: _day(_quarter(n.year, int(m[1]))[1].date())),
    (r"(\d{1,2})/(\d{1,2})/(\d{2,4})", lambda n, m: _slash(int(m[1]), int(m[2]), int(m[3]))),
    (r"(\d{4})-(\d{2})-(\d{2})", lambda n, m: _day(date(int(m[1]), int(m[2]), int(m[3])))),
    (r"next year", lambda n, m: _days(date(n.year + 1, 1, 1), date(n.year + 1, 12, 31), RELATIVE)),
    (r"last year", lambda n, m: _days(date(n.year - 1, 1, 1), date(n.year - 1, 12, 31), RELATIVE)),
    (r"(19\d{2}|20\d{2})", lambda n, m: _days(date(int(m[1]), 1, 1), date(int(m[1]), 12, 31), CERTAIN)),
]
COMPILED = [(re.compile(p), f) for p, f in PHRASES]
FOUND = re.compile(r"(?<![\w/.-])(?:" + "|".join(re.sub(r"\((?!\?)", "(?:", p) for p, _ in sorted(PHRASES, key=lambda x: -len(x[0]))) + r")(?![\w/-])", re.I)


class PhraseError(ValueError):
    """The phrase is not understood."""


def resolve(phrase: str, moment: datetime) -> Range:
    """First and last second and confidence of an English phrase at a moment; one instant for clock times."""
    low = re.sub(r"\s+", " ", phrase.strip().lower())
    for pattern, meaning in COMPILED:
        m = pattern.fullmatch(low)
        if m:
            return meaning(moment, m)
    raise PhraseError(f"no meaning for {phrase!r}")


def offset_minutes(zone: str) -> int:
    """Minutes east of UTC of UTC, Z, +HH, +HHMM or +HH:MM."""
    if zone.upper() in ("UTC", "Z"):
        return 0
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})?", zone)
    if not m:
        raise PhraseError(f"no zone {zone!r}")
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0))


def mentions(frames: DataFrame, text: str = "search_text") -> DataFrame:
    """(frame_id, char_start, char_end, phrase, start, stop, confidence): phrases in texts, resolved at the frame's time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["frame_id", "char_start", "char_end", "phrase", "start", "stop", "confidence"]
        for b in batches:
            out = []
            for i, ts, t in zip(b.frame_id, b.ts, b[text]):
                if not isinstance(t, str) or ts is None or ts != ts:
                    continue
                now = datetime.fromtimestamp(int(ts), timezone.utc)
                for m in FOUND.finditer(t):
                    try:
                        a, z, c = resolve(m.group(), now)
                    except (PhraseError, ValueError):
                        continue
                    out.append((i, m.start(), m.end(), m.group(), int(a.timestamp()), int(z.timestamp()), c))
            yield pd.DataFrame(out, columns=columns)

    return frames.select("frame_id", "ts", text).mapInPandas(run, "frame_id bigint, char_start bigint, char_end bigint, phrase string, start bigint, stop bigint, confidence int")


def resolved(phrase: Column, ts: Column) -> Column:
    """A struct (start, stop, confidence) of a column of phrases at a column of moments (unix seconds), null if not understood."""

    @F.pandas_udf("struct<start: bigint, stop: bigint, confidence: int>")
    def run(phrases: pd.Series, moments: pd.Series) -> pd.DataFrame:
        out = []
        for p, t in zip(phrases, moments):
            try:
                a, z, c = resolve(p, datetime.fromtimestamp(int(t), timezone.utc))
                out.append((int(a.timestamp()), int(z.timestamp()), c))
            except (PhraseError, ValueError, TypeError, AttributeError):
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["start", "stop", "confidence"]).astype({"start": "Int64", "stop": "Int64", "confidence": "Int32"})

    found = run(phrase, ts)
    return F.when(found["start"].isNotNull(), found)


def enriched_text(text: Column, ts: Column) -> Column:
    """``enriched`` for a column of texts at a column of moments (unix seconds); nulls stay as they are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, moments: pd.Series) -> pd.Series:
        return pd.Series([enriched(x, datetime.fromtimestamp(int(t), timezone.utc)) if isinstance(x, str) and t == t and t is not None else x for x, t in zip(texts, moments)])

    return run(text, ts)


def mention_window(spoken: DataFrame, start: int, stop: int) -> DataFrame:
    """Mentions that begin within [start, stop], in order of time."""
    return spoken.where(F.col("start").between(start, stop)).orderBy("start", "frame_id", "char_start")


def paired(marks: DataFrame) -> DataFrame:
    """(frame_id, char_start, char_end, start, stop): range-start rows joined with range-end rows of the same place.

    ``marks`` has frame_id, char_start, char_end, side ('start' or 'end') and moment; a side without its other gives no row.
    """
    place = ["frame_id", "char_start", "char_end"]
    a = marks.where("side = 'start'").groupBy(*place).agg(F.min("moment").alias("start"))
    b = marks.where("side = 'end'").groupBy(*place).agg(F.max("moment").alias("stop"))
    return a.join(b, place).where("start <= stop").select(*place, "start", "stop")


def effective(frames: DataFrame, anchored: DataFrame) -> DataFrame:
    """Frames with ``effective_ts``: the time of their anchor (frame_id, anchor_ts), else their own."""
    return frames.join(anchored.groupBy("frame_id").agg(F.max("anchor_ts").alias("_a")), "frame_id", "left").withColumn("effective_ts", F.coalesce("_a", "ts")).drop("_a")


def within(frames: DataFrame, spoken: DataFrame, start: int, stop: int) -> DataFrame:
    """Frames that mention a time overlapping [start, stop], or, without any mention, were made in it."""
    hit = spoken.where((F.col("start") <= stop) & (F.col("stop") >= start)).select("frame_id").distinct().withColumn("_hit", F.lit(True))
    some = spoken.select("frame_id").distinct().withColumn("_some", F.lit(True))
    joined = frames.join(hit, "frame_id", "left").join(some, "frame_id", "left")
    return joined.where(F.col("_hit") | (F.col("_some").isNull() & F.col("ts").between(start, stop))).drop("_hit", "_some")


HEADERS = [
    (0.95, re.compile(r"^\s*(?:session|\[date:?)\D{0,20}(\d{4})-(\d{2})-(\d{2})", re.I), "ymd"),
    (0.9, re.compile(r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"), "ymd"),
    (0.85, re.compile(rf"(?i)\b({'|'.join(m[:3] for m in MONTHS)})[a-z]*\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})"), "mdy"),
    (0.7, re.compile(r"(?<![\d/])(\d{1,2})/(\d{1,2})/(\d{4})(?![\d/])"), "slash"),
]


def line_date(line: str) -> tuple[date | None, float, bool]:
    """The date a line states, how sure that is, and whether it is a session header."""
    for confidence, pattern, form in HEADERS:
        m = pattern.search(line)
        if not m:
            continue
        try:
            if form == "ymd":
                return date(int(m[1]), int(m[2]), int(m[3])), confidence, confidence == 0.95
            if form == "mdy":
                month = next(i for i, n in enumerate(MONTHS, 1) if n.startswith(m[1].lower()))
                return date(int(m[3]), month, int(m[2])), confidence, False
            return _slash(int(m[1]), int(m[2]), int(m[3]))[0].date(), confidence, False
        except (ValueError, StopIteration):
            continue
    return None, 0.0, False


def track(lines: list[str], state: tuple[str | None, float] = (None, 0.0)) -> tuple[list[str | None], tuple[str | None, float]]:
    """The anchor date in force at each line, and the state to go on with: a surer date or any header replaces it."""
    anchor, sure = state
    out = []
    for line in lines:
        found, confidence, header = line_date(line)
        if found and (header or confidence > sure or anchor is None):
            anchor, sure = found.isoformat(), confidence
        out.append(anchor)
    return out, (anchor, sure)


def anchors(frames: DataFrame, text: str = "search_text") -> DataFrame:
    """(frame_id, line_no, anchor): the date in force at every line of a frame that has one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b.frame_id, b[text]):
                if isinstance(t, str) and any(c.isdigit() for c in t):
                    found, _ = track(t.splitlines())
                    out += [(i, n, a) for n, a in enumerate(found) if a]
            yield pd.DataFrame(out, columns=["frame_id", "line_no", "anchor"])

    return frames.select("frame_id", text).mapInPandas(run, "frame_id bigint, line_no bigint, anchor string")


def enriched(text: str, moment: datetime) -> str:
    """The text with a line that says which days its relative phrases mean."""
    seen = {}
    for m in FOUND.finditer(text):
        try:
            a, z, _ = resolve(m.group(), moment)
        except (PhraseError, ValueError):
            continue
        seen.setdefault(m.group(), a.date().isoformat() if a.date() == z.date() else f"{a.date()} to {z.date()}")
    return text if not seen else f"{text}\n[Temporal Context: {'; '.join(f'{k} = {v}' for k, v in seen.items())}]"
