"""Sentence boundaries across languages and scripts: rules compiled into a finite transducer.

A scanner turns a text into symbols (a stop with the class of the word before it and of what follows, opening and closing
marks, hard breaks) by looking only at a bounded neighbourhood of each place. The transducer's tables, compiled from the
rules, say which stops end a sentence, and keep whether the place is inside a quotation or bracket, and of which kind.

What a scanner must know from further away is finite too: whether the paragraph is a numbered list, how many straight
quotes and which low or high quotation mark it had (read forwards), which closing marks it still has (read backwards).
A document is cut into chunks between two letters, where no symbol lies across; each chunk is a function of the context
and then of the transducer's state, the functions of a document are composed by prefix scans, and each chunk is read from
its true context and state. A document of one chunk goes the same way with nothing to compose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut

#: Code points of a chunk, and how far it sees beyond its edges; no rule looks further.
CHUNK, MARGIN = 32768, 256

# Abbreviations after which a sentence goes on whatever follows.
ALWAYS = set(
    """dr dra drs mr mrs ms messrs prof st ste capt gen col sgt lt maj cmdr gov pres sen rep rev hon mt ft sr sra sres srta dn dña fr fa hr hrn herr
    mme mlle mgr vs cf e.g i.e a.k.a viz dept approx aprox env ca vgl bzw inkl exkl z u zzgl ggf evtl sog bspw lt sté ste d c.-à-d ej ex véase
    проф акад доц см ул т е им ок гр г-н г-жа тов д-р напр ср د أ डॉ श्री प्रो asst assoc insp supt""".split()
)
# Abbreviations that go on before a number or a small letter.
NUMBERED = set(
    """no nr nos núm num nº n pág págs p pp s fig figs abb art arts cap chap ch ver vers v vol est max min sec sect tab eq eqs par para ed app
    jan feb mar apr jun jul aug sep sept oct nov dec jän okt dez стр рис табл гл п кв д с № bd kap abs ziff ext tel""".split()
)
# Abbreviations that may end a sentence; they do where no small letter or number follows.
MAY_END = set("etc usw u.s u.k u.n e.u u.s.a a.m p.m ltd inc corp co plc llc gmbh cie jr bros uu h д п г руб др пр إلخ o ff al ave blvd rd min sek std mio mrd тыс млн коп ч и.т.д".split())
# Nouns before a single capital letter that is no initial.
LETTERED = set("plan option vitamin class type group team part section grade appendix version platz klasse gruppe план plano opción groupe".split())
# Words after a German ordinal.
AFTER_ORDINAL = set("januar februar märz april mai juni juli august september oktober november dezember quartal jahrhundert kapitel abschnitt auflage tag platz mal woche stock".split())
# Words that begin a sentence right after a capitalised word whose full stop lacks the space.
STARTERS = set(
    """The A An Our My Your His Her Their Its Every Each Some Any All No Not Nobody Nothing Someone Everyone What Who Why How Where When Is Are Was Did Do We He She They You It I After Before
    But And So One This That These Those There Here If In On At For With From To As Prof Dr Mr Mrs Der Die Das Den Dem Ein Eine Einige Unser Unsere Niemand Jeder Er Sie Es Wir Ich Was Wer Im Am Wie So Wenn
    Und Aber Nach El La Los Las Un Una Unos Nadie Nuestro Nuestra Algunos Qué Quién Es Ella Ellos Pero Si Le Les Une Des Notre Nos Personne Voir Certains Quel Quelle Il Elle Nous Vous Ce Cette Mais
    Никто Наш Наша Этот Эта Это Где Что Кто Он Она Они Мы Я Но В На См Если После""".split()
)

TERMS = ".!?…。！？｡।॥؟۔"
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", '"': '"', "《": "》"}
KINDS = list(PAIRS)
CLOSERS = set(PAIRS.values()) | {"’"}
BRACKETS = {"(", "[", "（"}
EMOJI = "\U0001f000-\U0001faff←-⇿☀-➿⬀-⯿️‍"
ROLES = "user|assistant|agent|tool|system|human|bot|ai|speaker|customer|support|moderator|host|guest|client|operator|interviewer|q"
MARKER = rf"(?:#{{1,6}}[ \t]|[-*•‣◦▪][ \t]+\S|\[?\d{{1,2}}:\d\d(?::\d\d)?\]?[ \t]|(?i:{ROLES})[ \t]?:[ \t])"
NL = r"(?:\r\n|\n|\r(?!\n))"
BLANK = re.compile(rf"{NL}[ \t\xa0]*{NL}")
EVENT = re.compile(
    rf"(?P<blank>{NL}[ \t\xa0]*{NL}\s*)|(?P<line>{NL}[ \t]*(?={MARKER}|\d{{1,3}}[.)][ \t]))|(?P<term>[{TERMS}]+(?:[ \t ]*\.\.\.)?)"
    r"|(?P<mark>[“”„«»「」『』()\[\]（）\"《》])|(?P<thai>(?<=[฀-๿])[ \t \r\n]+(?=\S))"
)
START = re.compile(rf"[ \t]*(?:\d{{1,3}}[.)][ \t]|{MARKER})")
SKIP = re.compile(rf"(?:[\s​﻿]*[{EMOJI}]+)*[\s​﻿]*")
WORD = re.compile(r"[^\s\"“”„«»()\[\]（）—–,;:/]+$")
CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ฀-๿]")
NEXT_WORD = re.compile(r"[^\W\d_]+")

NUMBERED_ITEM = re.compile(r"\d{1,3}[.)][ \t]")
STAMP, ITEM = re.compile(r"\d{1,2}:\d\d"), re.compile(r"\d{1,3}[.)]")
FIRST_ITEM = re.compile(r"\s*(?:(\d{1,3}[.)][ \t]))?")
CONTEXT_MARK = re.compile(rf"{NL}[ \t\xa0]*{NL}\s*|[“”„«»「」『』()\[\]（）\"《》]")
BETWEEN = re.compile(r"[^\W\d_](?=[^\W\d_])")
LAST_PART = re.compile(r"[.\-]")
SHARES = re.compile(r"[^\W\d_]{3,}\s+S\.\s?$")

# Classes of the word before a stop (those with g_ for a stop that is followed without a space), and of what follows.
WORDS = "always letter_may letter_set letter_corp letter_num letter may_end numbered ordinal_date ordinal dotted plain g_initial g_name g_short g_odd g_none dots wide strong strong_closed".split()
NEXTS = "end break small digit mark other glued starter lone word".split()
# The rules: after which word class what must follow for the stop to end a sentence.
RULES = {
    "always": "end break", "letter_may": "end break other", "letter_set": "end break small digit other", "letter_corp": "end break other", "letter_num": "end break other", "letter": "end break",
    "may_end": "end break other", "numbered": "end break other", "ordinal_date": "end break", "ordinal": "end break small digit other", "dotted": "end break digit other",
    "plain": "end break small digit other starter lone word", "g_initial": "", "g_name": "starter", "g_short": "starter word", "g_odd": "lone", "g_none": "",
    "dots": "end break digit other word", "wide": " ".join(NEXTS), "strong": "end break small digit other word", "strong_closed": "end break digit other word",
}
ALWAYS_, LETTER_MAY, LETTER_SET, LETTER_CORP, LETTER_NUM, LETTER, MAY_END_, NUMBERED_, ORDINAL_DATE, ORDINAL, DOTTED, PLAIN, G_INITIAL, G_NAME, G_SHORT, G_ODD, G_NONE, DOTS, WIDE, STRONG, STRONG_CLOSED = range(len(WORDS))
END_, BREAK, SMALL, DIGIT, MARK, OTHER, GLUED, STARTER, LONE, NEXT_IS_WORD = range(len(NEXTS))

# States: 0 at the start of a sentence, 1 inside one, then (kind, opened at the start of a sentence or inside).
N_KINDS = len(KINDS)
N_STATES = 2 + 2 * N_KINDS
END, HARD = 0, 1
OPEN_START, OPEN_MID, CLOSE_END, CLOSE_GO = (2 + i * N_KINDS for i in range(4))
STOPS = 2 + 4 * N_KINDS
N_EVENTS = STOPS + len(WORDS) * len(NEXTS)
CLOSER_KINDS = {c: [k for k, o in enumerate(KINDS) if PAIRS[o] == c] for c in PAIRS.values()}
CLOSER_BIT = {c: 1 << i for i, c in enumerate(CLOSER_KINDS)}


def compile_rules() -> tuple[np.ndarray, np.ndarray]:
    """The transducer's tables: next[event, state] and whether the event ends a sentence in that state."""
    go = np.tile(np.arange(N_STATES), (N_EVENTS, 1))
    out = np.zeros((N_EVENTS, N_STATES), dtype=bool)
    go[END, :2], out[END, :2] = 0, True
    go[HARD, :], out[HARD, :] = 0, True
    for k, mark in enumerate(KINDS):
        at_start, inside = 2 + 2 * k, 3 + 2 * k
        go[OPEN_START + k, 0], go[OPEN_START + k, 1] = at_start, inside
        go[OPEN_MID + k, :2] = inside
        for state in (at_start, inside):
            ends = state == at_start or mark not in BRACKETS
            go[CLOSE_END + k, state], out[CLOSE_END + k, state] = (0, True) if ends else (1, False)
            go[CLOSE_GO + k, state] = 1
    for w, word in enumerate(WORDS):
        for follows in RULES[word].split():
            event = STOPS + w * len(NEXTS) + NEXTS.index(follows)
            go[event], out[event] = go[END], out[END]
    return go, out


GO, OUT = compile_rules()
GO_ROWS, OUT_ROWS = GO.tolist(), OUT.tolist()
#: Symbols that change nothing in any state need not be passed on.
IDLE = ((np.arange(N_STATES) == GO) & ~OUT).all(axis=1).tolist()

# Contexts: numbered list or not, straight quotes odd or even, last of „ and “ in the paragraph (none, low, high).
N_CONTEXTS = 12
START_CONTEXT = 0


def context_of(numbered: bool, odd: int, low: int) -> int:
    return (6 if numbered else 0) + 3 * odd + low


def next_class(text: str, at: int) -> tuple[int, int]:
    """The class of what follows from ``at``, beyond white space and emoji, and where that is."""
    m = SKIP.match(text, at)
    pos = m.end()
    if pos >= len(text):
        return END_, pos
    c = text[pos]
    if pos - at > 1 and m.group().count("\n") > 1:
        return BREAK, pos
    if c.islower():
        return SMALL, pos
    if c.isdigit():
        return DIGIT, pos
    return (MARK if c in ",;:–—-%&)]»”' ’" else OTHER), pos


def full_stop(text: str, a: int, after: int) -> tuple[int, int]:
    """Classes (before, after) of the single full stop at text[a]; ``after`` is behind the closing marks that follow it."""
    m = WORD.search(text, max(0, a - 40), a)
    bare = m.group().lstrip("'’¿¡*_") if m else ""
    low = bare.lower()
    prev = text[a - 1] if a else ""
    if after < len(text) and not text[after].isspace():
        if not text[after].isupper():
            return G_NONE, GLUED
        nxt = NEXT_WORD.match(text, after)
        w = nxt.group() if nxt else ""
        follows = STARTER if w in STARTERS else NEXT_IS_WORD if len(w) != 1 else LONE if text[after + 1 : after + 2] in (".", " ") else GLUED
        last = LAST_PART.split(bare)[-1]
        if len(last) == 1 and last.isupper():
            return G_INITIAL, follows
        if low in ALWAYS:
            return ALWAYS_, follows
        if bare and bare[0].isupper() and last[:1].isupper() and prev.isalpha():
            return G_NAME, follows
        if prev.isalnum() or (prev and prev in ")]»”\"%"):
            return (PLAIN if len(last) > 1 else G_SHORT), follows
        return (G_NONE if not prev or prev in ".@/" or len(last) < 2 else G_ODD), follows
    follows, pos = next_class(text, after)
    if follows in (END_, BREAK, MARK):
        return PLAIN, follows
    if low in ALWAYS:
        return ALWAYS_, follows
    if len(bare) == 1 and bare.isalpha():
        small = bare.islower()
        if small and low in MAY_END:
            return LETTER_MAY, follows
        before = NEXT_WORD.findall(text, max(0, m.start() - 24), m.start())
        if not small and before and before[-1].lower() in LETTERED:
            return LETTER_SET, follows
        if bare == "A" and text[max(0, a - 4) : a - 1].strip() == "S." and SHARES.search(text[max(0, a - 30) : a - 1]):
            return LETTER_CORP, follows
        return (LETTER_NUM if small and low in NUMBERED else LETTER), follows
    if low in MAY_END:
        return MAY_END_, follows
    if low in NUMBERED:
        return NUMBERED_, follows
    if len(bare) <= 2 and bare.isdigit():
        w = NEXT_WORD.match(text, pos)
        return (ORDINAL_DATE if w and w.group().lower() in AFTER_ORDINAL else ORDINAL), follows
    if "." in bare and all(len(p) <= 2 for p in bare.split(".")) and bare.replace(".", "").isalpha():
        return DOTTED, follows
    return PLAIN, follows


def stop_symbol(text: str, a: int, b: int) -> tuple[int, int]:
    """(symbol, where the next sentence would start) of the run of stops text[a:b]."""
    n, after = len(text), b
    while after < n and text[after] in CLOSERS:
        after += 1
    run = text[a:b]
    if run == ".":
        word, follows = full_stop(text, a, after)
    else:
        spaced = after >= n or text[after].isspace()
        if run.strip(" \t ").strip(".…") == "":
            word = DOTS
            if spaced:
                follows = next_class(text, after)[0]
            else:
                word = DOTS if text[after].isupper() and a > 0 and not text[a - 1].isspace() and run[0] in ".…" and len(run) < 4 and "/" not in text[max(0, a - 1) : a] else G_NONE
                follows = NEXT_IS_WORD
        elif not WIDE_STOPS.isdisjoint(run):
            word, follows = WIDE, OTHER
        else:
            word = STRONG if after == b else STRONG_CLOSED
            if spaced:
                follows = next_class(text, after)[0]
            else:
                c = text[after]
                follows = NEXT_IS_WORD if c.isupper() or c in "¿¡«“\"(" or CJK.match(c) or ord(c) >= 0x1F000 else GLUED
    symbol = STOPS + word * len(NEXTS) + follows
    return symbol, (0 if IDLE[symbol] else SKIP.match(text, after).end())


WIDE_STOPS = set("。！？｡।॥؟۔")


def summary(text: str, lo: int, hi: int) -> tuple[list[int], int, bool]:
    """What text[lo:hi] does to the context: the context after it for each before it; the closing marks (bits) that come
    before its first blank line, and whether it has one."""
    blank, odd, low, numbered, mask = False, 0, -1, False, 0
    for m in CONTEXT_MARK.finditer(text, lo, hi):
        c = text[m.start()]
        if c in "\r\n":
            blank, odd, low, numbered = True, 0, -1, NUMBERED_ITEM.match(text, m.end()) is not None
            continue
        if not blank and c in CLOSER_BIT:
            mask |= CLOSER_BIT[c]
        if c == '"':
            odd ^= 1
        elif c in "„“":
            low = 1 if c == "„" else 2
    if blank:
        return [context_of(numbered, odd, max(low, 0))] * N_CONTEXTS, mask, True
    item = lo == 0 and FIRST_ITEM.match(text).group(1) is not None  # the start of the text is that of a paragraph
    return [context_of(item or c >= 6, (c // 3 & 1) ^ odd, low if low > 0 else c % 3) for c in range(N_CONTEXTS)], mask, False


def events(text: str, lo: int, hi: int, context: int, ahead: int) -> Iterator[tuple[int, int]]:
    """(symbol, place where the next sentence would start) of the marks in text[lo:hi].

    ``context`` is that at ``lo``, ``ahead`` the closing marks (bits) between ``hi`` and the next blank line.
    """
    numbered, odd, low = context >= 6, context // 3 & 1, context % 3
    n, skip_to = len(text), -1
    if lo == 0:
        m = FIRST_ITEM.match(text)
        numbered, skip_to = m.group(1) is not None, m.end()
    next_blank = -1  # the first blank line from the place looked at on
    closes_at: dict[str, int] = {}  # the first such closing mark from the place looked at on, hi if there is none
    for m in EVENT.finditer(text, lo, min(n, hi + MARGIN)):
        a, b = m.span()
        if a >= hi:
            return
        kind = m.lastgroup
        if kind == "term":
            if a >= skip_to:
                symbol, place = stop_symbol(text, a, b)
                if not IDLE[symbol]:
                    yield symbol, place
        elif kind == "mark":
            c = text[a]
            before = text[a - 1] if a else " "
            opens = c in PAIRS and (c != '"' or before.isspace() or before in "([（—–「:：" or CJK.match(before) is not None)
            if c == "“" and low == 1:
                opens = False
            closed = False
            if c in CLOSERS and not (opens and c == '"' and not odd):
                inner = text[max(0, a - 3) : a].rstrip()
                ended = bool(inner) and inner[-1] in TERMS
                after = b
                while after < n and text[after] in CLOSERS:
                    after += 1
                pos = b
                if ended:
                    follows, pos = next_class(text, after)
                    spaced = after >= n or text[after].isspace()
                    ended = follows in (END_, BREAK) or (follows in (OTHER, DIGIT) and (spaced or text[after].isupper())) or (follows == SMALL and spaced and (c in ")]）" or (c in "”\"" and inner[-1] == ".")))
                base = CLOSE_END if ended else CLOSE_GO
                for k in CLOSER_KINDS.get(c, ()):
                    closed = True
                    yield base + k, pos
            if c == '"':
                odd ^= 1
            elif c == "„":
                low = 1
            elif c == "“":
                low = 2
            if opens and not (closed and c == '"' and not _opening_quote(text, a)):
                if next_blank < b:
                    found = BLANK.search(text, b, hi)
                    next_blank = found.start() if found else n + 1
                closer = PAIRS[c]
                if closes_at.get(closer, -1) < b:
                    at = text.find(closer, b, hi)
                    closes_at[closer] = at if at >= 0 else n + 1
                if closes_at[closer] < next_blank or (next_blank > n and ahead & CLOSER_BIT[closer]):
                    back = text[max(0, a - 6) : a].rstrip()
                    local = not back or back[-1] in TERMS or back[-1] in CLOSERS or ord(back[-1]) >= 0x2190 or text[max(0, a - 4) : a].count("\n") > 1 or back[-1] in ":]" or _line_start(text, a)
                    yield (OPEN_START if local else OPEN_MID) + KINDS.index(c), a
        elif kind == "blank":
            item = NUMBERED_ITEM.match(text, b)
            numbered, odd, low = item is not None, 0, 0
            skip_to = item.end() if item else b
            yield HARD, b
        elif kind == "line":
            if text[b : b + 1].isdigit() and ITEM.match(text, b) and not STAMP.match(text, b) and not numbered:
                continue
            item = NUMBERED_ITEM.match(text, b)
            skip_to = item.end() if item else b
            yield HARD, b
        else:
            yield END, SKIP.match(text, b).end()


def _opening_quote(text: str, a: int) -> bool:
    return a + 1 < len(text) and not text[a + 1].isspace() and (a == 0 or text[a - 1].isspace() or text[a - 1] in "([（")


def _line_start(text: str, a: int) -> bool:
    """Whether only a list marker or speaker label stands between the start of the line and text[a]."""
    line = text.rfind("\n", max(0, a - 64), a)
    return (line >= 0 or a <= 64) and START.fullmatch(text, line + 1, a) is not None


def chunk_function(found: list[tuple[int, int]]) -> list[int]:
    """The state after the symbols for every state before them."""
    f = np.arange(N_STATES)
    for e, _ in found:
        f = GO[e][f]
    return f.tolist()


def starts_from(found: list[tuple[int, int]], state: int) -> list[int]:
    """Places where sentences start, of the symbols read from ``state``."""
    out = []
    for e, place in found:
        if OUT_ROWS[e][state]:
            out.append(place)
        state = GO_ROWS[e][state]
    return out


def chunk_edges(text: str, chunk: int) -> list[int]:
    """Where the chunks of a text begin, and its length: each between two letters, so that no symbol lies across."""
    edges, n = [0], len(text)
    while edges[-1] + chunk < n:
        m = BETWEEN.search(text, edges[-1] + chunk)
        if not m:
            break
        edges.append(m.end())
    return [*edges, n]


def sentence_starts(text: str) -> list[int]:
    """Start of every sentence unit of a whole text, read as one chunk."""
    n = len(text)
    first = n - len(text.lstrip())
    if first >= n:
        return []
    found = {first}
    found.update(p for p in starts_from(list(events(text, 0, n, START_CONTEXT, 0)), 0) if first < p < n)
    return sorted(found)


def end_before(text: str, at: int) -> int:
    """The end of what is not white space before text[at], 0 if there is none in sight."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return at


ROW = "doc_id bigint, sent_no bigint, sent_start bigint, sent_end bigint, key bigint, no int, n bigint, base bigint, lo int, hi int, part string, after array<int>, closers int, blank boolean"


def units(documents: DataFrame, doc: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, sent_no, sent_start, sent_end): sentence units as code-point offsets, for every document.

    A unit runs to the start of the next or the end of the text, white space at its end left out. Null, empty and blank
    texts have no units; a null id is kept as it is; repeated rows give repeated units; other columns are ignored. The
    result does not depend on ``chunk``.

    The table is read once: a document of one chunk comes out with its units, a longer one as chunks with what each does
    to the context, all in one table in the shared folder. Chunks travel once more, to their context; from then on only
    their symbols and state functions do. What is gathered by document is a few numbers a chunk, and its units.
    """
    d = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("key")).where("text is not null and text <> ''")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("sent_no", pa.int64()), ("sent_start", pa.int64()), ("sent_end", pa.int64()), ("key", pa.int64()), ("no", pa.int32()), ("n", pa.int64()), ("base", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.string()), ("after", pa.list_(pa.int32())), ("closers", pa.int32()), ("blank", pa.bool_())])
        for b in batches:
            ids, no, begin, end, long = [], [], [], [], []
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text")):
                t = t.as_py()
                edges = chunk_edges(t, chunk)
                n = len(t)
                if len(edges) == 2:
                    at = sentence_starts(t)
                    ids += [i] * len(at)
                    no += range(len(at))
                    begin += at
                    end += [end_before(t, p) for p in [*at[1:], n]] if at else []
                    continue
                for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                    base = max(0, lo - MARGIN)
                    part = t[base : hi + MARGIN]
                    long.append((i, None, None, None, k, c, n, base, lo - base, hi - base, part, *summary(part, lo - base, hi - base)))
                    if len(long) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*long), schema)], schema=schema)
                        long = []
            if ids:
                m = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, no, begin, end)] + [pa.nulls(m, f.type) for f in list(schema)[4:]], schema=schema)
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*long), schema)], schema=schema)

    read = cut(d.mapInArrow(first, ROW))
    short = read.where("no is null").select("doc_id", "sent_no", "sent_start", "sent_end")
    return short.unionByName(long_units(read.where("no is not null")))


def long_units(chunks: DataFrame) -> DataFrame:
    """Units of documents given as chunk rows: contexts and states by prefix scans over the chunks' functions."""

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, cs in zip(b.key, b.cs):
                before, at = [], START_CONTEXT
                for c in cs:
                    before.append(at)
                    at = c["after"][at]
                ahead, mask = [], 0
                for c in reversed(cs):
                    ahead.append(mask)
                    mask = c["closers"] | (0 if c["blank"] else mask)
                out += [(key, c["no"], x, y) for c, x, y in zip(cs, before, reversed(ahead))]
            yield pd.DataFrame(out, columns=["key", "no", "context", "ahead"])

    known = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "after", "closers", "blank"))).alias("cs")).mapInPandas(contexts, "key bigint, no int, context int, ahead int")
    placed = chunks.select("key", "no", "doc_id", "n", "base", "lo", "hi", "part").join(known, ["key", "no"])

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            kinds, places, ends, fs, heads, tails = [], [], [], [], [], []
            for r in rows:
                t, lo, hi = r["part"], r["lo"], r["hi"]
                found = list(events(t, lo, hi, r["context"], r["ahead"]))
                kinds.append([e for e, _ in found])
                places.append([r["base"] + p for _, p in found])
                ends.append([r["base"] + end_before(t, p) for _, p in found])
                fs.append(chunk_function(found))
                own = t[lo:hi]
                heads.append(r["base"] + lo + len(own) - len(own.lstrip()) if own.strip() else None)
                tails.append(r["base"] + lo + len(own.rstrip()) if own.strip() else None)
            columns = {"kinds": pa.array(kinds, pa.list_(pa.int32())), "places": pa.array(places, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64())), "f": pa.array(fs, pa.list_(pa.int32())), "head": pa.array(heads, pa.int64()), "tail": pa.array(tails, pa.int64())}
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("key", "no", "doc_id", "n")] + list(columns.values()), ["key", "no", "doc_id", "n", *columns])

    read = cut(placed.mapInArrow(symbols, "key bigint, no int, doc_id bigint, n bigint, kinds array<int>, places array<bigint>, ends array<bigint>, f array<int>, head bigint, tail bigint"))

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, cs in zip(b.key, b.cs):
                at, head = 0, next((c["head"] for c in cs if c["head"] is not None), None)
                tail = max((c["tail"] for c in cs if c["tail"] is not None), default=None)
                for c in cs:
                    out.append((key, c["no"], at, head, tail))
                    at = c["f"][at]
            yield pd.DataFrame(out, columns=["key", "no", "state", "first", "last"]).astype({"first": "Int64", "last": "Int64"})

    scan = read.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "f", "head", "tail"))).alias("cs")).mapInPandas(states, "key bigint, no int, state int, first bigint, last bigint")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b[b["first"].notna()].itertuples(index=False):
                ends = dict(zip(r.places, r.ends))
                found = {int(p) for p in starts_from(list(zip(r.kinds, r.places)), int(r.state)) if r.first < p < r.n}
                if r.no == 0:
                    found.add(int(r.first))
                out += [(r.doc_id, r.key, p, ends.get(p, 0), r.last) for p in sorted(found)]
            yield pd.DataFrame(out, columns=["doc_id", "key", "sent_start", "end_before", "last"]).astype({"doc_id": "Int64"})

    starts = read.drop("f", "head", "tail").join(scan, ["key", "no"]).mapInPandas(fold, "doc_id bigint, key bigint, sent_start bigint, end_before bigint, last bigint")
    order = Window.partitionBy("key").orderBy("sent_start")
    out = starts.withColumn("sent_no", F.row_number().over(order).cast("bigint") - 1).withColumn("sent_end", F.coalesce(F.lead("end_before").over(order), "last"))
    return out.select("doc_id", "sent_no", "sent_start", "sent_end")
