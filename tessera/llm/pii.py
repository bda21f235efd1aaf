"""Personal information in free text: bootstrapped contextual extraction over a pattern-instance graph.

A scanner proposes typed candidates by loose shape. Seeds (shapes that are unmistakable, common given names) give the
first trust. Lexical contexts that mostly surround trusted instances become trusted patterns, instances found mostly in
trusted patterns become trusted in turn, and so on: labels such as "identity number:" are learned from dashed numbers and
then reveal the other layouts of identity numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import NICKNAMES
from tessera.runtime import cut, latest, maybe_broadcast

# Common given names that seed the graph, beside those of the nickname table; others are learned.
SEEDS = set(
    """alexander andrew anthony barbara benjamin charles christopher cynthia daniel david deborah dorothy edward eleanor elizabeth frank frederick george gertrude
    gregory helen henry ignatius ingrid james jennifer john joseph josephine karen katherine kenneth laura lawrence leonard linda margaret maria mary matthew michael nancy nicholas
    oliver pamela patricia paul peter quentin raymond rebecca richard robert samuel sarah stephen susan teresa thomas timothy umberto ursula valerie victoria walter
    wilhelm william yasmin xanthe zachary björn jürgen søren zoë renée iñigo łucja farouk hideki wanjiru anna julia sofia lucas pierre marie hans pedro ivan olga""".split()
)
GIVEN = SEEDS | set(NICKNAMES) | {n for ns in NICKNAMES.values() for n in ns}
# Given names that are also everyday words; in lower case they are no seeds.
WORDLY = {"will", "bill", "rich", "mark", "pat", "ray", "dot", "val", "sue", "jo", "al", "art", "dolly", "gail", "rob", "drew", "chuck", "kit", "dick", "bob", "jack", "kay", "marge", "nick", "vic", "tori", "sandy", "lena", "nell", "ned", "bert", "gene", "max", "may", "grace", "hope"}
LOWER_GIVEN = GIVEN - WORDLY
# Titles before a name, and kinds of thoroughfare in addresses.
TITLES = r"(?:Dr|Prof|Mrs|Mr|Ms|Miss|Mme|Mlle|M|Herr|Frau|Hr|Fr|Sra|Sr|Srta|Don|Doña)"
ROADS = "street|st|avenue|ave|road|rd|lane|ln|close|terrace|terr?|drive|dr|court|ct|boulevard|blvd|way|place|pl|square|sq|crescent|cres|row|mews|grove|gardens|gdns|parkway|pkwy|circle|cir|trail|highway|hwy"

# Letters as classes that the standard library's engine scans fastest.
UP = "".join(chr(c) for c in range(0x590) if chr(c).isupper())
LOW = "".join(chr(c) for c in range(0x590) if chr(c).islower())
L, AL = r"[^\W\d_]", r"[^\W_]"
EMAILS = [
    ("std", "@", re.compile(rf"(?<![\w.+%@/:-]){AL}[\w.%+-]*@{AL}(?:{AL}|-)*(?:\.(?:{AL}|-)+)*\.{L}{{2,}}(?![\w@])")),
    ("gap", "@", re.compile(rf"(?<![\w.+%@/:-]){AL}[\w.%+-]*\s?(?:@|\(@\)|\[@\])\s?{AL}(?:{AL}|-)*(?:\.(?:{AL}|-)+)*\.{L}{{2,}}(?![\w@])")),
    ("said", " at ", re.compile(rf"(?<![\w.+%@/:-]){AL}[\w.%+-]*\s+at\s+{AL}(?:{AL}|-)*(?:(?:\s+dot\s+|\s*[(\[{{]\s*dot\s*[)\]}}]\s*)(?:{AL}|-)+)+", re.I)),
    ("wrapped", "at", re.compile(rf"(?<![\w.+%@/:-]){AL}[\w.%+-]*\s*[(\[{{<]\s*at\s*[)\]}}>]\s*{AL}(?:{AL}|-)*(?:(?:\s+dot\s+|\s*[(\[{{<]\s*dot\s*[)\]}}>]\s*|\.)(?:{AL}|-)+)+", re.I)),
]
WRAPPED = re.compile(r"[(\[{<]\s*at\s*[)\]}>]", re.I)
# A first character of its own before the look-behind lets the engine search for it.
NUMBER = re.compile(r"[\d+(](?<![\w.:/@#-][\d+(])(?<!\d[ \xa0][\d+(])(?=[\d \xa0.\-/–()]{6})(?:(?<=\d)\d*+|(?<=\+) ?\d++|(?<=\()\d++)(?:(?:[ \xa0.\-/–()]|\) | \(|-\(|\)-|\(0\))*+\d++)*+(?![\w@])")
CODE = re.compile(r"[A-Z\d](?<![\w./:@#-][A-Z\d])(?=[A-Z]?[ \d-]{0,2}\d)(?:(?<=[A-Z])[A-Z]?[ -]?\d(?:[ -]?\d){5,9}(?:[ -]?[A-Z])?|(?<=\d)\d{6,7}[ -]?[A-Z]|(?<=[A-Z])[A-Z]?\d{1,8}[A-Z]{1,3}\d{2,8}[A-Z]?)(?![\w-])")
HOUSE = re.compile(r"\d(?<![\w.:/-]\d)\d{0,4}(?![\d:])(?=[A-Z]?(?:[-/]\d{1,4})?,?[ \xa0]|\s?(?:bis|ter|[a-d])\b)")
FRONT = re.compile(rf"\d{{1,5}}[A-Z]?(?:[-/]\d{{1,4}})?,?[ \xa0](?:(?:[{UP}][\w'’-]{{3,}}|[{UP}][\w'’-]{{0,2}}\.?|\d+(?:st|nd|rd|th))[ \xa0]){{1,4}}?(?=[{UP}])(?i:{ROADS})\b(?![-\w])")
RUE = re.compile(rf"\d{{1,5}}(?:\s?(?:bis|ter|[a-d]))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|allee|impasse|quai|cours|route|square|passage)\s(?:(?:de|du|des|la|le|les|l'|d')\s?)*(?:{L}|['’-])+(?-i:[ -][{UP}](?:{L}|['’-])+){{0,2}}", re.I)
CALLE_WORDS = ("c/", "calle", "avda", "avenida", "plaza", "pza", "paseo", "camino", "carrer", "ronda", "via ", "viale", "piazza", "corso", "rua ")
CALLE = re.compile(rf"(?<!\w)(?:c/|calle|avda\.?|avenida|plaza|pza\.?|paseo|camino|carrer|ronda|via|viale|piazza|corso|rua)\s(?:(?:{L}|['’.-])+\s){{1,4}}?(?:n\.?º\s?)?\d{{1,4}}\b", re.I)
WEG_WORDS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig", "graben")
WEG = re.compile(
    rf"(?<!\w)(?:(?:Alte[rn]?|Neue[rn]?|Lange[rn]?|Kleine[rn]?|Große[rn]?|Obere[rn]?|Untere[rn]?|Hohe[rn]?|An der|Auf dem|Auf der|Am|Im|Zum|Zur) )?[{UP}](?:{L}|-)*(?i:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|graben)[ \xa0]\d{{1,4}}(?:[ ]?[a-z]\b)?"
)
TAIL = re.compile(rf"(?:,? (?:apt|unit|suite|ste|flat|apartment|piso|#)\.? ?#?\w+)?(?:, ?\d{{1,3}} ?[ºª°](?: ?[A-Z]\b)?)?(?:,? \d{{4,5}} (?-i:[{UP}](?:{L}|['’-])+(?: [{UP}](?:{L}|['’-])+)?)|\.?, (?-i:[{UP}](?:{L}|['’-])+(?: [{UP}](?:{L}|['’-])+){{0,2}}),? \d{{4,6}}(?!\d))?", re.I)
ANY = "a-zA-Z" + "".join(chr(c) for c in range(0xAA, 0x590) if chr(c).isalpha())
FULL = rf"[{UP}][{ANY}'’]+(?:-[{UP}][{ANY}'’]+)*"
RUN = re.compile(rf"[{UP}](?<![\w@./:-].)(?:\.\s?|[{ANY}'’]+(?:-[{UP}][{ANY}'’]+)*(?![\w@]))(?:,?[ \xa0]{{1,2}}(?:{FULL}(?![\w@])|[{UP}](?:\.|(?![\w.'’]))))+")
# Scripts without capitals: two words between marks or spaces, or a short run of ideographs or syllables on its own.
CASELESS = re.compile(r"(?<![^\W_])([֐-ۿऀ-෿Ⴀ-ჿሀ-፿]{2,}) ([֐-ۿऀ-෿Ⴀ-ჿሀ-፿]{2,})(?![^\W_])|(?<![^\W_])([一-鿿가-힣])([一-鿿가-힣]{1,3})(?![^\W_])")
PART = re.compile(rf"[{UP}]\.|[{UP}](?![\w.'’])|{FULL}")
APART = "\"'(,=“«"
TITLE_STOPS = ("dr.", "prof.", "mr.", "mrs.", "ms.", "m. ", "sr.", "sra.", "fr.", "hr.", "herr", "frau", "mme", "miss", "mlle", "don", "doña")
LOWER = re.compile(rf"(?<![\w@./:-])([{LOW}](?:{L}|['’-])+|[{LOW}]\.)(?=,?[ \xa0]{{1,2}}([{LOW}](?:{L}|['’-])+|[{LOW}]\.(?=\W|$))(?![\w@]))")
TITLE = re.compile(rf"(?i:{TITLES})")
TITLED = re.compile(rf"(?<!\w)(?:(?i:{TITLES})\.|{TITLES})[ \xa0]+$")
TITLE_LOWER = re.compile(rf"(?<!\w)(?:(?i:{TITLES})\.|{TITLES})[ \xa0]+[{LOW}]")
SHORT = re.compile(rf"[{UP}]{L}*['’][{LOW}]{{1,2}}")
BRACKET = re.compile(r"\(\+?\d{1,5}\)")
PHONE_SEED = re.compile(r"\(0{3}\) ?0{3}-0{4}|\+0{1,3}[ -](?:\(0{1,4}\) ?)?0[0 \-]{6,}")
HINTS = ahocorasick.Automaton()
for _kind, _words in ((1, CALLE_WORDS), (2, WEG_WORDS), (4, TITLE_STOPS)):
    for _word in _words:
        HINTS.add_word(_word, _kind | HINTS.get(_word, 0))
HINTS.make_automaton()
HAS_DIGIT = re.compile(r"\d")
TOKEN = re.compile(r"\w+|\n|\t|[^\s\w]")
DIGITS, LETTERS = re.compile(r"\d"), re.compile(r"[A-Z]")
#: The key of all initials.
INITIAL = "<initial>"

#: A pattern of numbers is fully trusted if trusted ones are so many times likelier in it than anywhere, or have this share.
LIFT, SHARE = 10.0, 0.25
#: A loose layout of e-mail or street addresses starts with so many neutral occurrences of this trust.
PRIOR_OCCURRENCES, PRIOR = 8, 0.6

# Road words with which a layout of addresses is unmistakable; the other road words are learned.
SURE_ROADS = {"street", "avenue", "road", "lane", "boulevard", "drive", "rue", "calle", "avenida", "straße", "strasse"}
GROUPS = {"NUMBER": 1, "NAME": 2, "EMAIL": 3, "ADDRESS": 4}
TYPES = ["PHONE", "ID_NUMBER", "NAME", "EMAIL", "ADDRESS"]
NUMBERS, NAMES, MAILS, STREETS = GROUPS.values()
SCHEMA = "start int, stop int, grp int, key string, other string, lpat string, rpat string, seed int"


def _context(text: str, a: int, b: int) -> tuple[str, str]:
    left = TOKEN.findall(DIGITS.sub("0", text[max(0, a - 28) : a].lower()))
    if len(left) < 3 and a > 28 and left and not text[a - 29 : a - 28].isspace():
        left = left[1:]
    right = TOKEN.search(text, b, b + 14)
    return " ".join(left[-2:]) or "^", f"{left[-1] if left else ''} _ {DIGITS.sub('0', right.group().lower()) if right else ''}"


def _road(kind: str, said: str) -> str:
    """The word that makes a match a street: first, last or part of one, by layout."""
    words = said.lower().split()
    if kind == "calle":
        return words[0]
    if kind == "weg":
        return next(w for w in WEG_WORDS if w in said.lower())
    return words[-1] if kind == "front" else next((w for w in words[1:] if len(w) > 1 and w not in ("bis", "ter")), "")


def candidates(text: str) -> list[tuple]:
    """Loose candidates: (start, stop, group, key, other key, left pattern, around pattern, seed).

    The key is what is learned about: the layout of a number, an e-mail or a street address, a given name; the other key
    tells values of one key apart: the value itself, the family name. seed is the type (1 for PHONE ...) if the candidate
    is unmistakable, else 0.
    """
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, grp: int, key: str, seed: int, other: str = "") -> None:
        lpat, rpat = _context(text, a, b)
        out.append((a, b, grp, key, other or text[a:b].lower(), lpat, rpat, seed))

    def free(a: int, b: int) -> bool:
        return not taken or not any(a < y and x < b for x, y in taken)

    low, hints = text.lower(), 0
    for _, kind in HINTS.iter(low):
        hints |= kind
    if "@" in text or " at " in low or ("at" in low and ("(" in low or "[" in low or "{" in low or "<" in low) and WRAPPED.search(low)):
        for key, sign, pattern in EMAILS:
            if sign in low:
                for m in pattern.finditer(text):
                    if free(*m.span()):
                        add(m.start(), m.end(), MAILS, key, 4 if key == "std" else 0)
                        taken.append(m.span())
    if HAS_DIGIT.search(text):
        streets = []
        for m in HOUSE.finditer(text):
            a = m.start()
            found = FRONT.match(text, a)
            if found:
                streets.append(("front", found))
            elif found := RUE.match(text, a):
                streets.append(("rue", found))
        if hints & 1:
            streets += [("calle", m) for m in CALLE.finditer(text)]
        if hints & 2:
            streets += [("weg", m) for m in WEG.finditer(text)]
        for kind, m in streets:
            end = TAIL.match(text, m.end()).end()
            if free(m.start(), end):
                road = _road(kind, m.group())
                add(m.start(), end, STREETS, f"{kind} {road}", 5 if road in SURE_ROADS else 0)
                taken.append((m.start(), end))
        for m in CODE.finditer(text):
            v = m.group()
            if len(DIGITS.findall(v)) >= 6 and free(*m.span()):
                add(m.start(), m.end(), NUMBERS, DIGITS.sub("0", LETTERS.sub("A", v.replace("\xa0", " "))), 0)
                taken.append(m.span())
        for m in NUMBER.finditer(text):
            a, b = m.span()
            if b - a < 7 or not free(a, b):
                continue
            whole = text[a:b].replace("\xa0", " ")
            spans = {(a, b)}
            if " " in whole:
                for g in [a + i for i, c in enumerate(whole) if c == " "]:
                    spans |= {(a, g), (g + 1, b)}
            for x, y in spans:
                while y > x and not text[y - 1].isdigit():
                    y -= 1
                if y - x < 7:
                    continue
                if text[x] == "(" and not BRACKET.match(text, x, y):
                    x += 1  # a bracket around the number
                shape = DIGITS.sub("0", whole[x - a : y - a])
                if 7 <= shape.count("0") <= 16:
                    add(x, y, NUMBERS, shape, 1 if PHONE_SEED.fullmatch(shape) else 2 if shape == "000-00-0000" else 0)
    seen: set[tuple[int, int]] = set()
    for m in RUN.finditer(text):
        parts = [(p.start(), p.end(), p.group()) for p in PART.finditer(text, m.start(), m.end())]
        while parts and (SHORT.fullmatch(parts[0][2]) or (TITLE.fullmatch(parts[0][2].rstrip(".")) and not (parts[0][2][:2] == "M." and len(parts) < 3))):
            parts = parts[1:]
        for i in range(len(parts) - 1):
            j = i + 1
            if len(parts[j][2].rstrip(".")) == 1 and j + 1 < len(parts) and len(parts[i][2].rstrip(".")) > 1 and "," not in text[parts[i][1] : parts[j + 1][0]]:
                j += 1
            elif len(parts[i][2].rstrip(".")) == 1 and len(parts[j][2].rstrip(".")) == 1 and j + 1 < len(parts):
                j += 1
            _name(text, parts[i], parts[j], seen, add, alone=len(parts) == 2)
    if not text.isascii():
        for m in CASELESS.finditer(text):
            first, last = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
            add(m.start(), m.end(), NAMES, first, 0, last)
    plain = text
    for mark in APART:
        plain = plain.replace(mark, " ")
    if LOWER_GIVEN.isdisjoint(plain.split()) and (not hints & 4 or not TITLE_LOWER.search(text)):
        return out
    for m in LOWER.finditer(text):
        _name(text, (m.start(1), m.end(1), m.group(1)), (m.start(2), m.end(2), m.group(2)), seen, add, True)
    return out


def _name(text: str, first: tuple, last: tuple, seen: set, add, lower: bool = False, alone: bool = False) -> None:
    a, b = first[0], last[1]
    if (a, b) in seen:
        return
    comma = "," in text[first[1] : last[0]]
    x, y = first[2].lower().rstrip("."), last[2].lower().rstrip(".")
    given, family = (y, x) if comma or (alone and y in GIVEN and x not in GIVEN) or (len(y) == 1 and len(x) > 1) else (x, y)
    if len(family) < 2 or (lower and (len(family) < 3 or (given not in LOWER_GIVEN and not TITLED.search(text[max(0, a - 8) : a])))):
        return
    seen.add((a, b))
    add(a, b, NAMES, INITIAL if len(given) == 1 else given, 3 if given in GIVEN else 0, family)


def texts_of(actions: DataFrame, reports: DataFrame) -> DataFrame:
    """(source_table, row_id, field, text): the latest delivery of each record, without empty texts."""
    a = latest(actions.where("action_id is not null").select("action_id", "input_preview", "output_preview", "ingested_at"), ["action_id"], ["ingested_at"])
    fields = F.explode(F.expr("array(struct('input_preview' as field, input_preview as text), struct('output_preview' as field, output_preview as text))")).alias("x")
    acted = a.select(F.lit("replay_actions").alias("source_table"), F.col("action_id").alias("row_id"), fields).select("source_table", "row_id", "x.field", "x.text")
    r = latest(reports.where("report_id is not null").select("report_id", "question", "generated_at"), ["report_id"], ["generated_at"])
    asked = r.select(F.lit("audit_reports").alias("source_table"), F.col("report_id").alias("row_id"), F.lit("question").alias("field"), F.col("question").alias("text"))
    return acted.unionByName(asked).where("text is not null and text <> ''")


def scan(texts: DataFrame) -> DataFrame:
    """Candidates of every text, one row each: its other columns, start, stop, grp, seed, and as 64-bit hashes the key k,
    the other key o, and the patterns l (left of it, even) and a (around it, odd)."""
    keep = [f for f in texts.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", " + SCHEMA
    names = [f.name for f in keep]
    kinds = {"int": pa.int32(), "string": pa.string()}
    added = [(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner, seen = [], [], {}
            for i, t in enumerate(b.column("text").to_pylist()):
                found = seen.get(t)  # texts repeat: error stubs, copied questions
                if found is None:
                    seen[t] = found = candidates(t)
                if found:
                    rows += found
                    owner += [i] * len(found)
            if rows:
                own = pa.array(owner, pa.int32())
                kept = [b.column(n).take(own) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, (_, t) in zip(zip(*rows), added)]], [*names, *[n for n, _ in added]])

    hashed = ["xxhash64(grp, key) as k", "xxhash64(grp, other) as o", "xxhash64(grp, lpat) & -2L as l", "xxhash64(grp, rpat) | 1L as a"]
    return texts.select(*names, "text").mapInArrow(run, schema).selectExpr(*names, "start", "stop", "grp", "seed", *hashed)


def graph_scores(found: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trust of patterns (grp, p, type, score), keys (grp, k, type, score) and family names (o, family_score, rare).

    A trusted value counts once for a pattern, an untrusted one each time it occurs, so a fixed phrase that occurs a
    million times ("Victoria Falls") is one instance for the pattern around it and a million against a vague pattern.
    A pattern of numbers is scored by how many times likelier trusted numbers are in it than anywhere, since the seeds
    are one layout of many. Loose layouts of e-mail and street addresses start with a weak trust of their own. Each round
    is two grouped sums over the aggregated edges, cut after each.
    """
    spark = found.sparkSession
    rows = found.select("grp", "k", "o", "seed", F.explode(F.array("l", "a")).alias("p"))
    edges = cut(rows.groupBy("grp", "p", "k", "o").agg(F.count("*").alias("occ"), F.max("seed").alias("seed")))
    flat = edges.groupBy("grp", "p", "k").agg(F.count("*").alias("n"), F.sum("occ").alias("occ"), F.max("seed").alias("seed"))
    flat = cut(flat.withColumn("total", F.sum("occ").over(Window.partitionBy("grp", "p"))))
    initial = F.xxhash64(F.lit(NAMES), F.lit(INITIAL))
    seeds = flat.where(F.col("seed") > 0).where(F.col("k") != initial).groupBy("grp", "k", F.col("seed").alias("type")).agg(F.lit(1.0).alias("score"))
    keys = edges.where("p & 1 = 0").groupBy("grp", "k").agg(F.sum("occ").alias("total"), F.count_distinct(F.when(F.col("grp") == NAMES, F.col("o"))).alias("others"))
    keys = cut(keys)
    mass = keys.groupBy("grp").agg(F.sum("total").alias("mass"))
    base = keys.join(maybe_broadcast(seeds), ["grp", "k"]).groupBy("grp", "type").agg(F.sum("total").alias("seeded")).join(F.broadcast(mass), "grp").select("grp", "type", (F.col("seeded") / F.col("mass")).alias("base"))
    base = F.broadcast(base)  # a row for each type
    loose = keys.where(f"grp in ({MAILS}, {STREETS})").select("grp", "k", F.lit(0).cast("bigint").alias("p"), F.lit(PRIOR_OCCURRENCES).cast("bigint").alias("occ"))
    prior = spark.createDataFrame([(MAILS, 0, 4, PRIOR), (STREETS, 0, 5, PRIOR)], "grp int, p bigint, type int, score double")
    links = flat.select("grp", "k", "p", "occ").unionByName(loose)
    trust, pattern = seeds, None
    for _ in range(rounds):
        sums = flat.join(maybe_broadcast(trust), ["grp", "k"]).groupBy("grp", "p", "type")
        given = sums.agg(F.sum(F.col("n") * F.col("score")).alias("got"), F.sum(F.col("occ") * F.col("score")).alias("held"), F.max("total").alias("total"))
        share = F.col("got") / (F.col("got") + F.col("total") - F.col("held") + 2.0)
        pattern = given.where("got >= 3").join(base, ["grp", "type"]).withColumn("score", share)
        pattern = pattern.withColumn("score", F.expr(f"if(grp = {NUMBERS}, least(1D, score / least({LIFT} * base, {SHARE})), score)")).select("grp", "p", "type", "score").where("score > 0.05")
        pattern = cut(pattern)
        back = links.join(maybe_broadcast(pattern.unionByName(prior)), ["grp", "p"]).groupBy("grp", "k", "type").agg((F.sum(F.col("occ") * F.col("score")) / 2).alias("got"))
        learned = back.join(keys, ["grp", "k"]).where(f"grp <> {NAMES} or others >= 3").select("grp", "k", "type", (F.col("got") / (F.col("total") + 1.0)).alias("score")).where("score > 0.15")
        trust = cut(learned.unionByName(seeds).groupBy("grp", "k", "type").agg(F.least(F.max("score"), F.lit(1.0)).alias("score")))
    people = edges.where(f"grp = {NAMES}").join(maybe_broadcast(pattern.where(f"grp = {NAMES}").select("p", "score")), "p", "left")
    once = F.when(F.col("p").bitwiseAND(1) == 0, F.col("occ"))
    fam = people.groupBy("o").agg((F.sum(F.col("occ") * F.coalesce("score", F.lit(0.0))) / (F.sum("occ") + 1.0)).alias("family_score"), (F.sum(once) <= 3 * F.count_distinct("k") + 3).alias("rare"))
    return pattern, trust, fam


def extract(texts: DataFrame, keys: list[str], enough: float = 0.5) -> DataFrame:
    """(keys, pii_type, char_start, char_end): every mention of personal data in ``text``.

    ``keys`` identify a text; rows repeated under the same keys and text count once, null keys are kept as they are, other
    columns are ignored, whatever their names. Null and empty texts give nothing, texts are read whole, of any length,
    equal texts under different keys give equal mentions, an empty table gives no rows. Where candidates overlap, e-mail
    and street addresses stay before numbers and these before names, then the better trusted and then the longer one (a
    full tie: the earlier).
    """
    names = [f"k{i}_" for i in range(len(keys))]
    own = texts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "text").where("text is not null and text <> ''")
    found = cut(scan(own))
    pattern, trust, family = graph_scores(found)
    near = found.join(maybe_broadcast(trust.withColumnRenamed("score", "key_score")), ["grp", "k"], "left").withColumn("key_score", F.coalesce("key_score", F.lit(0.0)))
    near = near.withColumn("type", F.expr(f"coalesce(type, case grp when {NAMES} then 3 when {MAILS} then 4 when {STREETS} then 5 end)")).where("type is not null")
    for side, score in (("l", "ls"), ("a", "as_")):
        near = near.join(maybe_broadcast(pattern.select("grp", "type", F.col("p").alias(side), F.col("score").alias(score))), ["grp", "type", side], "left")
    near = near.withColumn("ctx", F.greatest(F.coalesce("ls", F.lit(0.0)), F.coalesce("as_", F.lit(0.0))))
    initial = F.col("k") == F.xxhash64(F.lit(NAMES), F.lit(INITIAL))
    sure = f"case grp when {NUMBERS} then key_score >= {enough} or (key_score >= {enough} * 0.6 and ctx >= {enough}) when {NAMES} then false else key_score >= {enough} * 0.6 or ctx >= {enough} end"
    fixed = near.where(sure).select(*names, "start", "stop", "type", (F.col("key_score") + 0.2 * F.col("ctx")).alias("prior"))
    people = near.where(f"grp = {NAMES}").withColumn("known", initial | F.expr(f"key_score >= {enough} or (key_score > 0.15 and ctx >= {enough})")).where("known or key_score >= 0.9").join(family, "o", "left")
    # a given name that is sure, with a family name that is no fixed phrase's word
    people = people.where(f"(known and (ctx >= {enough} or coalesce(family_score, 0) >= {enough} * 0.6)) or (key_score >= 0.9 and coalesce(rare, false))")
    people = people.select(*names, "start", "stop", F.lit(3).alias("type"), (F.col("key_score") + F.coalesce("family_score", F.lit(0.0))).alias("prior"))
    every = fixed.unionByName(people).withColumn("rank", F.expr("case type when 3 then 0 when 1 then 1 when 2 then 1 else 2 end"))
    # chains of overlapping mentions within a text: a few mentions each, however many the text has
    order = Window.partitionBy(*names).orderBy("start", "stop")
    every = every.withColumn("before", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    every = every.withColumn("chain", F.sum(F.expr("if(start < before, 0, 1)")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = every.groupBy(*names, "chain").agg(F.collect_set(F.struct("start", "stop", "type", "prior", "rank")).alias("m"))
    better = F.expr("array_sort(m, (x, y) -> case when x.rank <> y.rank then if(x.rank > y.rank, -1, 1) when round(x.prior, 1) <> round(y.prior, 1) then if(x.prior > y.prior, -1, 1) when x.stop - x.start <> y.stop - y.start then if(x.stop - x.start > y.stop - y.start, -1, 1) else x.start - y.start end)")
    kept = F.expr("aggregate(m, cast(array() as array<struct<start: int, stop: int, type: int, prior: double, rank: int>>), (acc, x) -> if(exists(acc, k -> x.start < k.stop and k.start < x.stop), acc, concat(acc, array(x))))")
    out = grouped.withColumn("m", F.when(F.size("m") > 1, better).otherwise(F.col("m"))).withColumn("m", F.when(F.size("m") > 1, kept).otherwise(F.col("m"))).select(*names, F.explode("m").alias("x"))
    said = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("x.type"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], said.alias("pii_type"), F.col("x.start").cast("bigint").alias("char_start"), F.col("x.stop").cast("bigint").alias("char_end"))


def redact(texts: DataFrame, keys: list[str], mentions: DataFrame) -> DataFrame:
    """``texts`` (keys and text) with ``redacted``: each mention replaced by its type in square brackets.

    Texts without mentions come out as they are, null texts null; other columns than keys and text are left out.
    ``mentions`` is what ``extract`` returns for the same keys. Each text is put together once, in its length.
    """
    said = texts.select(*keys, "text")
    lists = mentions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "pii_type"))).alias("m"))
    lists = lists.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "m")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    joined = said.join(lists, same, "left").drop(*[f"_{i}" for i in range(len(keys))])
    columns = said.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in said.schema.fields) + ", redacted string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for text, found in zip(b.column("text").to_pylist(), b.column("m").to_pylist()):
                if text is None or not found:
                    done.append(text)
                    continue
                at, parts = 0, []
                for m in found:
                    parts += [text[at : m["char_start"]], "[", m["pii_type"], "]"]
                    at = m["char_end"]
                done.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(done, pa.string())], [*columns, "redacted"])

    return joined.mapInArrow(run, schema)
