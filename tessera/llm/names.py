"""Variant spellings of names: a symmetric-delete index on tokens, then optimal assignment of tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut, maybe_broadcast

# Nicknames of common given names.
NICKNAMES = {
    k: v.split()
    for k, v in {
        "abigail": "abby gail", "alexander": "alex al sandy xander", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs barbie", "benjamin": "ben benny benji",
        "charles": "charlie chuck charley", "christopher": "chris kit topher", "cynthia": "cindy", "daniel": "dan danny", "deborah": "deb debbie debby", "dorothy": "dot dottie dolly dottie",
        "edward": "ed eddie ted ned teddy", "eleanor": "ellie nell nora nellie elly", "elizabeth": "liz beth betty eliza lizzie betsy lisa", "frederick": "fred freddie freddy", "gertrude": "trudy gertie gert",
        "gregory": "greg", "henrietta": "hettie etta hattie", "ignatius": "iggy nate", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "joseph": "joe joey", "josephine": "jo josie",
        "katherine": "kate kathy katie kay kit kat kathie", "lawrence": "larry laurie", "leonard": "leo len lenny", "margaret": "maggie meg peggy marge greta", "matthew": "matt", "michael": "mike mick mickey",
        "nicholas": "nick nico", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty trish tricia patsy", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich richie ricky",
        "robert": "bob rob bobby bert robbie", "samuel": "sam sammy", "stephen": "steve stevie", "susan": "sue suzy susie", "teresa": "terry tess tessa terri", "thomas": "tom tommy",
        "timothy": "tim timmy", "umberto": "berto", "ursula": "uschi ursel", "valerie": "val", "victoria": "vicky tori vic vicki", "walter": "walt wally", "william": "bill will billy liam willy", "zachary": "zach zack zac",
    }.items()
}
# Titles, legal forms and words of organisation names that tell nothing.
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "sir", "herr", "frau", "mme", "jr", "sr"}
FORMS = {"inc", "incorporated", "ltd", "limited", "llc", "llp", "plc", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "group", "foundation", "the", "and"}
FOLD = str.maketrans({"ø": "o", "ł": "l", "æ": "a", "œ": "o", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "&": " ", "-": " ", "–": " ", "‐": " ", "_": " ", "/": " "})
CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ]{2})(?=[A-ZÀ-ÖØ-ÞŁ][a-zà-öø-ÿ]{2})")
KEEP = re.compile(r"[^\w\s,]")
# Spellings of one ending in several languages.
ENDINGS, QUIST, LEY = re.compile(r"(?<=\w{3})(?:wicz|witz|vitch|vich|vitz)$"), re.compile(r"(?<=\w{2})[kq]vist$"), re.compile(r"(?<=\w{4})lie$")
INITIALS = re.compile(r"\b(\w)\.(?=\w\b)")


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens without accents, punctuation and titles; what a comma turns around is turned back."""
    t = unicodedata.normalize("NFKC", text)
    t = CAMEL.sub(" ", t)
    t = re.sub(r"(?i)\bs\.\s?a\.?(?=\W|$)", " sa ", t)
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower().translate(FOLD)) if not unicodedata.combining(c))
    t = INITIALS.sub(r"\1 ", t).replace(".", " ")
    t = re.sub(r"(?<=\w)['’](?=\w)", "", t)
    t = KEEP.sub(" ", t)
    parts = [p.split() for p in t.split(",")]
    flat = [w for p in ([*parts[1:2], parts[0], *parts[2:]] if len(parts) > 1 else parts) for w in p]
    while len(flat) > 1 and flat[0] in TITLES:
        flat = flat[1:]
    return [LEY.sub("ley", ENDINGS.sub("vic", QUIST.sub("quist", w))) for w in flat]


def reach(token: str) -> int:
    """Edits allowed in a token of this length."""
    return 0 if len(token) < 4 else 1


def deletes(token: str, most: int) -> set[str]:
    """The token with up to ``most`` characters left out."""
    out, last = {token}, {token}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits (swapping neighbours is one) between two tokens, most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def abbreviation_cost(short: str, full: str) -> float:
    """Cost of reading ``short`` as ``full`` with letters left out: a start of it, or its first letter and others in order."""
    if not 2 <= len(short) < len(full) or short[0] != full[0]:
        return 9.0
    missing = 0.1 * (1 - len(short) / len(full))
    if full.startswith(short):
        return 0.2 + missing if len(short) >= 3 else 9.0
    it = iter(full)
    return 0.35 + missing if len(short) <= 0.7 * len(full) and all(c in it for c in short) else 9.0


def token_cost(said: str, meant: str, person: bool, given: bool) -> float:
    """Cost of reading ``said`` as ``meant``; 9 if it cannot be."""
    if said == meant:
        return 0.0
    best = 9.0
    if given:
        if len(said) == 1:
            return 0.5 if meant.startswith(said) else 9.0
        nick = NICKNAMES.get(meant, ())
        if said in nick:
            return 0.2
        if len(said) >= 4 and any(len(n) >= 4 and distance(said, n, 1) == 1 for n in nick):
            best = 1.4
    most = reach(meant)
    d = distance(said, meant, most)
    if d <= most:
        best = min(best, float(d))
    return best if person else min(best, abbreviation_cost(said, meant))


def least_assignment(cost: list[list[float]]) -> float:
    """Least total of a square cost matrix with one entry a row and column: shortest augmenting paths with potentials."""
    n = len(cost)
    row_gain, column_gain, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        row_of[n], at = i, n  # column n stands for the row that is being placed
        slack, came, done = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while row_of[at] != n:
            done[at] = True
            r, step, nearest = row_of[at], float("inf"), 0
            for j in range(n):
                if not done[j]:
                    reduced = cost[r][j] - row_gain[r] - column_gain[j]
                    if reduced < slack[j]:
                        slack[j], came[j] = reduced, at
                    if slack[j] < step:
                        step, nearest = slack[j], j
            for j in range(n + 1):
                if done[j]:
                    row_gain[row_of[j]] += step
                    column_gain[j] -= step
                elif j < n:
                    slack[j] -= step
            at = nearest
        while at != n:
            row_of[at], at = row_of[came[at]], came[at]
    return sum(cost[row_of[j]][j] for j in range(n))


def leftover_cost(said: str, person: bool) -> float:
    """Cost of a token that means none of the entity's: initials of persons, forms of organisations, misspelled or not."""
    if person:
        return 0.1 if len(said) == 1 else 9.0
    return 0.0 if said in FORMS or any(len(f) > 4 and distance(said, f, 1) <= 1 for f in FORMS) else 9.0


def assign(said: list[str], meant: list[str], person: bool) -> float:
    """Least total cost of giving each token of the entity a token of the mention of its own; 9 or more if none fits.

    Up to three tokens may be left over, of the kinds that ``leftover_cost`` allows; they are rows of the matrix too.
    """
    if not person:
        core = [t for t in said if t not in FORMS]
        said = core if len(core) >= len(meant) else said
    if not len(meant) <= len(said) <= len(meant) + 3:
        return 9.0
    if said == meant:
        return 0.0
    cost = [[token_cost(s, m, person, person and k < len(meant) - 1) for s in said] for k, m in enumerate(meant)]
    if len(said) > len(meant):
        spare = [leftover_cost(s, person) for s in said]
        cost += [spare] * (len(said) - len(meant))
    if len(said) == 2:
        return min(cost[0][0] + cost[1][1], cost[0][1] + cost[1][0])
    return least_assignment(cost)


def entity_rows(known: DataFrame) -> DataFrame:
    """(entity_id, person, tokens, anchors) of the known entities; anchors are the tokens a mention must come near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, name, kind in zip(b.entity_id, b.display_name, b.kind):
                person = kind == "person"
                t = tokens_of(name)
                core = t if person else ([w for w in t if w not in FORMS] or t)
                if core:
                    glued = ["".join(core), "".join(core[-1:] + core[:-1])]
                    out.append((i, person, core, core[-1:] if person else core[:1], glued))
            yield pd.DataFrame(out, columns=["entity_id", "person", "meant", "anchors", "glued"])

    return known.where("entity_id is not null and display_name is not null").select("entity_id", "display_name", "kind").mapInPandas(run, "entity_id bigint, person boolean, meant array<string>, anchors array<string>, glued array<string>")


def glued_reach(name: str) -> int:
    """Edits allowed in a whole name written together."""
    return 0 if len(name) < 6 else 1


def delete_rows(words: DataFrame, column: str, most: Callable[[str], int]) -> DataFrame:
    """(column, del) for every word: its symmetric-delete neighbourhood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, d) for w in b[column] for d in deletes(w, most(w))]
            yield pd.DataFrame(rows, columns=[column, "del"])

    return words.select(column).mapInPandas(run, f"{column} string, del string")


def near(words: DataFrame, index: DataFrame, most: Callable[[str], int]) -> DataFrame:
    """(word, anchor) pairs that share an entry of their delete neighbourhoods.

    Words that are longer by more than an edit than every anchor have no neighbour and are left out before any are made.
    """
    longest = index.agg(F.max(F.length("anchor")).alias("_longest"))
    words = words.distinct().crossJoin(F.broadcast(longest)).where(F.length("word") <= F.col("_longest") + 1).select("word")  # one row
    left = delete_rows(words, "word", most)
    right = delete_rows(index.select("anchor").distinct(), "anchor", most)
    return left.join(maybe_broadcast(right), "del").select("word", "anchor").distinct()


def align(pairs: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """(raw, entity_id, cost) of the candidate pairs whose tokens can be assigned within the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            costs = [assign(list(s), list(m), bool(p)) for s, m, p in zip(b.said, b.meant, b.person)]
            b = b.assign(cost=costs)
            yield b.loc[b.cost <= threshold, ["raw", "entity_id", "cost"]]

    full = pairs.join(maybe_broadcast(entities.select("entity_id", "person", "meant")), "entity_id")
    return full.select("raw", "said", "entity_id", "person", "meant").mapInPandas(run, "raw string, entity_id bigint, cost double")


def link(mentions: DataFrame, known: DataFrame, keys: list[str], column: str = "text", threshold: float = 2.3) -> DataFrame:
    """(keys, entity_id) of the rows of ``mentions`` that mean a known entity.

    Each distinct spelling is resolved once: tokens near an entity's family name or first word by the delete index give
    candidates, optimal assignment of tokens decides; spellings without a candidate are compared run together (missing
    or stray spaces; exactly if shorter than six letters). Names of any length take part. Nearest entity wins; a spelling as near to two entities means neither. Null and blank spellings
    and those that mean no known entity give no row; repeated rows count once; null keys are kept; columns but ``keys``
    and ``column`` are ignored, whatever their names. An empty table on either side gives no rows.
    """
    entities = cut(entity_rows(known))

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [tokens_of(t) for t in b.raw]
            yield pd.DataFrame({"raw": b.raw, "said": said, "glued": ["".join(w for w in s if w not in FORMS) for s in said]})

    raws = mentions.select(F.col(column).alias("raw")).where("raw is not null and trim(raw) <> ''").distinct()
    spelled = cut(raws.mapInPandas(tokenise, "raw string, said array<string>, glued string"))
    anchors = entities.select("entity_id", F.explode("anchors").alias("anchor"))
    words = spelled.select("raw", "said", F.explode(F.array_distinct("said")).alias("word"))
    close = near(words.select("word"), anchors, reach)
    pairs = words.join(close, "word").join(maybe_broadcast(anchors), "anchor").select("raw", "said", "entity_id").distinct()
    first = cut(align(pairs, entities, threshold))

    left = spelled.join(first.select("raw").distinct(), "raw", "left_anti").where("glued <> ''")
    whole = entities.select("entity_id", F.explode("glued").alias("anchor"))
    close2 = near(left.select(F.col("glued").alias("word")), whole, glued_reach).where("word = anchor or least(length(word), length(anchor)) >= 6")
    second = left.join(close2, left.glued == close2.word).join(maybe_broadcast(whole), "anchor").select("raw", "entity_id", F.lit(1.5).alias("cost")).distinct()

    every = first.unionByName(second)
    best = Window.partitionBy("raw").orderBy("cost", "entity_id")
    rivals = F.count("*").over(Window.partitionBy("raw", "cost"))
    chosen = every.withColumn("_rivals", rivals).withColumn("_r", F.row_number().over(best)).where("_r = 1 and _rivals = 1").select("raw", "entity_id")
    named = mentions.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], F.col(column).alias("raw")).distinct()
    out = named.join(maybe_broadcast(chosen), "raw")
    return out.select(*[F.col(f"k{i}_").alias(k) for i, k in enumerate(keys)], "entity_id").distinct()
