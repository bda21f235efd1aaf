"""Facts: cards extracted by rules, versioned slots, schema inference, triple patterns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = r"(?:\.|,|!|\?|$)"
NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"
WHO = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"

# Fixed values: (rule, kind, polarity, entity, slot, value, pattern). NAME is the name group of third-person rules.
RULES: list[tuple[str, str, str | None, str, str, str, str]] = [
    ("employer", "fact", None, "user", "employer", "$1", r"(?i)(?:I work at|I'm employed at|I work for|my employer is|I'm at)\s+([A-Z][a-zA-Z0-9\s&]+?)(?:\.|,|!|\?|$)"),
    ("job_title", "fact", None, "user", "job_title", "$1", r"(?i)(?:I am a|I'm a|I work as a|my job is|my role is|my title is)\s+([A-Za-z][a-zA-Z\s]+?)(?:\.|,|!|\?|$| at)"),
    ("location", "fact", None, "user", "location", "$1", r"(?i)(?:I live in|I'm based in|I'm from|I reside in|my home is in)\s+([A-Z][a-zA-Z\s,]+?)(?:\.|!|\?|$)"),
    ("name", "profile", None, "user", "name", "$1", r"(?i)(?:my name is|I'm|call me|I am)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)(?:\.|,|!|\?|$)"),
    ("age", "profile", None, "user", "age", "$1", r"(?i)(?:I am|I'm)\s+(\d{1,3})\s+(?:years old|yrs old|yo)(?:\.|,|!|\?|$|\s)"),
    ("food_like", "preference", "positive", "user", "food_preference", "$1", r"(?i)(?:I (?:really )?(?:love|like|enjoy|prefer|adore))\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("food_dislike", "preference", "negative", "user", "food_preference", "$1", r"(?i)(?:I (?:really )?(?:hate|dislike|can't stand|don't like|avoid))\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("allergy", "profile", None, "user", "allergy", "$1", r"(?i)(?:I am|I'm) allergic to\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("programming_language", "preference", "positive", "user", "programming_language", "$1", r"(?i)(?:I (?:really )?(?:love|like|enjoy|prefer) (?:programming in|coding in|using|writing))\s+([\w\+\#]+)(?:\.|,|!|\?|$|\s)"),
    ("hobby", "preference", None, "user", "hobby", "$1", r"(?i)(?:my hobby is|I enjoy|I like to|my favorite hobby is|my favourite hobby is)\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("pet", "fact", None, "user", "pet", "$1", r"(?i)(?:I have a|my pet is a|I own a)\s+([\w\s]+?)(?:\s+named|\.|,|!|\?|$)"),
    ("pet_name", "fact", None, "user", "pet_name", "$1", r"(?i)(?:my (?:pet|dog|cat|bird|fish|hamster)'?s? name is|I have a [\w\s]+ named)\s+([A-Z][a-z]+)(?:\.|,|!|\?|$)"),
    ("birthday", "profile", None, "user", "birthday", "$1", r"(?i)(?:my birthday is|I was born on|born on)\s+(\w+\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?)(?:\.|,|!|\?|$)"),
    ("email", "profile", None, "user", "email", "$1", r"(?i)(?:my email is|email me at|reach me at)\s+([\w\.\-]+@[\w\.\-]+\.\w+)"),
    ("family", "relationship", None, "user", "$1", "$2", r"(?i)my\s+(wife|husband|spouse|partner|son|daughter|child|brother|sister|mother|father|mom|dad|grandma|grandmother|grandpa|grandfather)'?s?\s+(?:name is|is named)\s+([A-Z][a-z]+)"),
    ("travel", "event", None, "user", "travel", "$1", r"(?i)(?:I (?:went|traveled|travelled|visited|am going|will go|am visiting) to)\s+([A-Z][a-zA-Z\s,]+?)(?:\s+(?:last|this|next)|\.|,|!|\?|$)"),
    ("3p_employer_works_at", "fact", None, "$1", "employer", "$2", NAME + r"\s+(?i:works at|works for|is employed at|is employed by|joined|is at)\s+([A-Z][a-zA-Z0-9\s&]+?)(?:\.|,|!|\?|$|\s+(?:as|in|since))"),
    ("3p_role_at_company", "fact", None, "$1", "role", "$2 at $3", NAME + r"\s+is\s+(?:the\s+)?([A-Za-z\s]+?)\s+(?:of|at)\s+([A-Z][a-zA-Z0-9\s&]+?)(?:\.|,|!|\?|$)"),
    ("3p_title_appositive", "fact", None, "$1", "role", "$2 at $3", NAME + r",\s+(?:the\s+)?([A-Za-z\s]+?)\s+(?:of|at)\s+([A-Z][a-zA-Z0-9\s&]+?)(?:\.|,|!|\?|$)"),
    ("3p_location_lives", "fact", None, "$1", "location", "$2", NAME + r"\s+(?i:lives in|is based in|resides in|is from|comes from|moved to|relocated to)\s+([A-Z][a-zA-Z\s,]+?)(?:\.|!|\?|$)"),
    ("3p_location_resident", "fact", None, "$1", "location", "$2", NAME + r"\s+is\s+(?:a\s+)?([A-Z][a-zA-Z\s]+?)(?:\s+resident|\s+native)(?:\.|,|!|\?|$)"),
    ("3p_job_title", "fact", None, "$1", "job_title", "$2", NAME + r"\s+is\s+(?:a|an)\s+([A-Za-z][a-zA-Z\s]+?)(?:\.|,|!|\?|$|\s+(?:at|who|and|with))"),
    ("3p_job_works_as", "fact", None, "$1", "job_title", "$2", NAME + r"\s+works\s+as\s+(?:a|an)\s+([A-Za-z][a-zA-Z\s]+?)(?:\.|,|!|\?|$|\s+(?:at|in|for))"),
    ("3p_relationship_married", "relationship", None, "$1", "spouse", "$2", NAME + r"\s+is\s+(?i:married to|engaged to|dating|in a relationship with|the (?:wife|husband|partner|spouse) of)\s+" + WHO + END),
    ("3p_relationship_pair", "relationship", None, "$1", "spouse", "$2", NAME + r"\s+and\s+" + WHO + r"\s+are\s+(?i:married|engaged|dating|partners|a couple)" + END),
    ("3p_relationship_possessive", "relationship", None, "$1", "spouse", "$2", NAME + r"\s+is\s+" + WHO + r"'s\s+(wife|husband|partner|spouse|girlfriend|boyfriend|fiancé|fiancee)" + END),
    ("3p_relationship_poss_is", "relationship", None, "$1", "spouse", "$2", NAME + r"'s\s+(?:wife|husband|partner|spouse|girlfriend|boyfriend)\s+is\s+" + WHO + END),
    ("3p_family_member", "relationship", None, "$1", "$3", "$2", NAME + r"\s+is\s+" + WHO + r"'s\s+(mother|father|sister|brother|son|daughter|aunt|uncle|cousin|grandmother|grandfather|grandma|grandpa|mom|dad)" + END),
    ("3p_family_named", "relationship", None, "$1", "$2", "$3", NAME + r"\s+has\s+(?:a\s+)?(brother|sister|son|daughter|mother|father)\s+(?:named|called)\s+" + WHO + END),
    ("3p_preference_positive", "preference", "positive", "$1", "preference", "$2", NAME + r"\s+(?i:loves|likes|enjoys|adores|prefers|is fond of)\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("3p_preference_negative", "preference", "negative", "$1", "preference", "$2", NAME + r"\s+(?i:hates|dislikes|despises|can't stand|doesn't like|avoids)\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("3p_favorite", "preference", None, "$1", "favorite_$2", "$3", NAME + r"'s\s+(?i:favorite|favourite)\s+(\w+)\s+is\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("3p_education_studied", "fact", None, "$1", "education", "$2", NAME + r"\s+(?i:studied at|graduated from|attends|attended|went to|goes to)\s+([A-Z][a-zA-Z\s]+?(?:University|College|Institute|School|Academy)?)(?:\.|,|!|\?|$)"),
    ("3p_education_degree", "fact", None, "$1", "degree", "$2", NAME + r"\s+has\s+(?:a\s+)?(?i:degree|PhD|doctorate|masters?|bachelors?|BA|BS|MS|MBA)\s+in\s+([A-Za-z\s]+?)(?:\.|,|!|\?|$|\s+from)"),
    ("3p_education_major", "fact", None, "$1", "field_of_study", "$2", NAME + r"\s+(?i:majored in|minored in|studied)\s+([A-Za-z\s]+?)(?:\.|,|!|\?|$|\s+at)"),
    ("3p_age", "profile", None, "$1", "age", "$2", NAME + r"\s+is\s+(\d{1,3})\s*(?:years old|yrs old|yo)?(?:\.|,|!|\?|$|\s)"),
    ("3p_birthdate", "profile", None, "$1", "birthdate", "$2", NAME + r"\s+was\s+born\s+(?:in|on)\s+(\w+(?:\s+\d{1,2}(?:st|nd|rd|th)?)?(?:,?\s+\d{4})?)(?:\.|,|!|\?|$)"),
    ("3p_birthplace", "profile", None, "$1", "birthplace", "$2", NAME + r"\s+(?:is|was)\s+(?:originally\s+)?from\s+([A-Z][a-zA-Z\s,]+?)(?:\.|!|\?|$|\s+but)"),
    ("3p_email", "profile", None, "$1", "email", "$2", NAME + r"'s\s+email\s+(?:is|address is)\s+([\w\.\-]+@[\w\.\-]+\.\w+)"),
    ("3p_hobby_plays", "preference", None, "$1", "hobby", "$2", NAME + r"\s+plays\s+(?:the\s+)?([\w\s]+?)(?:\.|,|!|\?|$|\s+(?:every|on|and))"),
    ("3p_interest", "preference", None, "$1", "interest", "$2", NAME + r"\s+is\s+(?i:into|interested in|passionate about|really into)\s+([\w\s]+?)(?:\.|,|!|\?|$)"),
    ("3p_pet_named", "fact", None, "$1", "pet_name", "$3", NAME + r"\s+has\s+(?:a\s+)?(dog|cat|bird|fish|hamster|rabbit|pet)\s+(?:named|called)\s+([A-Z][a-z]+)(?:\.|,|!|\?|$)"),
    ("3p_pet_poss_named", "fact", None, "$1", "pet_name", "$3", NAME + r"'s\s+(dog|cat|bird|fish|hamster|rabbit|pet)\s+is\s+(?:named|called)\s+([A-Z][a-z]+)(?:\.|,|!|\?|$)"),
    ("3p_pet_owns", "fact", None, "$1", "pet", "$2", NAME + r"\s+(?:owns|has)\s+(?:a\s+)?([\w\s]+?)\s+(?:dog|cat|bird|fish|hamster|rabbit)(?:\.|,|!|\?|$)"),
    ("3p_travel", "event", None, "$1", "travel", "$2", NAME + r"\s+(?i:visited|traveled to|travelled to|went to|is going to|will visit)\s+([A-Z][a-zA-Z\s,]+?)(?:\s+(?:last|this|next)|\.|,|!|\?|$)"),
    ("3p_career_event", "event", None, "$1", "career_event", "$2", NAME + r"\s+(?i:started|joined|left|quit|founded)\s+(?:at\s+)?([A-Z][a-zA-Z0-9\s&]+?)(?:\s+in\s+\d{4})?(?:\.|,|!|\?|$)"),
]
# Predicates known from the start, with their value types and whether they may have several values.
PREDICATES = [
    ("employer", "string", False), ("workplace", "string", False), ("job_title", "string", False), ("occupation", "string", False), ("location", "string", False), ("city", "string", False),
    ("country", "string", False), ("spouse", "entity_ref", False), ("manager", "entity_ref", False), ("likes", "string", True), ("dislikes", "string", True), ("preference", "string", True),
    ("hobby", "string", True), ("age", "number", False), ("birthday", "datetime", False), ("education", "string", True), ("email", "string", False), ("pet", "string", True),
]


def _constant(like, text: str):
    return F.transform(like, lambda _: F.lit(text))


def _suffixed(texts, text: str):
    return F.transform(texts, lambda x: F.concat(x, F.lit(text)))


def _cards(zipped, rule: str, kind: str, polarity: str | None):
    said = lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(polarity).cast("string").alias("polarity"), x["entity"].alias("entity"), x["slot"].alias("slot"), F.trim(x["value"]).alias("value"))
    return F.transform(zipped, said)


def template(text: str, pattern: str, column):
    """A ``$n`` template filled from all matches: an array of strings, one for each match."""
    pieces = re.split(r"\$(\d)", text)
    columns = [F.regexp_extract_all(column, F.lit(pattern), int(p)) if i % 2 else p for i, p in enumerate(pieces) if i % 2 or p]
    groups = [c for c in columns if not isinstance(c, str)]
    if not groups:
        return None
    out = None
    for c in columns:
        if isinstance(c, str):
            out = _constant(groups[0], c) if out is None else _suffixed(out, c)
        else:
            out = c if out is None else F.zip_with(out, c, lambda x, y: F.concat(x, y))
    return out


def extract(frames: DataFrame, rules: list[tuple] | None = None, text: str = "search_text") -> DataFrame:
    """(frame_id, rule, kind, polarity, entity, slot, value) cards of all rules, one pass over the text.

    Each rule becomes an array expression; the arrays are concatenated and exploded once, so the text is read once and
    no Python runs. Entities and slots are lower-case and trimmed.
    """
    every = []
    for name, kind, polarity, entity, slot, value, pattern in rules or RULES:
        col = F.col(text)
        values = template(value, pattern, col)
        low = lambda x: F.lower(F.trim(x))
        who, what = template(entity, pattern, col), template(slot, pattern, col)
        who = _constant(values, entity) if who is None else F.transform(who, low)
        what = _constant(values, slot) if what is None else F.transform(what, low)
        zipped = F.zip_with(F.zip_with(who, what, lambda a, b: F.struct(a.alias("entity"), b.alias("slot"))), values, lambda a, v: F.struct(a["entity"].alias("entity"), a["slot"].alias("slot"), v.alias("value")))
        cards = _cards(zipped, name, kind, polarity)
        every.append(F.when(col.rlike(pattern), cards))
    found = F.filter(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<struct<rule:string,kind:string,polarity:string,entity:string,slot:string,value:string>>")) for c in every])), lambda x: x.value != "")
    return frames.select("frame_id", F.explode(found).alias("c")).select("frame_id", "c.*")


def effective(cards: DataFrame) -> DataFrame:
    """Adds ``eff_ts``: event, else document, else creation time."""
    return cards.withColumn("eff_ts", F.coalesce(*[c for c in ("event_date", "document_date", "created_at") if c in cards.columns]))


def slot_values(cards: DataFrame, at: int | None = None) -> DataFrame:
    """The value of each (entity, slot) now, or as of a time: the newest card that is no retraction.

    Entities and slots are compared in lower case; equal times go to the greater card_id. One partial row for each key
    and task, so an entity with a third of all cards is no hot spot.
    """
    live = cards.where("relation is null or relation <> 'retracts'")
    if at is not None:
        live = live.where(F.col("eff_ts") <= at)
    key = [F.lower("entity").alias("entity"), F.lower("slot").alias("slot")]
    return live.groupBy(*key).agg(F.max_by(F.struct("value", "eff_ts", "card_id"), F.struct("eff_ts", "card_id")).alias("x")).select("entity", "slot", "x.value", "x.eff_ts", "x.card_id")


def slot_fold(cards: DataFrame, newest_first: bool = False) -> DataFrame:
    """(entity, slot, values): the set of values after adding ('sets', 'updates', 'extends') and removing ('retracts') in
    the order of time, sorted; slots that end empty are left out.

    The last card about a value decides it, so the fold is one grouped maximum over (entity, slot, value). With
    ``newest_first`` the cards are folded from the one inserted last backwards, so the first about a value decides.
    """
    c = cards.withColumn("entity", F.lower("entity")).withColumn("slot", F.lower("slot"))
    decides = F.min_by("relation", "card_id") if newest_first else F.max_by("relation", F.struct("eff_ts", "card_id"))
    kept = c.groupBy("entity", "slot", "value").agg(decides.alias("relation")).where("relation is distinct from 'retracts'")
    return kept.groupBy("entity", "slot").agg(F.array_sort(F.collect_set("value")).alias("values"))


def superseded(cards: DataFrame) -> DataFrame:
    """(card_id, superseded_by): cards that a strictly later update or retraction of the same entity and slot replaces,
    with the first such card (on equal times the least id).

    Updates of a slot are cut to one for each time, and each card looks for the next time among these.
    """
    key = [F.lower("entity").alias("_e"), F.lower("slot").alias("_s")]
    rows = cards.select("card_id", "eff_ts", *key)
    news = cards.where("relation in ('updates', 'retracts')").select("card_id", "eff_ts", *key).groupBy("_e", "_s", "eff_ts").agg(F.min("card_id").alias("by"))
    times = rows.select("_e", "_s", "eff_ts").unionByName(news.select("_e", "_s", "eff_ts")).distinct().join(news, ["_e", "_s", "eff_ts"], "left")
    ahead = Window.partitionBy("_e", "_s").orderBy("eff_ts").rowsBetween(1, Window.unboundedFollowing)
    next_ = times.withColumn("superseded_by", F.first("by", ignorenulls=True).over(ahead)).where("superseded_by is not null")
    return rows.join(next_.select("_e", "_s", "eff_ts", "superseded_by"), ["_e", "_s", "eff_ts"]).select("card_id", "superseded_by")


def schema_of(cards: DataFrame) -> DataFrame:
    """(slot, entities, values, distinct_values, value_type, cardinality, is_builtin) inferred from the cards.

    A slot is 'multiple' if an entity has more than one card of it or if it has more than one value overall.
    """
    c = cards.withColumn("slot", F.lower("slot")).withColumn("entity", F.lower("entity"))
    number = F.bool_and(F.expr("try_cast(value as double) is not null"))
    moment = F.bool_and(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}"))
    flag = F.bool_and(F.lower("value").isin("true", "false", "yes", "no"))
    per = c.groupBy("slot", "entity").agg(F.count("*").alias("n"), number.alias("num"), moment.alias("day"), flag.alias("yes"))
    distinct = c.groupBy("slot").agg(F.count_distinct("value").alias("distinct_values"))
    out = per.groupBy("slot").agg(F.count("*").alias("entities"), F.sum("n").alias("values"), F.max("n").alias("most"), F.bool_and("num").alias("num"), F.bool_and("day").alias("day"), F.bool_and("yes").alias("yes"))
    kind = F.when(F.col("num"), "number").when(F.col("day"), "datetime").when(F.col("yes"), "boolean").otherwise("string")
    many = F.when((F.col("most") > 1) | (F.col("distinct_values") > 1), "multiple").otherwise("single")
    builtin = F.col("slot").isin([p for p, _, _ in PREDICATES])
    return out.join(distinct, "slot").select("slot", "entities", "values", "distinct_values", kind.alias("value_type"), many.alias("cardinality"), builtin.alias("is_builtin"))


def match_triple(current: DataFrame, entity: str | None = None, slot: str | None = None, value: str | None = None) -> DataFrame:
    """Current facts with the given entity, slot, and a value that contains the given text; null matches anything."""
    out = current
    if entity is not None:
        out = out.where(F.lower("entity") == entity.lower())
    if slot is not None:
        out = out.where(F.lower("slot") == slot.lower())
    if value is not None:
        out = out.where(F.lower("value").contains(value.lower()))
    return out


def best_cards(cards: DataFrame) -> DataFrame:
    """For each entity and slot the card of the highest confidence (null is 0), the first on a tie."""
    best = F.max_by(F.struct(*cards.columns), F.struct(F.coalesce("confidence", F.lit(0.0)), (-F.col("card_id")).alias("n")))
    return cards.groupBy(F.lower("entity").alias("_e"), F.lower("slot").alias("_s")).agg(best.alias("x")).select("x.*")


def validate(cards: DataFrame, strict: bool = False) -> DataFrame:
    """Cards with ``problem``: a value that is not of its predicate's type, null if it is fine; strict raises."""
    spark = cards.sparkSession
    known = F.broadcast(spark.createDataFrame(PREDICATES, "slot string, value_type string, multiple boolean"))  # fixed rows
    joined = cards.join(known.withColumnRenamed("slot", "_slot"), F.lower("slot") == F.col("_slot"), "left")
    bad = F.when((F.col("value_type") == "number") & F.expr("try_cast(value as double) is null"), "not a number").when((F.col("value_type") == "datetime") & ~F.col("value").rlike(r"\d"), "not a date")
    if strict:
        bad = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("card "), F.col("card_id").cast("string"), F.lit(": "), bad))).otherwise(F.lit(None).cast("string"))
    return joined.withColumn("problem", bad).drop("_slot", "value_type", "multiple")


def by_entity(cards: DataFrame) -> DataFrame:
    """(entity, slots): the entities with their distinct slots, sorted."""
    return cards.groupBy(F.lower("entity").alias("entity")).agg(F.array_sort(F.collect_set(F.lower("slot"))).alias("slots"))


def history(cards: DataFrame, entity: str) -> DataFrame:
    """Cards of one entity in the order of time."""
    return cards.where(F.lower("entity") == entity.lower()).orderBy("eff_ts", "card_id")


def preferences(cards: DataFrame, entity: str | None = None) -> DataFrame:
    """(entity, slot, value, polarity): current values of the cards of kind 'preference', of one entity or all."""
    own = cards.where("kind = 'preference'")
    if entity is not None:
        own = own.where(F.lower("entity") == entity.lower())
    live = own.where("relation is null or relation <> 'retracts'")
    best = F.max_by(F.struct("value", "polarity"), F.struct("eff_ts", "card_id")).alias("x")
    return live.groupBy(F.lower("entity").alias("entity"), F.lower("slot").alias("slot")).agg(best).select("entity", "slot", "x.value", "x.polarity")
