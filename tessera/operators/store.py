"""The store: change log, latest versions, tombstones, deduplication, timelines, statistics, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import latest, maybe_broadcast


def current_versions(log: DataFrame, key: str, order: list[str], dead: str) -> DataFrame:
    """The newest entry of each chain, without chains whose newest entry is a tombstone (``dead``, an expression)."""
    return latest(log, [key], order).where(~F.expr(dead))


def tombstones(log: DataFrame, key: str, order: list[str], dead: str) -> DataFrame:
    return latest(log, [key], order).where(F.expr(dead))


def supersessions(log: DataFrame, key: str, order: list[str], identity: str) -> DataFrame:
    """Each entry with ``superseded_by``, the next one of its chain, and ``supersedes``, the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("superseded_by", F.lead(identity).over(w)).withColumn("supersedes", F.lag(identity).over(w))


def as_of(log: DataFrame, key: str, order: list[str], moment: str) -> DataFrame:
    """The newest entry of each chain among those that satisfy ``moment``."""
    return latest(log.where(F.expr(moment)), [key], order)


def dedup(frames: DataFrame, text: str = "search_text", identity: str = "frame_id") -> DataFrame:
    """(hash, frame_id, copies): the first frame of every content; equal contents meet by their SHA-256 only."""
    hashed = frames.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("hash"), identity)
    return hashed.groupBy("hash").agg(F.min(identity).alias(identity), F.count("*").alias("copies"))


def new_frames(incoming: DataFrame, existing: DataFrame, text: str = "search_text") -> DataFrame:
    """Incoming frames whose content the store does not have yet."""
    known = existing.select(F.sha2(F.col(text), 256).alias("_hash")).distinct()
    return incoming.withColumn("_hash", F.sha2(F.col(text), 256)).join(known, "_hash", "left_anti").drop("_hash")


def timeline(frames: DataFrame, since: int | None = None, until: int | None = None, limit: int | None = 100, newest_first: bool = False) -> DataFrame:
    """Frames in time order within inclusive bounds; the limit is applied last."""
    kept = frames
    if since is not None:
        kept = kept.where(F.col("ts") >= since)
    if until is not None:
        kept = kept.where(F.col("ts") <= until)
    order = [F.desc("ts"), F.desc("frame_id")] if newest_first else [F.asc("ts"), F.asc("frame_id")]
    kept = kept.orderBy(*order)
    return kept if limit is None else kept.limit(limit)


def statistics(frames: DataFrame) -> DataFrame:
    """One row: frames, bytes, average bytes, first and last time."""
    size = F.octet_length(F.coalesce("search_text", F.lit("")))
    return frames.agg(
        F.count("*").alias("frames"),
        F.sum(size).cast("bigint").alias("bytes"),
        F.expr("cast(sum(octet_length(coalesce(search_text, ''))) div greatest(count(*), 1) as bigint)").alias("bytes_each"),
        F.count_if(F.coalesce("search_text", F.lit("")) == "").alias("empty"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def latest_by_uri(frames: DataFrame) -> DataFrame:
    """The newest frame of every uri."""
    return latest(frames.where("uri is not null"), ["uri"], ["ts", "frame_id"])


def by_uri(frames: DataFrame, active: str) -> DataFrame:
    """For every uri the newest active frame (``active`` is an expression), or the newest of all where none is active."""
    marked = frames.where("uri is not null").withColumn("_active", F.coalesce(F.expr(active), F.lit(False)))
    return latest(marked, ["uri"], ["_active", "ts", "frame_id"]).drop("_active")


def media_manifest(frames: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(frame_id, kind, width, height, seconds) of the frames whose JSON metadata has a ``media`` object."""
    media = F.from_json(metadata, "struct<media: struct<kind: string, width: int, height: int, seconds: double>>")["media"]
    return frames.select("frame_id", media.alias("m")).where("m is not null").select("frame_id", "m.kind", "m.width", "m.height", "m.seconds")


def chunk_frames(frames: DataFrame) -> DataFrame:
    """(parent_id, chunk_index, uri, title, search_text): the chunks of long frames as frames of their own."""
    from tessera.functions.text import chunks

    cut = frames.select("frame_id", "uri", "title", "search_text", chunks("search_text").alias("_c")).where("size(_c) > 0").select("*", F.posexplode("_c").alias("chunk_index", "_s"))
    number, many = (F.col("chunk_index") + 1).cast("string"), F.size("_c").cast("string")
    return cut.select(
        F.col("frame_id").alias("parent_id"),
        "chunk_index",
        F.concat("uri", F.lit("#page-"), number).alias("uri"),
        F.concat(F.coalesce("title", F.lit("")), F.lit(" (page "), number, F.lit("/"), many, F.lit(")")).alias("title"),
        F.expr("substring(search_text, _s.start + 1, _s.stop - _s.start)").alias("search_text"),
    )


def reassembled(chunks: DataFrame) -> DataFrame:
    """(parent_id, search_text): the chunks of each parent put together in the order of their index."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "search_text")))  # the chunks of one document
    return chunks.groupBy("parent_id").agg(F.array_join(F.transform(parts, lambda x: x["search_text"]), "").alias("search_text"))


def unenriched(frames: DataFrame, ledger: DataFrame, engine: str, version: str) -> DataFrame:
    """Frames that this version of an engine has not handled (ledger: frame_id, engine, version)."""
    return missing(frames, ledger.where((F.col("engine") == engine) & (F.col("version") == version)))


def capacity(frames: DataFrame, most_bytes: int) -> DataFrame:
    """One row: bytes of all texts, the limit, and whether they are over it."""
    used = F.coalesce(F.sum(F.octet_length("search_text")), F.lit(0)).cast("bigint")
    return frames.agg(used.alias("bytes")).select("bytes", F.lit(most_bytes).cast("bigint").alias("most_bytes"), (F.col("bytes") > most_bytes).alias("over"))


def intersected(frames: DataFrame, *candidates: DataFrame | None) -> DataFrame:
    """Frames whose id is in every given set of candidates (frame_id); None is no restriction, an empty set leaves none."""
    for c in candidates:
        if c is not None:
            frames = frames.join(c.select("frame_id").distinct(), "frame_id", "left_semi")
    return frames


def missing(frames: DataFrame, done: DataFrame, key: str = "frame_id") -> DataFrame:
    """Frames that a process has not handled yet."""
    return frames.join(done.select(key).distinct(), key, "left_anti")


def verify(frames: DataFrame) -> DataFrame:
    """(check, failures): quality assertions over the frames, all in one pass and one uniqueness count."""
    counted = frames.agg(
        F.count_if(F.col("frame_id").isNull()).alias("null_id"),
        F.count_if(F.col("ts").isNull()).alias("null_ts"),
        F.count_if(F.col("ts") < 0).alias("negative_ts"),
        F.count_if(F.col("uri").isNull()).alias("null_uri"),
        (F.count("frame_id") - F.count_distinct("frame_id")).alias("repeated_id"),
    )
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("failures")) for c in counted.columns])).alias("x")).select("x.check", "x.failures")


# What is done about each finding.
ACTIONS = {"null_ts": "restore_ts", "empty_text": "skip_index", "repeated_text": "dedup", "sketch_without_frame": "drop_sketch", "frame_without_sketch": "build_sketch"}


def doctor(frames: DataFrame, sketched: DataFrame) -> DataFrame:
    """(finding, n, action): a dry run over the frames and one derived table (frame_id): what is wrong and what to do.

    Actions are the functions that rebuild the derived tables; nothing is changed here.
    """
    text = F.coalesce("search_text", F.lit(""))
    plain = frames.agg(F.count_if(F.col("ts").isNull()).alias("null_ts"), F.count_if(F.trim(text) == "").alias("empty_text"))
    copies = dedup(frames.where("search_text <> ''")).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_text"))
    ids = frames.select("frame_id").distinct().withColumn("_f", F.lit(True))
    both = ids.join(sketched.select("frame_id").distinct().withColumn("_s", F.lit(True)), "frame_id", "full_outer")
    pairs = both.agg(F.count_if(F.col("_f").isNull()).alias("sketch_without_frame"), F.count_if(F.col("_s").isNull()).alias("frame_without_sketch"))
    row = plain.crossJoin(F.broadcast(copies)).crossJoin(F.broadcast(pairs))  # one row each
    found = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).cast("bigint").alias("n"), F.lit(a).alias("action")) for c, a in ACTIONS.items()])).alias("x")).select("x.*")
    return found.withColumn("action", F.when(F.col("n") > 0, F.col("action")).otherwise("none"))


def vacuum(frames: DataFrame, active: str) -> DataFrame:
    """Frames with the texts of inactive ones dropped."""
    return frames.withColumn("search_text", F.when(F.expr(active), F.col("search_text")))


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of rows (start, stop) of one key whose inclusive ranges overlap."""
    r = maybe_broadcast(right)
    return left.alias("l").join(r.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.start") <= F.col("r.stop")) & (F.col("r.start") <= F.col("l.stop")))
