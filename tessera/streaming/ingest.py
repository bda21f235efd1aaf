"""Streaming: change-log ingestion, deduplication, windows, and a stateful anchor tracker."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators.temporal import track
from tessera.runtime import checkpoint_dir, latest


def source(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream over the Parquet files of a folder, in arrival order; a single file is a folder filtered by its name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def workspace(spark: SparkSession, name: str, run: str | None = None) -> str:
    """A folder of its own in the shared folder; the same one again for the same name and ``run``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/stream-{name}-{run or uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append", run: str | None = None) -> DataFrame:
    """Runs a stream over what is there now into a written table, with its checkpoint beside it, and reads it back.

    With ``run`` named, a later call with the same name goes on where the last batch ended; Parquet's commit log makes
    batches count once.
    """
    path = workspace(spark, name, run)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/data")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data-{number:06d}")
        (batch.sparkSession.createDataFrame([(number,)], "n int")).write.mode("overwrite").parquet(f"{path}/last")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/log").foreachBatch(replace).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{path}/last").first()[0]  # one row
    return spark.read.schema(stream.schema).parquet(f"{path}/data-{last:06d}")


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Each key once; state is kept no longer than a key can come late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, by: list[str], late: str = "30 days") -> DataFrame:
    """Counts and sums of ``value`` by window and keys; a window's state is dropped once no row may still come for it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, by: str) -> DataFrame:
    """Activity of each key in sessions that end after a gap."""
    return stream.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


#: Buckets of keys of an upserted table: a batch rewrites those that its keys are in.
BUCKETS = 64


def upsert(stream: DataFrame, key: str | list[str], order: str, spark: SparkSession, name: str, run: str | None = None, mode: str = "append") -> DataFrame:
    """The newest row of every key over all batches.

    A batch reads and rewrites only the buckets of its own keys, into a folder of its number, and writes the list of the
    folders in which the buckets now are: at most BUCKETS rows. A batch that is run again after a failure starts from the
    list of the batch before and gives the same; with ``run`` named, a later call goes on after the last batch.
    """
    keys = [key] if isinstance(key, str) else key
    path = workspace(spark, name, run)
    schema = stream.schema

    def places(session: SparkSession, number: int) -> dict[int, int]:
        if number < 0:
            return {}
        rows = session.read.schema("bucket int, batch int").parquet(f"{path}/places/{number:06d}").collect()  # at most BUCKETS rows
        return {r["bucket"]: r["batch"] for r in rows}

    def held(session: SparkSession, at: dict[int, int]) -> DataFrame | None:
        files = [f"{path}/data/{n:06d}/_bucket={b}" for b, n in sorted(at.items())]
        return session.read.schema(schema).parquet(*files) if files else None

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        bucketed = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        mine = {r[0] for r in bucketed(batch).select("_bucket").distinct().collect()}  # at most BUCKETS rows
        before = places(session, number - 1)
        old = held(session, {b: n for b, n in before.items() if b in mine})
        both = batch if old is None else batch.unionByName(old)
        newest = latest(both, keys, [order]).select(*batch.columns)
        bucketed(newest).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/{number:06d}")
        now = sorted((before | {b: number for b in mine}).items())
        session.createDataFrame(now, "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{path}/places/{number:06d}")
        session.createDataFrame([(number,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{path}/last")

    query = stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        last = spark.read.schema("n int").parquet(f"{path}/last").first()  # one row
    except AnalysisException:  # no batch yet
        last = None
    found = held(spark, places(spark, last["n"])) if last else None
    return found if found is not None else spark.createDataFrame([], schema)


def anchored(stream: DataFrame, idle_days: int | None = None) -> DataFrame:
    """(doc_id, line, anchor) of (doc_id, line) rows: the running date of each document, kept as state between batches.

    With ``idle_days`` a document's state is dropped when it has had no line for so long. That is for a query that runs
    on: one that stops when it has read everything would wait for its timeouts for ever.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (None, 0.0)
        for p in parts:
            found, held = track(p["line"].tolist(), held)
            yield pd.DataFrame({"doc_id": key[0], "line": p["line"].tolist(), "anchor": found})
        state.update((held[0], held[1]))
        if idle_days is not None:
            state.setTimeoutDuration(idle_days * 86_400_000)

    return stream.groupBy("doc_id").applyInPandasWithState(step, "doc_id bigint, line string, anchor string", "anchor string, sure double", "append", GroupStateTimeout.NoTimeout if idle_days is None else GroupStateTimeout.ProcessingTimeTimeout)
