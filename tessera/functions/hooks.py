"""Extension points: embedders, rerankers and extraction engines as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def embed(frames: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "search_text", batch: int = 32) -> DataFrame:
    """Adds ``embedding`` by a batch function from texts to vectors; null text gives null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if isinstance(t, str)]
        for k in range(0, len(at), batch):
            part = at[k : k + batch]
            for i, v in zip(part, embedder([texts.iloc[i] for i in part])):
                out[i] = v
        return pd.Series(out)

    return frames.withColumn("embedding", run(text))


def rerank(hits: DataFrame, scorer: Callable[[str, list[str]], list[float]], query: str, text: str = "search_text") -> DataFrame:
    """A result page rescored by a function of the query and texts, with new ranks."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.fillna("").tolist()), dtype=float)

    scored = hits.withColumn("rerank_score", run(text)).withColumnRenamed("rank", "old_rank")
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "old_rank")).cast("bigint"))


def enrich(frames: DataFrame, engine: Callable[[pd.DataFrame], pd.DataFrame], schema: str, ledger: DataFrame | None, name: str, version: str) -> DataFrame:
    """An engine's rows for the frames its version has not handled yet (ledger: frame_id, engine, version)."""
    todo = frames
    if ledger is not None:
        done = ledger.where((F.col("engine") == name) & (F.col("version") == version)).select("frame_id").distinct()
        todo = frames.join(done, "frame_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield engine(b)

    return todo.mapInPandas(run, schema)
