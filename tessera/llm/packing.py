"""Filling fixed-capacity containers: exact-complement hashing over length classes, then best fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import prefix_sums

CAPACITY = 2048
#: A vocabulary file of a public tokenizer; None finds it in the installed package of public tokenizers.
RANKS: str | None = None
RANKS_NAME = "byte_bpe_multi_50k.tiktoken"


def encoder(path: str | None = RANKS):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS_NAME), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tessera", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, text: str = "text", size: str = "size", path: str | None = RANKS) -> DataFrame:
    """Adds the number of tokens of ``text`` (null and empty: 0) and drops the text; whole texts, in Arrow batches."""
    rest = [f for f in documents.schema.fields if f.name not in (text, size)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{size}` bigint"
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for b in batches:
            enc = enc or encoder(path)
            counts = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b[text]]
            yield b[names].assign(**{size: np.array(counts, np.int64)})

    return documents.select(*names, text).mapInPandas(run, schema)


def best_pair(count: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The available pair of lengths that adds up to ``gap``, with the greatest larger one."""
    if gap < 2:
        return None
    low = np.arange(1, gap // 2 + 1)
    ok = (count[low] > 0) & (count[gap - low] > 0) & ((low != gap - low) | (count[low] > 1))
    hit = np.flatnonzero(ok)
    return (gap - int(low[hit[0]]), int(low[hit[0]])) if len(hit) else None


def exact_fill(count: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that fill ``gap`` exactly: index lookups of single, pair and triple sums."""
    if gap == 0:
        return []
    if count[gap] > 0:
        return [gap]
    pair = best_pair(count, gap)
    if pair:
        return list(pair)
    for a in np.flatnonzero(count[1 : gap - 1])[::-1] + 1:
        a = int(a)
        if 3 * a < gap:
            break
        count[a] -= 1
        rest = best_pair(count, gap - a)
        count[a] += 1
        if rest:
            return [a, *rest]
    return None


def plan_containers(lengths: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Container layouts (length -> times) with how many containers have them, using every item once.

    The longest length left is completed by an exact single, pair or triple; where there is none, the longest that fits
    goes in (best fit) and the rest of the gap is looked up again. A layout is repeated as long as all its lengths last,
    so each uses up a length: there are at most as many layouts as distinct lengths, however many items there are.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        count[length] += n
    plans: list[tuple[dict[int, int], int]] = []
    top = capacity
    while True:
        while top > 0 and count[top] == 0:
            top -= 1
        if top == 0:
            return plans
        use = [top]
        count[top] -= 1
        gap = capacity - top
        while gap > 0:
            exact = exact_fill(count, gap)
            if exact is not None:
                use += exact
                for x in exact:
                    count[x] -= 1
                break
            fits = np.flatnonzero(count[1 : gap + 1])
            if not len(fits):
                break
            x = int(fits[-1]) + 1
            use.append(x)
            count[x] -= 1
            gap -= x
        layout: dict[int, int] = {}
        for x in use:
            layout[x] = layout.get(x, 0) + 1
        more = min(int(count[x]) // m for x, m in layout.items())
        for x, m in layout.items():
            count[x] -= more * m
        plans.append((layout, 1 + more))


def pack(items: DataFrame, item: str = "doc_id", size: str = "size", capacity: int = CAPACITY) -> DataFrame:
    """(item, piece, size, container, fill): the container of every piece of every item, and its fill in [0, 1].

    An item longer than the capacity is cut into full containers and a rest (pieces 0, 1, ...); no other item is split.
    Items of size 0, negative or null size get no container (null container and fill). Repeated ids are items of their
    own, ties are broken by a hash of the id, an empty table gives no rows, other columns are ignored.

    The driver sees only how many pieces have each length, at most ``capacity`` numbers. Which piece of a length goes
    where is its rank within the length, from bounded hash buckets, so a length shared by most items is spread out.
    """
    spark = items.sparkSession
    base = items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("whole"))
    some = base.where("whole > 0")
    full = f"whole div {capacity}"
    cuts = some.select("item", F.posexplode(F.expr(f"concat(array_repeat(cast({capacity} as bigint), cast({full} as int)), filter(array(whole % {capacity}), x -> x > 0))")).alias("piece", "size"))
    histogram = {r["size"]: r["n"] for r in cuts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows, first = [], 0
    used: dict[int, int] = {}
    for layout, times in plan_containers(histogram, capacity):
        fill = sum(x * m for x, m in layout.items()) / capacity
        for x, m in layout.items():
            start = used.get(x, 0)
            rows.append((x, start, start + m * times, first, m, fill))
            used[x] = start + m * times
        first += times
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0.0)], "size bigint, low bigint, high bigint, first bigint, times bigint, fill double")
    place = F.pmod(F.xxhash64("item", "piece"), F.lit(1 << 20))
    ranked = prefix_sums(cuts, ["size"], place, F.lit(1), F.shiftright(place, 14), ["item", "piece"])
    plan = F.broadcast(plan)  # at most capacity layouts of distinct lengths
    put = ranked.join(plan, "size").where("_before >= low and _before < high")
    put = put.select("item", F.col("piece").cast("bigint").alias("piece"), "size", F.expr("first + (_before - low) div times").alias("container"), "fill")
    none = base.where("whole <= 0").select("item", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("double").alias("fill"))
    return put.unionByName(none).withColumnRenamed("item", item)
