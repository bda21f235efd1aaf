"""Vector search: exact and approximate nearest vectors, cut-offs by score shape, quality and quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut

EPSILON = 1.1920929e-07


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a norm is zero or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def distances(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """Adds ``distance`` to a query vector, in Arrow batches; null for vectors of another length."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def run(vs: pd.Series) -> pd.Series:
        ok = np.array([v is not None and len(v) == len(q) for v in vs], dtype=bool)
        out = np.full(len(vs), np.nan)
        if ok.any():
            m = np.stack([np.asarray(v, dtype=np.float64) for v in vs[ok]])
            out[ok] = np.sqrt(((m - q) ** 2).sum(axis=1))
        return pd.Series(out).where(ok, None)

    return vectors.withColumn("distance", run(column))


def knn(vectors: DataFrame, query: list[float], k: int, id_column: str = "vec_id") -> DataFrame:
    """The k nearest by Euclidean distance (ties to the smaller id) with similarity = 1 - distance; partial top-k per task."""
    near = distances(vectors, query).where("distance is not null")
    return near.withColumn("similarity", 1 - F.col("distance")).orderBy(F.round("distance", 9), id_column).limit(k)


def normalised_scores(scored: DataFrame, group: list[str]) -> DataFrame:
    """Min-max normalised ``score`` within the group; all 1 where the range is nothing."""
    bounds = scored.groupBy(*group).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    joined = scored.join(bounds, group) if group else scored.crossJoin(F.broadcast(bounds))  # one row
    return joined.withColumn("norm", F.when(span < EPSILON, 1.0).otherwise((F.col("score") - F.col("_lo")) / span)).drop("_lo", "_hi")


def cutoff(ranked: DataFrame, strategy: str, group: str = "query_id", least: int = 1, **p: float) -> DataFrame:
    """(group, kept): how many of the ranked ``score``s (``pos`` from 0, best first) a strategy keeps.

    strategies: absolute(min_score), relative(min_ratio), cliff(max_drop), combined(relative, max_drop, min_score),
    elbow(sensitivity). At least ``least`` are kept; lists not longer than that are kept whole. Result lists are short
    (they are cut off result pages), so the windows run per group.
    """
    n = normalised_scores(ranked, [group])
    w = Window.partitionBy(group).orderBy("pos")
    n = n.withColumn("prev", F.lag("norm").over(w))
    size = F.count("*").alias("n")
    drop = (F.col("prev") - F.col("norm")) / F.col("prev") > p.get("max_drop", 1.0)
    fall = F.coalesce((F.col("prev") > EPSILON) & drop, F.lit(False))
    test = {
        "absolute": F.col("norm") < p.get("min_score", 0.0),
        "relative": F.col("norm") < p.get("min_ratio", 0.0),
        "cliff": fall,
        "combined": (F.col("norm") < p.get("min_score", 0.0)) | (F.col("norm") < p.get("relative", 0.0)) | fall,
    }
    if strategy in test:
        found = n.groupBy(group).agg(size, F.min(F.when(test[strategy] & (F.col("pos") >= least), F.col("pos"))).alias("at"))
        return found.select(group, F.when(F.col("n") <= least, F.col("n")).otherwise(F.coalesce("at", "n")).cast("bigint").alias("kept"))
    if strategy != "elbow":
        raise ValueError(f"unknown strategy {strategy}")
    sensitivity = p.get("sensitivity", 1.0)
    ends = n.groupBy(group).agg(size, F.min_by("norm", "pos").alias("y1"), F.max_by("norm", "pos").alias("y2"))
    x = F.col("pos") / (F.col("n") - 1)
    gap = F.abs((F.col("y2") - F.col("y1")) * x - F.col("norm") + F.col("y1")) / F.sqrt(1 + F.pow(F.col("y2") - F.col("y1"), 2))
    far = gap * (1.0 + sensitivity * (1.0 - x))
    inner = n.join(ends, group).where((F.col("pos") >= least) & (F.col("pos") < F.col("n") - 1) & (F.col("n") >= 3)).select(group, "pos", far.alias("far"))
    peak = inner.groupBy(group).agg(F.max(F.struct("far", (-F.col("pos")).alias("neg"))).alias("m"))
    kept = F.when((F.col("n") <= least) | F.col("m").isNull() | (F.col("m.far") <= 0.05 * sensitivity), F.col("n")).otherwise(-F.col("m.neg") + 1)
    return ends.join(peak, group, "left").select(group, kept.cast("bigint").alias("kept"))


def quality(vectors: DataFrame, id_column: str = "vec_id", most: int = 1000) -> DataFrame:
    """One row about the pairwise cosines of the ``most`` vectors with the least hash: n_pairs, mean, min, max, std, above_mean.

    ``most`` is the size of the operator's sample; all pairs of that bounded sample are compared in one block product.
    """
    sample = vectors.where("embedding is not null").orderBy(F.xxhash64(id_column), id_column).limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(id_column)
        v = np.stack([np.asarray(x, dtype=np.float64) for x in rows.embedding])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        c = np.clip((u @ u.T)[np.triu_indices(len(u), 1)], -1, 1)
        if len(c):
            yield pd.DataFrame({"n_pairs": [len(c)], "mean": [c.mean()], "low": [c.min()], "high": [c.max()], "spread": [c.std()], "above_mean": [(c > c.mean()).mean()]})

    return sample.select(id_column, "embedding").coalesce(1).mapInPandas(run, "n_pairs bigint, mean double, low double, high double, spread double, above_mean double")


def all_pairs_quality(vectors: DataFrame, id_column: str = "vec_id", rows: int = 1024) -> DataFrame:
    """One row about the cosines of all pairs of vectors: n_pairs, mean, low, high, spread (population), above_mean.

    Blocks of ``rows`` vectors meet in pairs, each pair of blocks is one matrix product in one task, in two passes: sums
    first, then the share above the mean. The work is quadratic, as the measure is; ``quality`` samples instead.
    """
    v = vectors.where("embedding is not null").select(id_column, "embedding")
    many = max(1, -(-v.count() // rows))
    blocks = v.withColumn("b", F.pmod(F.xxhash64(id_column), F.lit(many)).cast("int")).groupBy("b").agg(F.collect_list("embedding").alias("es"))
    pairs = cut(blocks.alias("x").join(blocks.alias("y"), F.col("x.b") <= F.col("y.b")).select(F.col("x.es").alias("left"), F.col("y.es").alias("right"), (F.col("x.b") == F.col("y.b")).alias("same")))

    def products(b: pd.DataFrame) -> Iterator[np.ndarray]:
        for xs, ys, same in zip(b["left"], b["right"], b["same"]):
            x, y = (np.stack([np.asarray(e, dtype=np.float64) for e in es]) for es in (xs, ys))
            x, y = (np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m in (x, y) for n in [np.linalg.norm(m, axis=1, keepdims=True)])
            c = np.clip(x @ y.T, -1, 1)
            yield c[np.triu_indices(len(x), 1)] if same else c.ravel()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(len(c), c.sum(), (c**2).sum(), c.min(), c.max()) for c in products(b) if len(c)], columns=["n", "s", "q", "low", "high"])

    total = pairs.mapInPandas(sums, "n bigint, s double, q double, low double, high double").agg(F.sum("n").alias("n_pairs"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2), F.lit(0.0))).alias("spread")).where("n_pairs > 0")
    first = total.first()  # one row
    mean = first["mean"] if first else 0.0

    def above(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": [int((c > mean).sum()) for c in products(b)]})

    share = pairs.mapInPandas(above, "k bigint").agg(F.sum("k").alias("k"))
    return total.crossJoin(F.broadcast(share)).select("n_pairs", "mean", "low", "high", "spread", (F.col("k") / F.col("n_pairs")).alias("above_mean"))  # one row


def lists_recall(assigned: DataFrame, centroids: np.ndarray, queries: str, k: int, probes: int, id_column: str = "vec_id") -> DataFrame:
    """One row: how many rows the SQL condition ``queries`` picks, and whether probing finds 0.9 of their k nearest others.

    Each query goes to the lists it probes and, for the measure, to all lists; every list keeps k rows a query.
    """
    pick = assigned.where(queries).select(F.col(id_column).alias("q"), F.col("embedding").alias("asked"))

    @F.pandas_udf("array<int>")
    def order(vs: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
        return pd.Series(list(((centroids**2).sum(1)[None] - 2 * m @ centroids.T).argsort(axis=1).astype(np.int32)))

    asked = pick.select("q", "asked", F.posexplode(order("asked")).alias("place", "list_no"))
    met = asked.join(assigned.select(F.col(id_column).alias("f"), "embedding", "list_no"), "list_no").where("q <> f")
    near = met.select("q", "f", "place", l2(F.col("asked"), F.col("embedding")).alias("dist"))
    true = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "f", "place"))), 1, k).alias("t"))
    hit = true.select(F.explode("t").alias("t")).agg(F.avg((F.col("t.place") < probes).cast("double")).alias("recall"))
    return pick.agg(F.count("*").alias("queries")).crossJoin(F.broadcast(hit)).select("queries", (F.col("recall") >= 0.9).alias("enough"))  # one row


def identities(frames: DataFrame, provider: str, model: str) -> DataFrame:
    """Embedding identities with their counts, most frequent first."""
    return frames.groupBy(provider, model).agg(F.count("*").alias("frames")).orderBy(F.desc("frames"), provider, model)


def identity_summary(frames: DataFrame, provider: str, model: str) -> DataFrame:
    """One row: how many identities there are and whether they are 'unknown' (none), 'single' or 'mixed'."""
    known = frames.where(F.col(provider).isNotNull() | F.col(model).isNotNull()).select(provider, model).distinct().agg(F.count("*").alias("identities"))
    return known.select("identities", F.when(F.col("identities") == 0, "unknown").when(F.col("identities") == 1, "single").otherwise("mixed").alias("verdict"))


def of_width(vectors: DataFrame, width: int, strict: bool = True) -> DataFrame:
    """Vectors of one width: another one raises, or with ``strict`` off is left out. Null vectors stay."""
    size = F.size("embedding")
    if strict:
        wrong = F.col("embedding").isNotNull() & (size != width)
        return vectors.withColumn("embedding", F.when(wrong, F.raise_error(F.concat(F.lit(f"vectors have {width} numbers, not "), size.cast("string")))).otherwise(F.col("embedding")))
    return vectors.where(F.col("embedding").isNull() | (size == width))


def segments(vectors: DataFrame, id_column: str, rows: int) -> DataFrame:
    """(segment, n, first_id, last_id, width) of an export in segments of ``rows`` ids each."""
    return vectors.where("embedding is not null").groupBy((F.col(id_column) / rows).cast("bigint").alias("segment")).agg(F.count("*").alias("n"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id"), F.max(F.size("embedding")).alias("width"))


def compression(encoded: DataFrame) -> DataFrame:
    """One row: vectors, bytes of the plain ones (single precision) and of their codes, and their ratio."""
    some = encoded.where("codes is not null")
    sums = some.agg(F.count("*").alias("vectors"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).alias("plain_bytes"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("code_bytes"))
    return sums.select("vectors", "plain_bytes", "code_bytes", F.when(F.col("code_bytes") > 0, F.col("plain_bytes") / F.col("code_bytes")).alias("ratio"))


def assign_lists(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``list_no``: the nearest of the centroids, whose number does not depend on the data; null vectors get null."""

    @F.pandas_udf("int")
    def run(vs: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vs), dtype="Int32")
        fits = [i for i, v in enumerate(vs) if v is not None and len(v) == centroids.shape[1]]
        if fits:
            m = np.stack([np.asarray(vs.iloc[i], dtype=np.float64) for i in fits])
            out.iloc[fits] = ((centroids**2).sum(1)[None] - 2 * m @ centroids.T).argmin(axis=1)
        return out

    return vectors.withColumn("list_no", run("embedding"))


def probe(assigned: DataFrame, centroids: np.ndarray, query: list[float], k: int, probes: int, id_column: str = "vec_id") -> DataFrame:
    """The k nearest of the rows in the ``probes`` lists whose centroids are nearest to the query: approximate, by exact
    distances. A table written by list_no is read in those lists only."""
    near = ((centroids - np.asarray(query)[None]) ** 2).sum(axis=1).argsort()[:probes]
    return knn(assigned.where(F.col("list_no").isin([int(x) for x in near])), query, k, id_column)


def train_codebook(sample: np.ndarray, parts: int, centroids: int = 256, rounds: int = 25) -> np.ndarray:
    """Centroids (parts x centroids x width) of each slice of the sample: k-means from farthest-first starts."""
    width = sample.shape[1] // parts
    books = []
    for p in range(parts):
        x = sample[:, p * width : (p + 1) * width]
        k = min(centroids, len(x))
        chosen, d = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < k:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        c = x[chosen].copy()
        for _ in range(rounds):
            owner = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([x[owner == j].mean(axis=0) if (owner == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        books.append(np.pad(c, ((0, centroids - k), (0, 0)), constant_values=np.inf))
    return np.stack(books)


def encode(vectors: DataFrame, codebook: np.ndarray) -> DataFrame:
    """Adds ``codes``: the nearest centroid of each slice; null for null vectors and those of another length. The
    codebook's size does not depend on the data."""
    parts, _, width = codebook.shape

    @F.pandas_udf("array<int>")
    def run(vs: pd.Series) -> pd.Series:
        fits = [i for i, v in enumerate(vs) if v is not None and len(v) == parts * width]
        out: list = [None] * len(vs)
        if fits:
            m = np.stack([np.asarray(vs.iloc[i], dtype=np.float64) for i in fits]).reshape(len(fits), parts, width)
            codes = np.stack([((m[:, p, None] - codebook[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)
            for i, c in zip(fits, codes.astype(np.int32)):
                out[i] = c
        return pd.Series(out)

    return vectors.withColumn("codes", run("embedding"))


def code_distance(encoded: DataFrame, codebook: np.ndarray, query: list[float]) -> DataFrame:
    """Adds ``distance``: the sum over slices of looked-up distances from the query to the coded centroids."""
    parts, _, width = codebook.shape
    q = np.asarray(query, dtype=np.float64).reshape(parts, width)
    lookup = ((codebook - q[:, None]) ** 2).sum(axis=2)

    @F.pandas_udf("double")
    def run(cs: pd.Series) -> pd.Series:
        out = np.full(len(cs), np.nan)
        fits = [i for i, c in enumerate(cs) if c is not None]
        if fits:
            out[fits] = np.sqrt(lookup[np.arange(parts)[None], np.stack([np.asarray(cs.iloc[i]) for i in fits])].sum(axis=1))
        return pd.Series(out).where(~np.isnan(out), None)

    return encoded.withColumn("distance", run("codes"))
