"""Most similar vectors for every vector: shifted Hilbert orderings of projected vectors, windows merged and reranked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut

#: Curves, projected dimensions, bits a dimension, and rows compared with on either side in each ordering; see README for
#: the recall measured at two sizes and how the window must grow.
CURVES, DIMS, BITS, WINDOW = 12, 16, 3, 4608
#: A task of an ordering holds about so many windows; tasks of one ordering at most.
WINDOWS_A_TASK, MOST_TASKS = 8, 20000
#: Rows that are compared with their window at a time.
TILE = 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows x dims), for all rows at once.

    Gray-code transform of the transposed index (Skilling 2004), written over whole columns.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(dims):
            on = (x[i] & np.uint64(q)) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[dims - 1] & np.uint64(q)) != 0, flip ^ np.uint64(q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def curve(width: int, number: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection (width x dims, orthonormal columns) and shift of one curve; the same for everyone by seed."""
    rng = np.random.default_rng(1000 + number)
    basis, _ = np.linalg.qr(rng.standard_normal((width, max(dims, 1))))
    return basis[:, :dims], rng.random(dims)


def curve_keys(unit: np.ndarray, number: int, scale: float, dims: int, bits: int) -> np.ndarray:
    basis, shift = curve(unit.shape[1], number, dims)
    spread = np.clip((unit @ basis) / scale, -0.98, 0.98)
    return hilbert_keys(((spread * 0.25 + 0.25 + shift * 0.5) * ((1 << bits) - 1)).astype(np.int64), bits)


def tile_best(ids: np.ndarray, v: np.ndarray, rows: tuple[int, int], columns: tuple[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For the given rows: positions of, and exact distances to, the k nearest rows among ``columns``; inf where fewer.

    One matrix product gives all distances in single precision. The k-th nearest of the columns around the tile bounds
    what can be among the k nearest, so only a few columns of a row are sorted; these are measured again exactly.
    """
    (a, b), (lo, hi) = rows, columns
    sq = np.einsum("ij,ij->i", v[lo:hi], v[lo:hi])
    left = np.concatenate([-2 * v[a:b], np.ones((b - a, 1), np.float32)], axis=1)
    d = left @ np.concatenate([v[lo:hi], sq[:, None]], axis=1).T
    d[ids[a:b, None] == ids[None, lo:hi]] = np.inf
    take = min(k + 3, hi - lo)
    near_lo, near_hi = max(0, a - TILE - lo), min(hi - lo, b + TILE - lo)
    i = np.empty(0, np.int64)
    if near_hi - near_lo > k + 1:
        bound = np.partition(d[:, near_lo:near_hi], k, axis=1)[:, k]
        i, j = np.nonzero(d <= bound[:, None])
    if not 0 < len(i) <= 64 * k * (b - a):  # no bound, or many copies
        near = np.argpartition(d, take - 1, axis=1)[:, :take]
    else:
        order = np.lexsort((d[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(b - a))
        at = np.minimum(first[:, None] + np.arange(take), len(i) - 1)
        near = np.where(i[at] == np.arange(b - a)[:, None], j[at], -1)
        own = np.repeat(first, take).reshape(near.shape)
        near = np.where(near < 0, j[np.minimum(own, len(j) - 1)], near)
    exact = np.sqrt(((v[a:b, None, :].astype(np.float64) - v[lo + near]) ** 2).sum(axis=2))
    exact[~np.isfinite(np.take_along_axis(d, near, 1))] = np.inf
    same = np.zeros(near.shape, bool)
    by_place = np.argsort(near, axis=1, kind="stable")
    sorted_near = np.take_along_axis(near, by_place, 1)
    np.put_along_axis(same, by_place[:, 1:], sorted_near[:, 1:] == sorted_near[:, :-1], 1)
    exact[same] = np.inf
    order = np.lexsort((ids[lo + near], exact))[:, :k]
    return lo + np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)


NEAR = "frame_id bigint, near array<struct<distance: double, frame_id: bigint>>"
FOUND = NEAR + ", boundary int, curve int, place int, vec binary"


def near_batch(ids: np.ndarray, rows: slice, places: np.ndarray, dist: np.ndarray) -> list[pa.Array]:
    keep = np.isfinite(dist)
    offsets = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(dist[keep]), pa.array(ids[places[keep]])], ["distance", "frame_id"])
    return [pa.array(ids[rows]), pa.ListArray.from_arrays(pa.array(offsets), pairs)]


def vectors_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def partition_neighbours(batches: Iterator[pa.RecordBatch], number: int, k: int, window: int, width: int) -> Iterator[pa.RecordBatch]:
    """Neighbours of the rows of one range partition, and its first and last ``window`` rows for the partitions beside it.

    A partition holds a bounded number of rows by construction: equal keys split by id.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    curve, ids = t["curve"].to_numpy(), t["frame_id"].to_numpy()
    v = vectors_of(t["vec"], width)
    names = ["frame_id", "near", "boundary", "curve", "place", "vec"]
    cuts = [0, *(np.nonzero(np.diff(curve))[0] + 1).tolist(), len(curve)]
    for s, e in zip(cuts[:-1], cuts[1:]):
        for a in range(s, e, TILE):
            b = min(a + TILE, e)
            places, dist = tile_best(ids, v, (a, b), (max(s, a - window), min(e, b + window)), k)
            rows = near_batch(ids, slice(a, b), places, dist)
            yield pa.RecordBatch.from_arrays([*rows, *[pa.nulls(b - a, x) for x in (pa.int32(), pa.int32(), pa.int32(), pa.binary())]], names)
    near_type = pa.list_(pa.struct([("distance", pa.float64()), ("frame_id", pa.int64())]))
    first, last = slice(0, min(cuts[1], window)), slice(max(cuts[-2], len(curve) - window), len(curve))
    for boundary, part, at in ((number - 1, first, 0), (number, last, -(last.stop - last.start))):
        n = part.stop - part.start
        vec = pa.array([r.tobytes() for r in v[part]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.nulls(n, near_type), pa.array(np.full(n, boundary, np.int32)), pa.array(curve[part]), pa.array(np.arange(at, at + n, dtype=np.int32)), vec], names)


def boundary_neighbours(batches: Iterator[pa.RecordBatch], k: int, window: int, width: int) -> Iterator[pa.RecordBatch]:
    """Neighbours across each boundary of two range partitions: rows left of it (negative places) with rows right of it."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        place, ids, curve = t["place"].to_numpy(), t["frame_id"].to_numpy(), t["curve"].to_numpy()
        mid, n = int(np.searchsorted(place, 0)), len(place)
        if mid in (0, n) or curve[0] != curve[-1]:
            return
        v = vectors_of(t["vec"], width)
        for a in range(0, n, TILE):
            b = min(a + TILE, n)
            for x, y in ((a, min(b, mid)), (max(a, mid), b)):
                lo, hi = (mid, min(n, y + window)) if y <= mid else (max(0, x - window), mid)
                if x < y and lo < hi:
                    places, dist = tile_best(ids, v, (x, y), (lo, hi), k)
                    yield pa.RecordBatch.from_arrays(near_batch(ids, slice(x, y), places, dist), ["frame_id", "near"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        number = t["boundary"].to_numpy()
        edges = [0, *(np.nonzero(np.diff(number))[0] + 1).tolist()]
        for s, e in zip(edges[:-1], edges[1:]):
            yield from run(t.slice(s, e - s).combine_chunks())
        held = t.slice(edges[-1]).combine_chunks().to_batches()
    if held:
        yield from run(pa.Table.from_batches(held).combine_chunks())


def nearest(vectors: DataFrame, k: int = 5, width: int = 64, curves: int = CURVES, window: int = WINDOW, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(query_frame_id, frame_id, hit_rank, distance): the k nearest other frames of every frame, Euclidean.

    Takes ``frame_id``, ``embedding`` and, if there, ``added_at`` (the latest row of a frame counts, repeated rows once).
    Vectors that are null, have another length than ``width``, hold null, NaN or infinite numbers, or are all zero take
    no part. Ties go to the smaller frame_id among the k + 3 nearest. Copies are each other's neighbours at distance 0.
    Empty input gives an empty result; other columns are ignored.

    Every vector is compared with at least the ``window`` rows on either side of it in each of ``curves`` Hilbert
    orderings. The orderings are range-partitioned by (curve, key, frame_id), so equal keys split too, into partitions of
    a bounded number of rows; the rows at both sides of a partition's edge meet in a second, smaller step, so the result
    does not depend on where the edges are. Distances are exact, and a frame gets k neighbours of its own from each
    ordering, merged by a bounded list.
    """
    order = "added_at" if "added_at" in vectors.columns else "frame_id"
    fits = F.expr(f"embedding is not null and size(embedding) = {width} and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and abs(x) < 1e18)")
    one = vectors.select("frame_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col(order).alias("_at")).where("frame_id is not null").where(fits)
    one = cut(one.groupBy("frame_id").agg(F.max_by("embedding", "_at").alias("embedding")))
    tasks = max(1, min(MOST_TASKS, one.count() * curves // (WINDOWS_A_TASK * window)))
    p = min(dims, width)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            vec = pa.array([r.tobytes() for r in v], pa.binary())
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            for c in range(curves):
                key = curve_keys(v / np.maximum(norm, 1.0), c, 2.0 / np.sqrt(width), p, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(key), b.column("frame_id"), vec], ["curve", "key", "frame_id", "vec"])

    keyed = one.mapInArrow(keys, "curve int, key bigint, frame_id bigint, vec binary")
    placed = keyed.repartitionByRange(tasks, "curve", "key", "frame_id").sortWithinPartitions("curve", "key", "frame_id").select("curve", "frame_id", "vec")
    found = cut(placed.mapInArrow(lambda it: partition_neighbours(it, TaskContext.get().partitionId(), k, window, width), FOUND))
    edges = found.where("boundary is not null").select("boundary", "curve", "place", "frame_id", "vec").repartition("boundary").sortWithinPartitions("boundary", "place")
    across = edges.mapInArrow(lambda it: boundary_neighbours(it, k, window, width), NEAR)
    every = found.where("boundary is null").select("frame_id", "near").unionByName(across)
    merged = every.groupBy("frame_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    out = merged.select(F.col("frame_id").alias("query_frame_id"), F.posexplode("near").alias("pos", "hit"))
    return out.select("query_frame_id", F.col("hit.frame_id").alias("frame_id"), (F.col("pos") + 1).alias("hit_rank"), F.col("hit.distance").alias("distance"))


def exact(vectors: DataFrame, queries: str, k: int = 5, width: int = 64, order: str = "added_at") -> DataFrame:
    """(query_frame_id, frame_id, distance): the k nearest others of the frames that the SQL condition ``queries`` picks,
    against all rows: the measure for ``nearest``. Blocks of 1024 queries meet parts of 4096 rows; k rows a query are kept."""
    fits = F.expr(f"frame_id is not null and embedding is not null and size(embedding) = {width} and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and abs(x) < 1e18)")
    one = vectors.where(fits).groupBy("frame_id").agg(F.max_by(F.col("embedding").cast("array<float>"), order).alias("embedding"))
    one = cut(one)
    asked = one.where(queries).select(F.col("frame_id").alias("query_frame_id"), F.col("embedding").alias("asked"))
    many = lambda rows, size: F.lit(max(1, -(-rows // size)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_frame_id"), many(asked.count(), 1024)).cast("int"))
    blocks = asked.groupBy("block").agg(F.collect_list("query_frame_id").alias("qs"), F.collect_list("asked").alias("vs"))
    rows = one.count()
    tasks = max(1, min(MOST_TASKS, rows // 16384))  # few parts a task, whatever the partitions are coalesced to
    parts = one.withColumn("part", F.pmod(F.xxhash64("frame_id"), many(rows, 4096)).cast("int")).repartition(tasks, "part").groupBy("part").agg(F.collect_list("frame_id").alias("ids"), F.collect_list("embedding").alias("es"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_q, out_f, out_d = [], [], []
            for qs, vs, ids, es in zip(*[b.column(c) for c in ("qs", "vs", "ids", "es")]):
                q, f = np.array(qs.as_py()), np.array(ids.as_py())
                x, y = np.array(vs.as_py(), np.float64), np.array(es.as_py(), np.float64)
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
                d[q[:, None] == f[None]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                dist = np.take_along_axis(d, near, 1)
                keep = np.isfinite(dist)
                out_q.append(np.repeat(q, near.shape[1]).reshape(near.shape)[keep])
                out_f.append(f[near][keep])
                out_d.append(dist[keep])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_f, out_d)], ["query_frame_id", "frame_id", "distance"])

    met = blocks.crossJoin(parts).mapInArrow(measure, "query_frame_id bigint, frame_id bigint, distance double")  # stated queries in blocks against all rows
    best = met.groupBy("query_frame_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "frame_id"))), 1, k).alias("near"))
    return best.select("query_frame_id", F.explode("near").alias("hit")).select("query_frame_id", F.col("hit.frame_id").alias("frame_id"), F.col("hit.distance").alias("distance"))
