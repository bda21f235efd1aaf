"""Near-duplicate records with small edits: a parity-sketch join with pigeonholed blocks, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.graph import connected_components
from tessera.runtime import cut, maybe_broadcast

#: At most so many of 64 bits differ.
BITS_APART = 8
#: Agreement of filters: bits in both over bits in either.
AGREEMENT = 0.8
#: Rows of one key that one task compares; a key with more is cut into chunks, each pair of chunks a task of its own.
CHUNK = 16384
#: Groups of exact copies up to this size are written out as pairs; of larger ones each copy is paired with the least.
COPIES = 64
#: What it costs to ship one row under one key, in comparisons of two rows.
SHIPPING = 60


class Blocks:
    """A cut of the 64-bit sketch into ``number`` blocks, of which number - 8 must be equal: one key for each choice."""

    def __init__(self, number: int):
        self.number, self.equal = number, number - BITS_APART
        self.edges = [int(x) for x in np.linspace(0, 64, number + 1).round()]
        self.choices = list(combinations(range(number), self.equal))

    def keys(self) -> str:
        """SQL for the array of keys of a row: the number of the choice and its blocks."""
        block = [f"(shiftrightunsigned(simhash, {a}) & {(1 << b - a) - 1}L)" for a, b in zip(self.edges, self.edges[1:])]
        return ", ".join(" | ".join([f"({n}L << 40)", *[f"({block[k]} << {8 * at})" for at, k in enumerate(chosen)]]) for n, chosen in enumerate(self.choices))

    def first(self, differing: np.ndarray, choice: int) -> np.ndarray:
        """Whether each pair, given by its differing bits, agrees in no block before the last of the choice but the chosen."""
        last = self.choices[choice][-1]
        same = [(differing >> np.uint64(a)) & np.uint64((1 << b - a) - 1) == 0 for a, b in zip(self.edges[: last + 1], self.edges[1:])]
        return np.sum(same, axis=0) == self.equal


def blocks_for(rows: int) -> Blocks:
    """The cut with the least work for so many rows: more blocks are more keys a row, but fewer rows a key."""
    work = {b: math.comb(b, BITS_APART) * (SHIPPING + rows / 2 ** (64 * (b - BITS_APART) / b + 1)) for b in range(BITS_APART + 2, BITS_APART + 6)}
    return Blocks(min(work, key=work.get))


def folded(filters: list[bytes]) -> np.ndarray:
    """Filters as rows of four 64-bit words; one of 64 bytes becomes the OR of its halves."""
    return np.array([np.frombuffer(f, np.uint64) if len(f) == 32 else np.frombuffer(f[:32], np.uint64) | np.frombuffer(f[32:64], np.uint64) for f in filters], dtype=np.uint64).reshape(-1, 4)


def close_pairs(ids: np.ndarray, sim: np.ndarray, parity: np.ndarray, size: np.ndarray, chunk: np.ndarray, blocks: Blocks, choice: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one key within both bounds, each only under the first blocks in which it agrees.

    The parity word XORs all tokens (set filter bits) of one residue; every token in one record only flips one bit, so
    its Hamming distance is at most the symmetric difference, itself at most (1 - J) / (1 + J) of the summed sizes.
    """
    left, right = [], []
    n, step = len(ids), max(1, 2_000_000 // max(len(ids), 1))
    ratio = (1 - AGREEMENT) / (1 + AGREEMENT)
    cross = chunk.min() != chunk.max()
    for a in range(0, n, step):
        b = min(a + step, n)
        x = sim[a:b, None] ^ sim[None, a:]
        i, j = np.nonzero(np.bitwise_count(x) <= BITS_APART)
        keep = j > i
        i, j = i[keep] + a, j[keep] + a
        if cross:
            keep = chunk[i] != chunk[j]
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(parity[i] ^ parity[j]) <= (size[i] + size[j]) * ratio + 1e-9
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        keep = blocks.first(sim[i] ^ sim[j], choice)
        left.append(ids[i[keep]])
        right.append(ids[j[keep]])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def prepare(entries: DataFrame) -> DataFrame:
    """(frame_id, simhash, term_filter, rep): the entries that take part, with the least id of their exact copies."""
    order = "updated_at" if "updated_at" in entries.columns else "frame_id"
    e = entries.select("frame_id", "simhash", "term_filter", F.col(order).alias("_at")).where("frame_id is not null")
    e = e.groupBy("frame_id").agg(F.max_by(F.struct("simhash", "term_filter"), "_at").alias("r")).select("frame_id", "r.simhash", "r.term_filter")
    return e.where("simhash is not null and term_filter is not null and octet_length(term_filter) in (32, 64) and hex(term_filter) rlike '[^0]'")


def representatives(e: DataFrame) -> DataFrame:
    return e.groupBy("simhash", "term_filter").agg(F.min("frame_id").alias("rep"), F.count("*").alias("copies"))


def linked(reps: DataFrame) -> DataFrame:
    """(a, b) of different representatives that pass both thresholds. ``reps`` is read several times: a written table."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            filters = b.column("term_filter").to_pylist()
            size = np.array([int.from_bytes(f, "big").bit_count() for f in filters], np.int32)
            parity = np.bitwise_xor.reduce(folded(filters), axis=1) if filters else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("simhash"), pa.array(parity.view(np.int64)), pa.array(size)], ["rep", "simhash", "parity", "size"])

    base = reps.select("rep", "simhash", "term_filter").mapInArrow(words, "rep bigint, simhash bigint, parity bigint, size int")
    blocks = blocks_for(reps.count())
    rows = base.select("rep", "simhash", "parity", "size", F.explode(F.expr(f"array({blocks.keys()})")).alias("key"))
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {CHUNK}").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("g")))  # written, so that its size is known
    rows = rows.join(maybe_broadcast(hot), "key", "left").withColumn("chunk", F.coalesce(F.expr("cast(pmod(xxhash64(rep), g) as int)"), F.lit(0)))
    task = F.expr("case when g is null then array(0) else transform(sequence(0, g - 1), x -> least(x, chunk) * g + greatest(x, chunk)) end")
    rows = rows.select("key", F.explode(task).alias("task"), "chunk", "rep", "simhash", "parity", "size")
    placed = rows.repartition("key", "task").sortWithinPartitions("key", "task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, task = t["key"].to_numpy(), t["task"].to_numpy()
            edge = np.nonzero(np.diff(key) | np.diff(task))[0] + 1
            ids, sim, par = t["rep"].to_numpy(), t["simhash"].to_numpy().view(np.uint64), t["parity"].to_numpy().view(np.uint64)
            size, chunk = t["size"].to_numpy(), t["chunk"].to_numpy()
            outs = []
            bounds = np.concatenate([[0], edge, [len(key)]])
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s > 1:
                    outs.append(close_pairs(ids[s:e], sim[s:e], par[s:e], size[s:e], chunk[s:e], blocks, int(key[s]) >> 40))
            if outs:
                x, y = (np.concatenate(c) for c in zip(*outs))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            key, task = t["key"].to_numpy(), t["task"].to_numpy()
            change = np.nonzero((key != key[-1]) | (task != task[-1]))[0]
            done = int(change[-1]) + 1 if len(change) else 0
            if done:
                yield from run(t.slice(0, done).combine_chunks())
                held = t.slice(done).combine_chunks().to_batches()
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    near = placed.mapInArrow(compare, "a bigint, b bigint")
    filters = reps.select("rep", "term_filter")
    pairs = near.join(filters.withColumnsRenamed({"rep": "a", "term_filter": "fa"}), "a").join(filters.withColumnsRenamed({"rep": "b", "term_filter": "fb"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fa, fb = b.column("fa").to_pylist(), b.column("fb").to_pylist()
            keep = []
            for x, y in zip(fa, fb):
                if len(x) != len(y):
                    x, y = ((int.from_bytes(z[:32], "big") | int.from_bytes(z[32:], "big")) if len(z) == 64 else int.from_bytes(z, "big") for z in (x, y))
                else:
                    x, y = int.from_bytes(x, "big"), int.from_bytes(y, "big")
                keep.append((x & y).bit_count() >= AGREEMENT * (x | y).bit_count() - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "fa", "fb").mapInArrow(verify, "a bigint, b bigint")


def pairs(entries: DataFrame) -> DataFrame:
    """(frame_id_a, frame_id_b), a < b: entries with at most 8 differing simhash bits and filter agreement of 0.8.

    A 64-byte filter is OR-folded to compare it with one of 32 bytes. The latest row (updated_at) of a frame counts,
    repeated rows once. Null simhash, null or all-zero filters and filters of other lengths take no part. Ties cannot
    occur, an empty table gives no rows, other columns are ignored. Exact copies are one representative in the join.

    Groups of up to COPIES exact copies are written out in full. A larger group is its least id and the membership of the
    others, as pairs (least id, copy); its links to other texts are written for every copy, towards every copy of a small
    group and the least id of another large one. ``copies`` says which entries are in which group, and how it is written.
    """
    e = prepare(entries)
    reps = cut(representatives(e))
    near = cut(linked(reps))
    grouped = cut(e.join(reps, ["simhash", "term_filter"]).select("frame_id", "rep", "copies"))
    twice = grouped.where("copies > 1")
    small = twice.where(f"copies <= {COPIES}").select("frame_id", "rep")
    inside = small.select(F.col("frame_id").alias("frame_id_a"), "rep").join(small.select(F.col("frame_id").alias("frame_id_b"), "rep"), "rep").where("frame_id_a < frame_id_b").drop("rep")
    star = twice.where(f"copies > {COPIES} and frame_id <> rep").select(F.col("rep").alias("frame_id_a"), F.col("frame_id").alias("frame_id_b"))
    member = grouped.where(f"copies <= {COPIES} or frame_id = rep").select("frame_id", "rep")
    others = grouped.where(f"copies > {COPIES} and frame_id <> rep").select("frame_id", "rep")
    side = lambda df, name, rep: df.select(F.col("frame_id").alias(name), F.col("rep").alias(rep))
    across = near.join(side(member, "x", "a"), "a").join(side(member, "y", "b"), "b").select("x", "y")
    one = near.join(side(others, "x", "a"), "a").join(side(member, "y", "b"), "b").select("x", "y")
    two = near.join(side(member, "x", "a"), "a").join(side(others, "y", "b"), "b").select("x", "y")
    across = across.unionByName(one).unionByName(two).select(F.least("x", "y").alias("frame_id_a"), F.greatest("x", "y").alias("frame_id_b"))
    return across.unionByName(inside).unionByName(star)


def copies(entries: DataFrame) -> DataFrame:
    """(frame_id, rep, copies, listed): the group of exact copies of every entry that takes part, its least id and size,
    and whether ``pairs`` lists it as all its pairs ('pairs') or by its representative ('representative')."""
    e = prepare(entries)
    grouped = e.join(representatives(e), ["simhash", "term_filter"])
    return grouped.select("frame_id", "rep", "copies", F.expr(f"if(copies <= {COPIES}, 'pairs', 'representative')").alias("listed"))


def classes(entries: DataFrame) -> DataFrame:
    """(frame_id, class_id, links): every entry that takes part with the least id of its class and, of its copies'
    representative, the number of different entries it is linked to. Alone: its own id and 0."""
    e = prepare(entries)
    reps = cut(representatives(e))
    near = cut(linked(reps))
    comp = connected_components(near)
    degree = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    known = reps.join(comp, reps.rep == comp.id, "left").drop("id").join(degree, reps.rep == degree.id, "left").select("simhash", "term_filter", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return e.join(known, ["simhash", "term_filter"]).select("frame_id", "class_id", "links")
