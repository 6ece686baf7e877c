"""Nearest vectors of many queries: blocks of vectors meet blocks of queries, and each pair of blocks keeps ``k`` a query.

Neither side passes the driver. A block holds ``BLOCK_NUMBERS`` numbers at most on average, so a task holds two of them
and one strip of distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of one block of vectors or queries.
BLOCK_NUMBERS = 4_000_000
#: Queries whose distances to a block are held at once.
STRIP = 256
SPACES = ("cosinesimil", "l2", "l1")
_FOUND = "query_id long, patch_id long, distance double"


def distances(space: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of queries to vectors: cosine distance, Euclidean or Manhattan."""
    if space == "cosinesimil":
        return 1.0 - (q @ x.T) / np.sqrt((q * q).sum(axis=1)[:, None] * (x * x).sum(axis=1)[None, :])
    if space == "l2":
        return np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in q])
    return np.stack([np.abs(x - one).sum(axis=1) for one in q])


def _filter(q: np.ndarray, x: np.ndarray):
    """For Euclidean distances: a function that gives single-precision squares of the distances of some queries to all of
    ``x`` by a matrix product, and how far they may be off for each query; None where single precision could overflow.

    Both sides are moved by the mean of ``x``, as the error grows with their lengths.
    """
    if not len(x) or not max(np.abs(x).max(), np.abs(q).max(initial=0)) < 1e15:
        return None
    longest = np.sqrt((x * x).sum(axis=1).max()) + np.sqrt((q * q).sum(axis=1))
    middle = x.mean(axis=0)
    x, q = x - middle, q - middle
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    # A product of d + 2 terms and its factors: each rounds by 2**-24 of the lengths at most; the move by 2**-52 of the longest.
    reach = np.sqrt(qq) + np.sqrt(xx.max())
    off = 2 * (x.shape[1] + 10) * 2.0**-24 * reach**2 + 2.0**-48 * longest * reach + 2.0**-96 * longest**2 + 1e-30
    right = np.vstack([x.T, xx, np.ones(len(x))]).astype(np.float32)
    left = np.column_stack([-2 * q, np.ones(len(q)), qq]).astype(np.float32)
    return (lambda lo, hi: left[lo:hi] @ right), off


#: Pairs that are worked out and sorted at once, and those of one query more.
_PAIRS = 200_000
#: Columns whose least values stand for all in finding a bound of the k-th best.
_FOLD = 1024


def _bound(d: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least ``k`` of it don't exceed, near the k-th least; infinite where there is none."""
    least = d
    if d.shape[1] >= 4 * _FOLD:
        least = d[:, :_FOLD].copy()
        for lo in range(_FOLD, d.shape[1], _FOLD):
            part = d[:, lo : lo + _FOLD]
            np.fmin(least[:, : part.shape[1]], part, out=least[:, : part.shape[1]])
    if least.shape[1] < k or (k > _FOLD and least is not d):
        least = d
    if least.shape[1] < k:
        return np.full(len(d), np.inf)
    found = np.partition(least, k - 1, axis=1)[:, k - 1].astype(float)
    return np.where(np.isnan(found), np.inf, found)


def best_of(space: str, k: int, ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, allowed=None, exclude_self: bool = False):
    """Strips of ``query ids, vector ids, distances``: the ``k`` nearest of each query, ties to the smaller id.

    ``allowed(lo, hi)`` tells which vectors the queries of a strip may find. Only pairs within a bound of a query's k-th
    best are sorted; Euclidean distances are worked out for these alone.
    """
    coarse = _filter(q, x) if space == "l2" else None
    for lo in range(0, len(ids), STRIP):
        hi = min(lo + STRIP, len(ids))
        d = coarse[0](lo, hi) if coarse else distances(space, q[lo:hi], x)
        if exclude_self:
            d[ids[lo:hi, None] == own[None, :]] = np.inf
        if allowed is not None:
            d[~allowed(lo, hi)] = np.inf
        # Distances are rounded before the cut, so that ties fall the same way here and in the final rank: all that
        # may round to the k-th best stays for the order by id.
        top = _bound(d, k)
        if coarse:
            off = coarse[1][lo:hi]
            top = np.nextafter(((np.sqrt(np.maximum(top + off, 0)) + 1e-8) ** 2 + off).astype(np.float32), np.float32(np.inf))
        else:
            top = top + 1e-8
        within = d <= top[:, None]
        # A few queries at a time where very many vectors are alike.
        part = np.cumsum(within.sum(axis=1)) // _PAIRS
        for first, last in zip(ends := np.flatnonzero(np.diff(part, prepend=-1)), [*ends[1:], len(part)], strict=True):
            row, at = np.divmod(np.flatnonzero(within[first:last]), max(d.shape[1], 1))
            row += first
            near = d[row, at]
            if coarse:
                kept = np.isfinite(near)
                row, at = row[kept], at[kept]
                near = np.sqrt(((x[at] - q[lo + row]) ** 2).sum(axis=1))
            near, names = np.round(near, 9), own[at]
            order = np.lexsort((names, near, row))
            order = order[np.isfinite(near[order])]
            order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
            yield ids[lo:hi][row[order]], names[order], near[order]


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(n, -1)


def nearest(held: DataFrame, asked: DataFrame, k: int, space: str, exclude_self: bool = False, queries_a_block: int = 20_000) -> DataFrame:
    """``query_id, patch_id, distance``: for each pair of blocks the ``k`` nearest of each query.

    ``held`` has ``block, patch_id, embedding``, ``asked`` has ``block, query_id, embedding``, a row for each block that a
    query is to meet. A block that more queries ask for meets them in slots, with a copy of its vectors for each.
    """

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        if vectors.num_rows and queries.num_rows:
            own, ids = vectors.column("patch_id").to_numpy(), queries.column("query_id").to_numpy()
            x, q = matrix(vectors.column("embedding"), len(own)), matrix(queries.column("q"), len(ids))
            parts = list(best_of(space, k, ids, q, own, x, exclude_self=exclude_self))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["query_id", "patch_id", "distance"])

    slots = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(queries_a_block)).cast("int").alias("slots"))
    slotted = held.join(slots, "block").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    dealt = asked.join(slots, "block").withColumn("slot", F.pmod(F.xxhash64("query_id"), F.col("slots")).cast("int"))
    left = slotted.select("block", "slot", "patch_id", "embedding").groupBy("block", "slot")
    # Names of their own, as both sides may come of the same table.
    right = dealt.select(F.col("block").alias("b"), F.col("slot").alias("s"), "query_id", F.col("embedding").alias("q")).groupBy("b", "s")
    return left.cogroup(right).applyInArrow(meet, _FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, patch_id, distance``: the ``k`` nearest over all blocks."""
    order = Window.partitionBy("query_id").orderBy("distance", "patch_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "patch_id", "distance")


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, space: str = "cosinesimil", exclude_self: bool = False, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """``query_id, rank, patch_id, distance``: the ``k`` nearest ``vectors`` (patch_id, embedding) of each of many
    ``queries`` (query_id, embedding), exactly.

    Vectors are dealt to blocks by a hash of their id and every query meets every block, in blocks of as many queries.
    Ties go to the smaller id; fewer than ``k`` vectors are all returned; no rows for an empty side.
    """
    if space not in SPACES:
        raise ValueError(f"unknown space {space!r}; known: {', '.join(SPACES)}")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    per_block = max(1, block_numbers // max(size["d"] or 1, 1))
    many = max(1, -(-size["n"] // per_block))
    # Few blocks are met by their queries in more slots, so that all cores have some four pairs of blocks.
    slots = -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // many)
    per_slot = min(per_block, max(STRIP, -(-queries.count() // slots)))
    held = vectors.select(F.pmod(F.xxhash64("patch_id"), F.lit(many)).alias("block"), "patch_id", "embedding")
    asked = queries.select("query_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("block"))
    return ranked(nearest(held, asked, k, space, exclude_self, per_slot), k)
