"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are assigned to cells of a coarse k-means, and the residual to the cell's centre is rotated and kept as one
bit per dimension with two correction scalars (its length, and its inner product with its own code). A query is
rotated too and kept as ``PLANES`` bit planes, so the inner product of a code with it is a few popcounts of packed bits;
the scalars turn it into an estimate of the inner product of the vectors with an error bound. Vectors whose upper bound
reaches the query's k-th best lower bound are ranked again on the original vectors.

Scale: of equal vectors only the ``k + 1`` smallest ids are searched, as no more can be among the nearest. A query probes
as many cells as the sample needed for ``recall``, and goes on while these hold fewer than ``k`` others, so every query
gets its ``k`` nearest found. What is ranked again is told by the bounds of the codes alone. A block holds at most
``BLOCK`` vectors, near cells share one, and it meets its own queries ``QUERY_BLOCK`` at a time, so that vectors are
copied only where that many queries want them (one copy of a vector for 8,192 estimates of it). Vectors travel with their codes: of 64 components
without clusters the bounds leave a tenth of a block to be ranked again, and those pairs would outweigh the vectors.
A block returns at most ``k`` rows per query. Cells are the square root of the table in number, an eighth of ``sample``
at most (2,048): from some four million vectors on cells grow instead, and so does the work per query, unless
``sample`` is raised. Where vectors have no clusters, a query meets most of the codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 16_384
RECALL = 0.97
BLOCK = 4_096
QUERY_BLOCK = 8_192
PLANES = 6
_STEP = 128
#: Standard deviations of the estimate's error that the bounds allow for.
EPSILON = 2.5


@dataclass(frozen=True)
class Coder:
    """Cell centres, one rotation, and the packed codes."""

    centres: np.ndarray
    rotation: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    @property
    def words(self) -> int:
        return -(-self.dim // 64)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T, axis=1)

    def packed(self, bits: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words of rows of bits."""
        wide = np.zeros((len(bits), self.words * 64), bool)
        wide[:, : self.dim] = bits
        return np.packbits(wide, axis=1).view(np.uint64)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, residual length, and inner product of the unit residual with its code."""
        residual = x - self.centres[cell]
        length = np.sqrt((residual**2).sum(axis=1))
        turned = residual @ self.rotation.T / np.maximum(length, 1e-30)[:, None]
        fit = np.abs(turned).sum(axis=1) / math.sqrt(self.dim)
        return self.packed(turned >= 0), length, np.where(length > 0, np.maximum(fit, 1e-6), 1.0)

    def bounds(self, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, cell: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries by vectors) and how far they may be off."""
        turned = q @ self.rotation.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-30)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        # The query's coordinates that a code has set, by popcounts of the code with each plane of their levels.
        inside = np.zeros((len(q), len(bits)))
        for plane in range(PLANES):
            mask = self.packed((level >> plane) & 1)
            for w in range(self.words):
                inside += np.bitwise_count(bits[None, :, w] & mask[:, None, w]) * float(1 << plane)
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        chosen = low[:, None] * ones + step[:, None] * inside
        whole = low * self.dim + step * level.sum(axis=1)
        product = (2 * chosen - whole[:, None]) / math.sqrt(self.dim)
        estimate = (q @ self.centres.T)[:, cell] + product * (length / fit)
        norm = np.sqrt((q**2).sum(axis=1))
        spread = length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / math.sqrt(max(self.dim - 1, 1))
        rounding = np.outer(step / math.sqrt(12), length / fit)
        return estimate, EPSILON * np.sqrt(np.outer(norm, spread) ** 2 + rounding**2)


@dataclass(frozen=True)
class Fit:
    """What a bounded sample gives: the coder and how many cells to probe."""

    coder: Coder
    near: int


def kmeans(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part: an id, and a finite, non-zero vector of the table's commonest length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    widest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (widest["d"] if widest else 0))


def fit(rows: DataFrame, k: int, recall: float, sample: int = SAMPLE) -> Fit | None:
    """Learn from at most ``sample`` rows, in the order of a hash of the id; None without rows."""
    n = rows.count()
    if not n:
        return None
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas().drop_duplicates("vec_id")
    x = np.stack(drawn["v"].to_numpy())
    cells = max(1, min(round(math.sqrt(n)), len(x) // 8))
    rng = np.random.default_rng(3)
    coder = Coder(kmeans(x, cells), np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0])
    q = x[: min(len(x), 400)]
    product = q @ x.T
    product[np.arange(len(q)), np.arange(len(q))] = -np.inf
    nearest = np.argsort(-product, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ coder.centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, coder.assign(x)[nearest], axis=1).ravel())
    near = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else 1
    return Fit(coder, near)


def pack(coder: Coder, size: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each cell and how many it has: near cells share one of ``block`` vectors, larger ones have several."""
    rough = kmeans(coder.centres, max(1, len(size) // 8))
    near = np.argmin((rough**2).sum(axis=1) - 2 * coder.centres @ rough.T, axis=1)
    first, many = np.zeros(len(size), np.int64), np.maximum(1, -(-size // block))
    now, room = -1, 0
    for cell in np.lexsort((np.arange(len(size)), near)):
        if many[cell] > 1 or size[cell] > room:
            now, room = now + 1, block
        first[cell] = now
        if many[cell] > 1:
            now, room = now + many[cell] - 1, 0
        room -= size[cell]
    return first, many


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


_CODE = "cell int, vec_id long, v array<double>, bits binary, length double, fit double"
_ASK = "block long, query_id long, q array<double>"
_SCORE = "query_id long, vec_id long, score double"
_RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows where ``is_query`` holds, the ``k`` nearest found of all others.

    Nearness is the largest inner product, summed in double precision in the order of the components, so that equal
    vectors have equal scores; ties go to the smaller vec_id. Vectors that are null, zero, of another length than most,
    or hold null or non-finite components take no part, and neither do rows without an id. Rows that repeat a vec_id
    are one query and one candidate, which has its best score. With fewer than k candidates all are returned: a query
    goes on to further cells until those it has seen hold enough. Other columns are ignored, whatever their names.
    """
    rows = usable(vectors)
    fitted = fit(rows, k, recall, sample)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    coded = materialize(codes(rows, fitted.coder, k), "codes")
    best = scored(coded, rows.where(is_query), fitted, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def codes(rows: DataFrame, coder: Coder, k: int) -> DataFrame:
    """A row per vector, but of equal vectors those of the ``k + 1`` smallest ids."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), coder.dim)
            cell = coder.assign(x)
            bits, length, fitted = coder.encode(x, cell)
            packed = pa.array([b.tobytes() for b in bits], pa.binary())
            columns = [pa.array(cell.astype(np.int32)), batch.column("vec_id"), batch.column("v"), packed, pa.array(length), pa.array(fitted)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "vec_id", "v", "bits", "length", "fit"])

    hashed = rows.distinct().withColumns({"same1": F.xxhash64("v"), "same2": F.xxhash64(F.lit(1), "v")})
    order = Window.partitionBy("same1", "same2").orderBy("vec_id")
    return hashed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("vec_id", "v").mapInArrow(code, _CODE)


def scored(coded: DataFrame, queries: DataFrame, fitted: Fit, k: int) -> DataFrame:
    """``query_id, vec_id, score``: from each block that a query probes up to ``k`` of the nearest."""
    coder, dim = fitted.coder, fitted.coder.dim
    # One row per cell: at most an eighth of the sample.
    held = coded.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    size = np.zeros(len(coder.centres), np.int64)
    size[held["cell"]] = held["n"]
    # Of the rows in the cells that a query probes so many may be its own, or repeat an id that was seen before.
    spare = 1 + int(size.sum()) - coded.select("vec_id").distinct().count()
    first, many = pack(coder, size, max(256, min(BLOCK, math.ceil(size.sum() / 24))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
            block = first[cell] + (ids * 0x9E3779B1 >> 16) % many[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", *batch.schema.names])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), dim)
            order = np.argsort(-(q @ coder.centres.T), axis=1, kind="stable")
            seen = np.cumsum(size[order], axis=1)
            count = np.minimum(np.maximum(fitted.near, (seen < k + spare).sum(axis=1) + 1), order.shape[1])
            row, visits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(len(q)):
                cell = order[i, : count[i]]
                cell = cell[size[cell] > 0]
                blocks = np.unique(np.concatenate([first[cell], *[first[c] + np.arange(1, many[c]) for c in cell[many[cell] > 1]]]))
                row.append(np.full(len(blocks), i))
                visits.append(blocks)
            take = pa.array(np.concatenate(row))
            columns = [pa.array(np.concatenate(visits)), batch.column("vec_id").take(take), batch.column("v").take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "query_id", "q"])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, cell, length, fit = (left.column(c).to_numpy() for c in ("vec_id", "cell", "length", "fit"))
            x = _matrix(left.column("v").combine_chunks(), dim)
            bits = np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
            q, owners = _matrix(right.column("q").combine_chunks(), dim), right.column("query_id").to_numpy()
            # One more than k, as the query itself may be among them, and one for each row that repeats an id.
            place = len(ids) - (k + 1 + len(ids) - len(np.unique(ids)))
            for lo in range(0, len(q), _STEP):
                estimate, off = coder.bounds(bits, length, fit, cell, q[lo : lo + _STEP])
                again = np.ones(estimate.shape, bool)
                if place >= 0:
                    again = estimate + off >= np.partition(estimate - off, place, axis=1)[:, place, None]
                for j in range(len(again)):
                    own = np.flatnonzero(again[j] & (ids != owners[lo + j]))
                    out.append(_best(x, ids, own, q[lo + j], k, owners[lo + j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    asks = materialize(queries.select("vec_id", "v").distinct().mapInArrow(probe, _ASK), "probes")
    slots = asks.groupBy(F.col("block").alias("b")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("slots"))
    side = coded.mapInArrow(place, "block long, " + _CODE).join(slots, F.col("block") == F.col("b"))
    side = side.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("b", "slots")
    asks = asks.join(slots, F.col("block") == F.col("b")).withColumn("slot", F.pmod(F.xxhash64("query_id"), F.col("slots")).cast("int")).drop("b", "slots")
    keys = ["block", "slot"]
    return side.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(lambda left, right: nearest(left, right), _SCORE)


def _best(x: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, owner: int) -> tuple:
    """The ``k`` nearest of the rows ``own``. A product in blocks tells which can be among them, up to its rounding."""
    rough = x[own] @ q
    # Rows that repeat an id may stand before the k-th best of all ids.
    wanted = k + len(own) - len(np.unique(ids[own]))
    if len(own) > wanted:
        slack = 1e-9 * (1 + np.abs(rough).max())
        own = own[rough >= np.partition(rough, len(own) - wanted)[len(own) - wanted] - slack]
    score = dot(x[own], q)
    best = np.lexsort((ids[own], -score))
    fewer = best[: k + len(own) - len(np.unique(ids[own]))]  # rows that repeat an id count once
    return np.full(len(fewer), owner), ids[own][fewer], score[fewer]


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products with the rows of ``x``, added up from the first component to the last whatever the number of rows."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out
