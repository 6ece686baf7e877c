"""Vectors ``patch_id, embedding``: normalisation, distances, exact nearest neighbours, separability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import SPACES
from .embed import spread

#: Queries whose vectors may be sent to every task: at most this many numbers.
BROADCAST_NUMBERS = 4_000_000


def parameters(vectors: DataFrame, method: str = "zscore") -> DataFrame:
    """One row per dimension ``d``: what to subtract and to divide by (1 where the spread is 0).

    One pass over whole vectors: tasks keep a running summary of all dimensions and only summaries are merged. Vectors
    have one length and no gaps; null ones are left out.
    """
    if method not in ("zscore", "minmax"):
        raise ValueError(f"unknown normalisation {method!r}")
    wanted = ("count", "mean", "variance") if method == "zscore" else ("min", "max")
    rows = vectors.where(F.col("embedding").isNotNull()).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    # Grouped by a constant, as a summary of no rows is an error; only summaries of tasks meet there.
    one = rows.groupBy(F.lit(1)).agg(Summarizer.metrics(*wanted).summary(F.col("v")).alias("s"))
    listed = {c: vector_to_array(F.col(f"s.{c}")) for c in wanted if c != "count"}
    if method == "zscore":
        # The summary's variance is that of a sample.
        n = F.col("s.count").cast("double")
        shift, spread = listed["mean"], F.transform(listed["variance"], lambda v: F.sqrt(v * (n - 1) / n))
    else:
        shift, spread = listed["min"], F.zip_with(listed["max"], listed["min"], lambda a, b: a - b)
    found = one.select(F.posexplode(F.arrays_zip(shift.alias("shift"), spread.alias("spread"))).alias("d", "p"))
    return found.select("d", "p.shift", F.when(F.col("p.spread") == 0, 1.0).otherwise(F.col("p.spread")).alias("spread"))


def apply(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """Normalised vectors. The parameters, a row of numbers per dimension, are fetched once and sent along as one row, so
    that later uses of the vectors don't aggregate them again."""
    spark = vectors.sparkSession
    rows = sorted((r["d"], r["shift"], r["spread"]) for r in params.select("d", "shift", "spread").collect())
    packed = spark.createDataFrame([(rows,)], "p array<struct<d:int,shift:double,spread:double>>")
    return vectors.crossJoin(F.broadcast(packed)).withColumn("embedding", F.zip_with("embedding", "p", lambda v, p: (v - p["shift"]) / p["spread"])).drop("p")


def normalize(vectors: DataFrame, method: str = "zscore") -> DataFrame:
    return apply(vectors, parameters(vectors, method))


def total(array):
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def dot(a, b):
    return total(F.zip_with(a, b, lambda x, y: x * y))


def distance(space: str, a, b):
    """Cosine distance (1 less the cosine), Euclidean or Manhattan distance of two array columns."""
    if space == "cosinesimil":
        return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if space == "l2":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if space == "l1":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown space {space!r}; known: {', '.join(SPACES)}")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, space: str = "cosinesimil", exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, patch_id, distance``: the ``k`` nearest vectors of each query (``query_id, embedding``).

    Queries of at most BROADCAST_NUMBERS numbers in all are sent to the vectors, which are scanned once, and shuffled only
    if the queries are more than a strip; each batch returns only its own ``k`` best per query. More of them meet the vectors in blocks
    (``blocks.knn_batch``). Ties go to the smaller id, and fewer than ``k`` vectors are all returned.
    """
    if space not in SPACES:
        raise ValueError(f"unknown space {space!r}; known: {', '.join(SPACES)}")
    few = fetched(queries)
    if few is None:
        return blocks.knn_batch(vectors, queries, k, space, exclude_self)
    ids, q = few

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                rows = pa.Table.from_batches([batch])
                x = blocks.matrix(rows.column("embedding"), batch.num_rows)
                for found in blocks.best_of(space, k, ids, q, batch.column("patch_id").to_numpy(), x, exclude_self=exclude_self):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "patch_id", "distance"])

    # With many queries the work is in the comparisons, so vectors are dealt out evenly, wherever their files have them.
    rows = vectors.select("patch_id", "embedding")
    found = (spread(rows) if len(ids) > blocks.STRIP else rows).mapInArrow(best, "query_id long, patch_id long, distance double")
    return blocks.ranked(found, k)


def fetched(queries: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of the queries, or None where they have more than ``most`` numbers (BROADCAST_NUMBERS)."""
    one = queries.select(F.size("embedding").alias("d")).first()
    if one is None:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    size = max(1, (most or BROADCAST_NUMBERS) // max(one["d"], 1))
    rows = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).limit(size + 1).toArrow()
    if rows.num_rows > size:
        return None
    return rows.column(0).to_numpy(), blocks.matrix(rows.column(1), rows.num_rows)


def separability(vectors: DataFrame, group: str = "tile_group") -> DataFrame:
    """Mean cosine distance within and across groups over all pairs, their ratio and the numbers of pairs.

    The mean over pairs of unit vectors follows from sums of vectors: the pairs of a set share the squared length of
    its sum. So one grouped sum per group stands for the square of its rows, and no pair is ever made.
    """
    square = dot(F.col("embedding"), F.col("embedding"))
    # Lengths are columns below the explode, so they are taken once per vector and not once per number.
    sized = vectors.select(F.col(group).alias("g"), (F.sqrt(square) + 1e-12).alias("length"), square.alias("square"), "embedding")
    per_dim = sized.select("g", "length", F.posexplode("embedding").alias("d", "v")).groupBy("g", "d").agg(F.sum(F.col("v") / F.col("length")).alias("s"))
    squared = per_dim.groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    counts = sized.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("square") / (F.col("length") * F.col("length"))).alias("own"))
    within = counts.join(squared, "g").agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n_within"), F.sum((F.col("ss") - F.col("own")) / 2).alias("dots_within"), F.sum("n").alias("n"), F.sum("own").alias("own")
    )
    every = per_dim.groupBy("d").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    one = within.crossJoin(F.broadcast(every))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2 - F.col("n_within")
    inside = 1 - F.col("dots_within") / F.col("n_within")
    across = 1 - ((F.col("all") - F.col("own")) / 2 - F.col("dots_within")) / pairs
    return one.select(
        inside.alias("within_mean"), across.alias("across_mean"), F.when(inside > 0, across / inside).alias("ratio"),
        F.col("n_within").cast("long").alias("n_within"), pairs.cast("long").alias("n_across"),
    )
