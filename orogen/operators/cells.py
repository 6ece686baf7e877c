"""An approximate index: vectors saved by coarse cell, queries that read the partitions of a few cells only.

Cells are those of k-means on a bounded sample, so every row is indexed but only the centres are learned from a part. The
cell is the table's partition column: a search names the cells that its queries probe, and the files of all others are
never opened. How many cells a query probes is the search breadth, measured on the sample unless it is given.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder
from . import blocks, vectors
from .embed import spread

#: Rows that centres are learned from at most, and numbers in the table of centres (which goes to every task).
SAMPLE, CENTRE_NUMBERS = 50_000, 4_000_000
#: Vectors in one file of a cell at most; a fuller cell has several files, written and read by several tasks.
ROWS_A_FILE = 200_000
#: Rows of the sample that the breadth is measured with, against which others, and the recall it is to reach.
PROBED, AGAINST, RECALL = 300, 20_000, 0.97


def unit(column: str = "embedding"):
    """The vector at length 1 (a zero vector as it is): nearest by cosine is nearest by distance then."""
    length = F.sqrt(vectors.dot(F.col(column), F.col(column)))
    return F.when(length > 0, F.transform(column, lambda v: v / length)).otherwise(F.col(column))


@dataclass(frozen=True)
class Cells:
    """``centres`` (cells by dimensions, unit vectors' centres for cosine) and ``probes``, the search breadth."""

    centres: np.ndarray
    probes: int
    space: str

    @property
    def count(self) -> int:
        return len(self.centres)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query by distance of their centre, nearest first."""
        if self.space == "cosinesimil":
            q = q / np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-300)[:, None]
        metric = "l1" if self.space == "l1" else "l2"
        return np.argsort(blocks.distances(metric, q, self.centres), axis=1, kind="stable")

    def assigned(self, rows: DataFrame, name: str = "cell") -> DataFrame:
        """``rows`` with the nearest cell of each vector."""
        return self._with_cells(rows, 1).withColumn(name, F.get("__cells", F.lit(0))).drop("__cells")

    def probing(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """``query_id, embedding, cell``: a row for each cell that a query probes."""
        return self._with_cells(queries, probes or self.probes).select("query_id", "embedding", F.explode("__cells").alias("cell"))

    def _with_cells(self, rows: DataFrame, many: int) -> DataFrame:
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("embedding")
                found = np.zeros((0, min(many, self.count)), np.int64)
                if batch.num_rows:
                    x = blocks.matrix(pa.Table.from_batches([batch]).column(at), batch.num_rows)
                    found = np.concatenate([self.order(x[lo : lo + 4096])[:, :many] for lo in range(0, len(x), 4096)])
                cells = pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*names, "__cells"])

        return spread(rows).mapInArrow(run, rows.withColumn("__cells", F.array(F.lit(0))).schema)


def fit(rows: DataFrame, space: str = "cosinesimil", count: int | None = None, probes: int | None = None, k: int = 10, sample: int = SAMPLE) -> Cells:
    """Centres of ``rows`` (patch_id, embedding), as many as the square root of the rows, but of a tenth of the sample
    and of what CENTRE_NUMBERS holds at most; and the breadth that reaches RECALL for ``k`` neighbours on the sample.

    The sample is the first ``sample`` rows in the order of a hash of the id.
    """
    ready = rows.select("patch_id", (unit() if space == "cosinesimil" else F.col("embedding")).alias("embedding"))
    size = ready.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    drawn = ready.orderBy(F.xxhash64("patch_id"), "patch_id").limit(sample)
    most = max(1, min(size["n"], sample) // 10)
    wanted = max(1, min(count or round(math.sqrt(size["n"])), most, CENTRE_NUMBERS // max(size["d"], 1)))
    if wanted == 1:  # k-means knows no single cell; its centre is the mean
        rows = sorted(vectors.parameters(drawn).select("d", "shift").collect())
        return Cells(np.array([[r["shift"] for r in rows]]), 1, space)
    learned = KMeans(k=wanted, seed=17, maxIter=10, featuresCol="v", predictionCol="p").fit(drawn.select(array_to_vector("embedding").alias("v")))
    own = Cells(np.stack(learned.clusterCenters()), 1, space)
    return Cells(own.centres, min(probes or breadth(own, drawn, k), own.count), space)


def breadth(cells: Cells, sample: DataFrame, k: int, recall: float = RECALL) -> int:
    """Cells to probe so that ``recall`` of the sample's own ``k`` nearest lie in them."""
    held = sample.select("embedding").limit(AGAINST).toArrow()
    x = blocks.matrix(held.column(0), held.num_rows)
    q = x[:PROBED]
    near = np.argsort(blocks.distances(cells.space, q, x), axis=1, kind="stable")[:, 1 : k + 1]
    if not near.size:
        return 1
    place = np.argsort(cells.order(q), axis=1)
    needed = np.sort(np.take_along_axis(place, cells.order(x)[:, 0][near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def save_placed(placed: DataFrame, cells: Cells, path: str) -> None:
    """Rows with their ``cell`` by cell under ``path/cells``, and the centres with the vectors in each under ``path/centres``.

    Rows go to the task of their cell and file, so a cell has as many files as its vectors need and no more.
    """
    spark = placed.sparkSession
    n = placed.groupBy("cell").agg(F.count("*").alias("n"))  # a row per cell
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cells.centres)], "cell int, centre array<double>")
    centres.join(n, "cell", "left").select("cell", "centre", F.coalesce("n", F.lit(0)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    files = spark.read.parquet(f"{path}/centres").select("cell", F.greatest(F.ceil(F.col("n") / ROWS_A_FILE), F.lit(1)).cast("int").alias("files"))
    dealt = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("patch_id"), F.col("files")).cast("int"))
    dealt.repartition("cell", "file").drop("file", "files").write.option("maxRecordsPerFile", ROWS_A_FILE).mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def kept(placed: DataFrame, cells: Cells) -> DataFrame:
    """Rows with their cell, saved by cell in the shared folder."""
    path = f"{shared_folder(placed.sparkSession)}/cells-{uuid.uuid4().hex}"
    save_placed(placed, cells, path)
    return placed.sparkSession.read.parquet(f"{path}/cells")


def load(spark: SparkSession, path: str, space: str, probes: int) -> tuple[DataFrame, Cells]:
    held = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    rows = spark.read.parquet(f"{path}/cells")
    return rows, Cells(blocks.matrix(held.column("centre"), held.num_rows), probes, space)


def pruned(rows: DataFrame, wanted: list[int]) -> DataFrame:
    """The rows of the named cells; only their partitions are read."""
    return rows.where(F.col("cell").isin(wanted))


def search(rows: DataFrame, queries: DataFrame, cells: Cells, k: int = 10, probes: int | None = None, exclude_self: bool = False, prepare=lambda rows: rows) -> DataFrame:
    """``query_id, rank, patch_id, distance``: the ``k`` nearest of each query (query_id, embedding) in the cells that it
    probes; ``prepare`` is applied to the vectors that are read (normalisation).

    What a query finds doesn't depend on the others it is asked with. Few queries are sent to the pruned vectors, many
    meet them in blocks of a cell. Fewer than ``k`` are returned where the probed cells hold fewer.
    """
    many = min(probes or cells.probes, cells.count)
    few = vectors.fetched(queries)
    asked = cells.probing(queries, many)
    if few is None:
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most all cells
        own = pruned(rows, wanted)
        size = own.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(max(1, blocks.BLOCK_NUMBERS // cells.centres.shape[1]))).cast("int").alias("parts"))
        part = lambda name: F.concat_ws(".", F.col("cell").cast("string"), F.col(name).cast("string"))
        held = prepare(own).join(F.broadcast(size), "cell").withColumn("part", F.pmod(F.xxhash64("patch_id"), F.col("parts")))
        parts = asked.join(F.broadcast(size), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left = held.select(part("part").alias("block"), "patch_id", "embedding")
        return blocks.ranked(blocks.nearest(left, parts.select(part("part").alias("block"), "query_id", "embedding"), k, cells.space, exclude_self), k)
    ids, q = few
    near = cells.order(q)[:, :many] if len(q) else np.zeros((0, 1), int)
    probed = np.zeros((len(ids), cells.count), bool)
    np.put_along_axis(probed, near, True, axis=1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cell").to_numpy()
            x = blocks.matrix(pa.Table.from_batches([batch]).column("embedding"), batch.num_rows) if batch.num_rows else None
            for cell in np.unique(own):
                at, asks = np.flatnonzero(own == cell), np.flatnonzero(probed[:, cell])
                for found in blocks.best_of(cells.space, k, ids[asks], q[asks], batch.column("patch_id").to_numpy()[at], x[at], exclude_self=exclude_self):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "patch_id", "distance"])

    own = prepare(pruned(rows, [int(c) for c in np.unique(near)])).select("cell", "patch_id", "embedding")
    return blocks.ranked(own.mapInArrow(best, "query_id long, patch_id long, distance double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_queries, n_found, hits, recall, least``: how many exact neighbours were found, on average and for the worst query."""
    hit = exact.select("query_id", "patch_id").join(found.select("query_id", "patch_id", F.lit(1).alias("hit")), ["query_id", "patch_id"], "left")
    each = hit.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    listed = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return each.join(listed, "query_id", "left").agg(
        F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_found"), F.sum("hits").alias("hits"),
        (F.sum("hits") / F.sum("wanted")).alias("recall"), F.min(F.col("hits") / F.col("wanted")).alias("least"),
    )
