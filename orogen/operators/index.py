"""A similarity index as a folder of Parquet tables: raw vectors, patch metadata, normalisation, and a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells, vectors
from .cells import Cells


@dataclass
class Index:
    """``vectors``: patch_id, embedding (not normalised); ``patches``: patch_id and metadata; ``norm``: d, shift, spread
    (None: no normalisation). Searches are exact, or with ``cells`` go to the nearest cells of the vectors only, which
    have a column ``cell`` then; ``m`` and ``ef_construction`` are kept for those who read manifests."""

    vectors: DataFrame
    patches: DataFrame
    norm: DataFrame | None
    space: str = "cosinesimil"
    signature: dict | None = None
    m: int = 16
    ef_construction: int = 200
    cells: Cells | None = None

    @staticmethod
    def build(
        embedded: DataFrame, patches: DataFrame, normalize: bool = True, space: str = "cosinesimil", signature: dict | None = None,
        approximate: bool = False, n_cells: int | None = None, probes: int | None = None, m: int = 16,
    ) -> Index:
        """An index of ``embedded`` (patch_id, embedding). If ``approximate``, its vectors are dealt to ``n_cells`` cells
        (by default the square root of their number) and a query probes ``probes`` of them (by default as many as a
        sample needs for a recall of ``cells.RECALL``); centres are learned on normalised vectors."""
        if space not in vectors.SPACES:
            raise ValueError(f"unknown space {space!r}")
        if embedded.isEmpty():
            raise ValueError("an index needs at least one vector")
        own = embedded.select("patch_id", F.col("embedding").cast("array<double>").alias("embedding"))
        index = Index(own, patches, vectors.parameters(own) if normalize else None, space, signature, m)
        if approximate:
            ready = index._normalized(own)
            index.cells = cells.fit(ready, space, n_cells, probes)
            # Cells are those of the normalised vectors; the index holds the others.
            index.vectors = index.cells.assigned(ready).select("patch_id", "cell").join(own, "patch_id")
        return index

    def _normalized(self, rows: DataFrame) -> DataFrame:
        return rows if self.norm is None else vectors.apply(rows, self.norm)

    def nearest(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """``query_id, rank, patch_id, distance`` for queries ``query_id, embedding``, which are normalised as the index is.
        ``probes`` is the breadth of an approximate search, in place of the index's own."""
        asked = self._normalized(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
        if self.cells is not None:
            return cells.search(self.vectors, asked, self.cells, k, probes, prepare=self._normalized)
        return vectors.knn(self._normalized(self.vectors), asked, k, self.space)

    def query(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """As ``nearest``, with the metadata of the patches (null where missing)."""
        return self.nearest(queries, k, probes).join(self.patches, "patch_id", "left")

    def query_by_id(self, patch_id: int, k: int = 10) -> DataFrame:
        """The nearest of a patch of the index, itself first."""
        own = self.vectors.where(F.col("patch_id") == patch_id).select(F.col("patch_id").alias("query_id"), "embedding")
        if own.isEmpty():
            raise ValueError(f"patch {patch_id} is not in the index")
        return self.query(own, k)

    def pick(self, seed: int = 0) -> int:
        """Some patch of the index, the same for the same seed."""
        return self.vectors.orderBy(F.xxhash64(F.lit(seed), "patch_id")).select("patch_id").first()["patch_id"]

    def stats(self) -> DataFrame:
        return self.vectors.agg(F.count("*").alias("n_patches"), F.max(F.size("embedding")).alias("embedding_dim")).select(
            "n_patches", "embedding_dim", F.lit(self.space).alias("space"), F.lit(self.m).alias("m"), F.lit(self.norm is not None).alias("normalized"), F.lit(True).alias("is_built")
        )

    def summary(self) -> DataFrame:
        """Mean, spread and range over every number of every vector."""
        v = self.vectors.select(F.explode("embedding").alias("v"))
        return v.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))

    def save(self, path: str) -> None:
        if self.cells is None:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        else:
            cells.save_placed(self.vectors, self.cells, path)
        self.patches.write.mode("overwrite").parquet(f"{path}/patches")
        if self.norm is not None:
            self.norm.write.mode("overwrite").parquet(f"{path}/norm")
        manifest = {"space": self.space, "normalized": self.norm is not None, "signature": self.signature, "m": self.m, "ef_construction": self.ef_construction, "probes": self.cells.probes if self.cells else None}
        spark = self.vectors.sparkSession
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        norm = spark.read.parquet(f"{path}/norm") if manifest["normalized"] else None
        space, own = manifest.get("space", "cosinesimil"), None
        if manifest.get("probes"):
            rows, own = cells.load(spark, path, space, manifest["probes"])
        else:
            rows = spark.read.parquet(f"{path}/vectors")
        return Index(rows, spark.read.parquet(f"{path}/patches"), norm, space, manifest.get("signature"), manifest.get("m", 16), manifest.get("ef_construction", 200), own)
