"""Search service over an index and a corpus: requests in, DataFrames out, errors that carry an HTTP status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cells, coords, vectors
from .operators.cells import Cells
from .operators.index import Index
from .sources import dem
from .sources.storage import stored


class ServiceError(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class Service:
    """``index``: patch_id, embedding (null: no index loaded); the corpus tables are null where there is no bridge."""

    index: DataFrame | None
    patches: DataFrame | None = None
    tiles: DataFrame | None = None
    meta: DataFrame | None = None
    space: str = "cosinesimil"
    cells: Cells | None = None

    @staticmethod
    def saved(spark: SparkSession, index: str, corpus: str | None = None, metadata: str | None = None) -> Service:
        """Over a saved index; with a build's output folder and the corpus's JSON searches by coordinates work as well.

        The index's vectors are normalised once and kept in the shared folder (by cell, if the index is approximate).
        """
        own = Index.load(spark, index)
        if own.cells is None:
            held = stored(own._normalized(own.vectors))
        else:
            held = cells.kept(own._normalized(own.vectors), own.cells)
        if corpus is None or metadata is None:
            return Service(held, space=own.space, cells=own.cells)
        named = spark.read.parquet(f"{corpus}/tiles").withColumns(
            {c: F.regexp_extract("tile_id", pattern, 1).cast("int") for c, pattern in (("tile_row", r"R(\d+)"), ("tile_col", r"C(\d+)"))}
        )
        return Service(held, own.patches, named, dem.corpus_metadata(spark, metadata), own.space, own.cells)

    @staticmethod
    def over(spark: SparkSession, sf_dir: str) -> Service:
        from .sources import fixtures as fx

        return Service(fx.vec_index(spark, sf_dir), fx.corpus_patches(spark, sf_dir), fx.corpus_tiles(spark, sf_dir), fx.corpus_meta(spark, sf_dir))

    def health(self) -> dict[str, object]:
        return {"status": "ok", "index_loaded": self.index is not None, "coords_available": self.meta is not None}

    def _ready(self, k: int) -> DataFrame:
        if self.index is None:
            raise ServiceError(503, "no index is loaded")
        if not 1 <= k <= 100:
            raise ServiceError(422, "k must be from 1 to 100")
        return self.index

    def info(self) -> DataFrame:
        return self._ready(1).agg(F.count("*").alias("n_patches"), F.max(F.size("embedding")).alias("embedding_dim"), F.lit(self.space).alias("space"))

    def query_by_id(self, patch_id: int, k: int = 10) -> DataFrame:
        """``rank, patch_id, distance`` of the nearest patches, the asked one first, with tile and box where known."""
        index = self._ready(k)
        asked = index.where(F.col("patch_id") == patch_id).select(F.col("patch_id").alias("query_id"), "embedding")
        if asked.isEmpty():
            raise ServiceError(404, f"no patch {patch_id}")
        near = vectors.knn(index, asked, k, self.space) if self.cells is None else cells.search(index, asked, self.cells, k)
        found = near.select("rank", "patch_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))
        return found if self.meta is None else found.join(coords.boxes(self.patches, self.tiles, self.meta), "patch_id", "left")

    def query_by_coords(self, lon: float | None = None, lat: float | None = None, x: float | None = None, y: float | None = None, crs: str | None = None, k: int = 10) -> DataFrame:
        """By longitude and latitude if given, else by x and y in feet, or in degrees where ``crs`` is EPSG:4326."""
        spark = self._ready(k).sparkSession
        if self.meta is None:
            raise ServiceError(501, "no corpus is loaded")
        if lon is None or lat is None:
            if x is None or y is None:
                raise ServiceError(422, "lon and lat, or x and y, are needed")
            lon, lat = (x, y) if (crs or "").upper() == "EPSG:4326" else (None, None)
        point = spark.createDataFrame([(x, y)], "x double, y double") if lon is None else coords.from_wgs84(spark.createDataFrame([(lon, lat)], "lon double, lat double"))
        hit = coords.patch_ids(coords.tile_pixels(point.select("x", "y"), self.tiles, self.meta), self.patches).first()
        if hit is None or hit["patch_id"] is None:
            raise ServiceError(404, "no patch at these coordinates")
        return self.query_by_id(hit["patch_id"], k)
