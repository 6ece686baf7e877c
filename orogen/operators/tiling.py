"""Rasters as cells ``y, x, z`` (null: no data) to patches and back, as grouped plans.

With ``tile`` columns given, everything runs per tile; ids are dense over the patches that survive. A patch's cells
meet in one group of ``patch_size`` squared rows at most, so nothing grows with the raster but the number of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_count(n, patch_size: int, overlap: int, partial: bool = True):
    """Patches along an axis of ``n`` cells; a remainder counts as one more if ``partial``."""
    stride = patch_size - overlap
    whole = F.floor((n - overlap) / stride)
    return F.when(F.lit(partial) & ((n - overlap) % stride > 0), whole + 1).otherwise(whole).cast("long")


def _boxes(cells: DataFrame, patch_size: int, overlap: int, pad_partial: bool, shape: DataFrame) -> DataFrame:
    """Each cell with the rows and columns of the patches that cover it."""
    stride = patch_size - overlap
    first = lambda v: F.greatest(F.floor((F.col(v) - patch_size) / stride) + 1, F.lit(0)).cast("long")
    last = lambda v, n: F.least(F.floor(F.col(v) / stride), grid_count(F.col(n), patch_size, overlap, pad_partial) - 1).cast("long")
    span = lambda v, n: F.when(last(v, n) >= first(v), F.sequence(first(v), last(v, n)))
    rows = cells.crossJoin(F.broadcast(shape))  # shape is one row
    return rows.withColumn("row", F.explode(span("y", "height"))).withColumn("col", F.explode(span("x", "width")))


def shape_of(cells: DataFrame) -> DataFrame:
    return cells.agg((F.max("y") + 1).cast("long").alias("height"), (F.max("x") + 1).cast("long").alias("width"))


def describe(cells: DataFrame) -> DataFrame:
    """Shape, range, mean, population spread and missing cells of a raster, in one aggregate."""
    return cells.agg(
        (F.max("y") + 1).cast("long").alias("height"), (F.max("x") + 1).cast("long").alias("width"), F.min("z").alias("min_z"), F.max("z").alias("max_z"),
        F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"), (F.count("*") - F.count("z")).alias("n_missing"),
    )


def tile(cells: DataFrame, patch_size: int = 64, overlap: int = 0, min_valid: float = 0.8, pad_partial: bool = True) -> DataFrame:
    """``patch_id, row, col, y_start, x_start, h, w, valid_fraction, mean`` of the patches with enough valid cells."""
    stride = patch_size - overlap
    grouped = _boxes(cells, patch_size, overlap, pad_partial, shape_of(cells)).groupBy("row", "col").agg(
        F.count("*").alias("n"), F.count("z").alias("valid"), F.avg("z").alias("mean"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w")
    )
    kept = grouped.withColumn("valid_fraction", 1.0 - (F.col("n") - F.col("valid")) / F.col("n")).where(F.col("valid_fraction") >= min_valid)
    ids = dense_ids(kept.select("row", "col"))
    return ids.join(kept, ["row", "col"]).select(
        "patch_id", "row", "col", (F.col("row") * stride).alias("y_start"), (F.col("col") * stride).alias("x_start"), "h", "w", "valid_fraction", "mean"
    )


def dense_ids(boxes: DataFrame) -> DataFrame:
    """``row, col, patch_id`` in row-major order: counts per row are added up first, and only then rows are numbered,
    so no window holds more than one row of patches or one count per row."""
    counts = boxes.groupBy("row").agg(F.count("*").alias("n"))
    before = counts.select("row", (F.sum("n").over(Window.orderBy("row")) - F.col("n")).alias("base"))
    own = boxes.withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1)
    return own.join(before, "row").select("row", "col", (F.col("base") + F.col("nth")).cast("long").alias("patch_id"))


def patch_cells(cells: DataFrame, patch_size: int, overlap: int = 0, min_valid: float = 0.8, pad_partial: bool = True) -> DataFrame:
    """``patch_id, y, x, z``: all cells of each patch. Partial patches are completed, and their gaps and padding take
    their mean; full ones keep their gaps."""
    boxes = tile(cells, patch_size, overlap, min_valid, pad_partial)
    axis = F.sequence(F.lit(0).cast("long"), F.lit(patch_size - 1).cast("long"))
    partial = (F.col("h") < patch_size) | (F.col("w") < patch_size)
    grid = boxes.select("patch_id", "y_start", "x_start", F.when(partial, F.col("mean")).alias("mean"), F.explode(axis).alias("y")).withColumn("x", F.explode(axis))
    known = cells.select(F.col("y").alias("gy"), F.col("x").alias("gx"), "z")
    joined = grid.join(known, (F.col("gy") == F.col("y_start") + F.col("y")) & (F.col("gx") == F.col("x_start") + F.col("x")), "left")
    return joined.select("patch_id", "y", "x", F.coalesce("z", "mean").alias("z"))


def as_arrays(patch_cells: DataFrame, patch_size: int) -> DataFrame:
    """``patch_id, h, w, data`` (row-major) from complete patch cells."""
    packed = patch_cells.groupBy("patch_id").agg(F.sort_array(F.collect_list(F.struct((F.col("y") * patch_size + F.col("x")).alias("i"), "z"))).alias("c"))
    return packed.select("patch_id", F.lit(patch_size).alias("h"), F.lit(patch_size).alias("w"), F.col("c.z").alias("data"))


def reconstruct(placed: DataFrame, shape: DataFrame) -> DataFrame:
    """Raster from patch cells ``gy, gx, z`` at raster places: the mean where patches overlap, 0 where none is."""
    blend = placed.groupBy(F.col("gy").alias("y"), F.col("gx").alias("x")).agg(F.avg("z").alias("z"))
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    grid = shape.select("width", axis("height").alias("y")).select("y", axis("width").alias("x"))
    return grid.join(blend, ["y", "x"], "left").select("y", "x", F.coalesce("z", F.lit(0.0)).alias("z"))


def patch_at(points: DataFrame, patches: DataFrame, patch_size: int, overlap: int = 0) -> DataFrame:
    """``points`` with the lowest ``patch_id`` whose box holds ``y, x`` (null: none).

    A point asks only for the few rows and columns whose boxes can hold it, by equi-join on row and column.
    """
    stride = patch_size - overlap
    span = lambda v: F.sequence(F.greatest(F.floor((F.col(v) - patch_size) / stride) + 1, F.lit(0)).cast("long"), F.floor(F.col(v) / stride).cast("long"))
    asked = points.where("y >= 0 and x >= 0").withColumn("row", F.explode(span("y"))).withColumn("col", F.explode(span("x")))
    hits = asked.join(patches.select("row", "col", "patch_id"), ["row", "col"]).groupBy("y", "x").agg(F.min("patch_id").alias("patch_id"))
    return points.join(hits, ["y", "x"], "left")


def info(shape: DataFrame, patch_size: int, overlap: int) -> DataFrame:
    """Grid arithmetic of a tiling, partial patches counted."""
    rows, cols = (grid_count(F.col(c), patch_size, overlap) for c in ("height", "width"))
    return shape.select(
        "height", "width", F.lit(patch_size - overlap).cast("long").alias("stride"), rows.alias("n_rows"), cols.alias("n_cols"), (rows * cols).alias("n_patches"),
        (rows * cols * patch_size**2 / (F.col("height") * F.col("width"))).alias("coverage"),
    )
