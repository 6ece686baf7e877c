"""Coordinate bridge: EPSG:3735 feet, tiles, pixels and patches, as column expressions and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared_sql import LCC, forward, inverse


def to_wgs84(points: DataFrame) -> DataFrame:
    """``points`` (with ``x, y`` in feet) with ``lon, lat`` added."""
    return _project(points, lambda keep: f"WITH {LCC}, {inverse('{points}', 'x', 'y', keep)} SELECT {keep}, lon, lat FROM inv")


def from_wgs84(points: DataFrame) -> DataFrame:
    """``points`` (with ``lon, lat`` in degrees) with ``x, y`` in feet added."""
    return _project(points, lambda keep: f"WITH {LCC}, {forward('{points}', keep)} SELECT {keep}, fx AS x, fy AS y FROM fwd")


def _project(points: DataFrame, sql) -> DataFrame:
    return points.sparkSession.sql(sql(", ".join(f"`{c}`" for c in points.columns)), points=points)


def inside(x: Column, y: Column) -> Column:
    return (x >= F.col("x_min")) & (x < F.col("x_max")) & (y > F.col("y_min")) & (y <= F.col("y_max"))


def tile_pixels(points: DataFrame, tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """``points`` with ``tile_id, py, px``; null outside the corpus and where the tile isn't in it. ``meta`` is one row."""
    own = points.crossJoin(F.broadcast(meta.select("x_min", "y_min", "x_max", "y_max", "tile_size_ft", "resolution_ft", "grid_rows", "grid_cols")))
    at = inside(F.col("x"), F.col("y"))
    col = F.when(at, F.least(F.floor((F.col("x") - F.col("x_min")) / F.col("tile_size_ft")), F.col("grid_cols") - 1))
    row = F.when(at, F.least(F.floor((F.col("y_max") - F.col("y")) / F.col("tile_size_ft")), F.col("grid_rows") - 1))
    known = tiles.select("tile_id", F.col("tile_row").alias("tr"), F.col("tile_col").alias("tc"), "h", "w")
    joined = own.withColumn("row", row.cast("int")).withColumn("col", col.cast("int")).join(known, (F.col("row") == F.col("tr")) & (F.col("col") == F.col("tc")), "left")
    py = F.least(F.floor((F.col("y_max") - F.col("row") * F.col("tile_size_ft") - F.col("y")) / F.col("resolution_ft")), F.col("h") - 1)
    px = F.least(F.floor((F.col("x") - F.col("x_min") - F.col("col") * F.col("tile_size_ft")) / F.col("resolution_ft")), F.col("w") - 1)
    return joined.select(*points.columns, "tile_id", F.when(F.col("tile_id").isNotNull(), py).alias("py"), F.when(F.col("tile_id").isNotNull(), px).alias("px"))


def patch_ids(located: DataFrame, patches: DataFrame, patch_size: int = 64) -> DataFrame:
    """``located`` (tile_id, py, px) with the ``patch_id`` whose tile and start it snaps to (null: none)."""
    starts = patches.select(F.col("tile_id").alias("t"), F.col("y_start").alias("ys"), F.col("x_start").alias("xs"), "patch_id")
    snap = lambda c: F.floor(F.col(c) / patch_size) * patch_size
    return located.join(starts, (F.col("tile_id") == F.col("t")) & (snap("py") == F.col("ys")) & (snap("px") == F.col("xs")), "left").drop("t", "ys", "xs")


def boxes(patches: DataFrame, tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """``patch_id, tile_id, x_min, y_min, x_max, y_max`` in feet."""
    own = patches.join(tiles.select("tile_id", "tile_row", "tile_col"), "tile_id").crossJoin(F.broadcast(meta.select(F.col("x_min").alias("west"), F.col("y_max").alias("north"), "tile_size_ft", "resolution_ft")))
    left = F.col("west") + F.col("tile_col") * F.col("tile_size_ft")
    top = F.col("north") - F.col("tile_row") * F.col("tile_size_ft")
    feet = lambda c: c * F.col("resolution_ft")
    return own.select(
        "patch_id", "tile_id", (left + feet(F.col("x_start"))).alias("x_min"), (top - feet(F.col("y_start") + F.col("patch_size"))).alias("y_min"),
        (left + feet(F.col("x_start") + F.col("patch_size"))).alias("x_max"), (top - feet(F.col("y_start"))).alias("y_max"),
    )


def _degrees(boxes: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``west, south, east, north`` of boxes in feet, by two opposite corners."""
    corners = F.explode(F.array(F.struct(F.col("x_min").alias("x"), F.col("y_min").alias("y")), F.struct(F.col("x_max").alias("x"), F.col("y_max").alias("y"))))
    points = to_wgs84(boxes.select(*keep, corners.alias("c")).select(*keep, "c.x", "c.y"))
    return points.groupBy(*keep).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def boxes_wgs84(patches: DataFrame, tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """``patch_id, west, south, east, north`` in degrees."""
    return _degrees(boxes(patches, tiles, meta), "patch_id")


def bounds(meta: DataFrame) -> DataFrame:
    """The corpus's bounds in feet and in degrees."""
    own = ("x_min", "y_min", "x_max", "y_max")
    return _degrees(meta.select(*own, *[F.col(c).alias(f"own_{c}") for c in own]), *[f"own_{c}" for c in own]).withColumnsRenamed({f"own_{c}": c for c in own})


def tile_points(pixels: DataFrame, tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """``pixels`` (tile_id, py, px) with ``x, y`` in feet of the pixel's north-west corner (null: no such tile)."""
    own = pixels.join(tiles.select("tile_id", "tile_row", "tile_col"), "tile_id", "left").crossJoin(F.broadcast(meta.select("x_min", "y_max", "tile_size_ft", "resolution_ft")))
    x = F.col("x_min") + F.col("tile_col") * F.col("tile_size_ft") + F.col("px") * F.col("resolution_ft")
    y = F.col("y_max") - F.col("tile_row") * F.col("tile_size_ft") - F.col("py") * F.col("resolution_ft")
    return own.select(*pixels.columns, x.alias("x"), y.alias("y"))


def coverage(points: DataFrame, tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """``points`` with ``exit_code`` (0 inside the corpus, 1 outside), the tile's ``indexed`` and ``n_patches``, and the
    distances from the four bounds in feet."""
    located = tile_pixels(points, tiles, meta).join(tiles.select(F.col("tile_id").alias("t"), F.col("n_patches").alias("n")), F.col("tile_id") == F.col("t"), "left")
    own = located.crossJoin(F.broadcast(meta.select("x_min", "y_min", "x_max", "y_max")))
    return own.select(
        *points.columns, F.when(inside(F.col("x"), F.col("y")), 0).otherwise(1).alias("exit_code"), F.col("tile_id").isNotNull().alias("indexed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_patches"),
        (F.col("x") - F.col("x_min")).alias("from_west"), (F.col("x_max") - F.col("x")).alias("from_east"), (F.col("y") - F.col("y_min")).alias("from_south"), (F.col("y_max") - F.col("y")).alias("from_north"),
    )
