"""Rasters, patches, vectors and a tile corpus derived from the driver's tables.

The tables hold no terrain, so embeddings and events stand in for it: a vector is a raster row or a patch of 8 by 8
cells, events average to a raster with gaps, and blocks of 25 vectors are tiles of a corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiling

#: Fixed geometry of the stand-in corpus: feet, and pixels per tile and patch.
X_MIN, Y_MAX, RESOLUTION, TILE_FT, TILE_PX, PATCH_PX, GRID_COLS, PER_TILE = 1_950_000.0, 760_000.0, 2.5, 800.0, 320, 64, 10, 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "z"))
    return rows.select("y", F.col("x").cast("long").alias("x"), F.col("z").cast("double").alias("z"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``patch_id, tile, h, w, data`` with 8 by 8 cells each."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("patch_id"), F.col("label").alias("tile"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("data")
    )


def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patches(spark, sf_dir).select("patch_id", "tile", F.posexplode("data").alias("i", "z"))
    return rows.select("patch_id", "tile", F.floor(F.col("i") / 8).cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"), "z")


def evt_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("y"), F.col("user_id").alias("x"), "value")
    cells = events.groupBy("y", "x").agg(F.avg("value").alias("z"))
    # The grid's two edges are a few numbers each, so the full grid comes from them and not from the events.
    days = events.agg(F.max("y").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("y"))
    users = events.agg(F.max("x").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("x"))
    return days.crossJoin(users).join(cells, ["y", "x"], "left")


def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cells of the 16-pixel patches of emb_raster: partial ones are padded with their mean."""
    return tiling.patch_cells(emb_raster(spark, sf_dir), 16)


def patches64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``patch_id, h, w, data``: 64 vectors in a row are a patch of 64 by 64 cells; rows without a vector are gaps."""
    y = F.col("vec_id") % 64
    held = read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).cast("long").alias("patch_id")).agg(F.map_from_entries(F.collect_list(F.struct(y.alias("y"), F.col("embedding").cast("array<double>").alias("v")))).alias("m"))
    return held.select("patch_id", F.lit(64).alias("h"), F.lit(64).alias("w"), F.expr("flatten(transform(sequence(0L, 63L), y -> coalesce(m[y], array_repeat(cast(null as double), 64))))").alias("data"))


def p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patches64(spark, sf_dir).select("patch_id", F.posexplode("data").alias("i", "z"))
    mean = rows.groupBy("patch_id").agg(F.avg("z").alias("m"))
    return rows.join(mean, "patch_id").select("patch_id", F.floor(F.col("i") / 64).cast("long").alias("y"), (F.col("i") % 64).cast("long").alias("x"), F.coalesce("z", "m").alias("z"))


def vec_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("tile_group"))


def corpus_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, local = F.floor(F.col("vec_id") / PER_TILE), F.col("vec_id") % PER_TILE
    two = lambda c: F.format_string("%02d", c.cast("long"))  # noqa: E731  padded, never cut: a long grid has rows of three digits
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("patch_id"),
        F.concat(F.lit("R"), two(F.floor(k / GRID_COLS)), F.lit("_C"), two(k % GRID_COLS)).alias("tile_id"),
        local.cast("int").alias("local_id"),
        (PATCH_PX * F.floor(local / 5)).cast("int").alias("y_start"),
        (PATCH_PX * (local % 5)).cast("int").alias("x_start"),
        F.lit(PATCH_PX).alias("patch_size"),
    )


def corpus_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_patches(spark, sf_dir).groupBy("tile_id").agg(F.count("*").alias("n_patches"), F.min("patch_id").alias("global_id_start"))
    part = F.split("tile_id", "_")
    return rows.select(
        "tile_id", F.substring(part[0], 2, 9).cast("int").alias("tile_row"), F.substring(part[1], 2, 9).cast("int").alias("tile_col"),
        F.lit(TILE_PX).alias("h"), F.lit(TILE_PX).alias("w"), "n_patches", "global_id_start",
    )


def corpus_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = F.floor(F.max("vec_id") / PER_TILE) + 1
    rows = F.ceil(F.col("tiles") / GRID_COLS).cast("int")
    return read(spark, sf_dir, "embeddings").agg(tiles.alias("tiles")).select(
        F.lit(X_MIN).alias("x_min"), (F.lit(Y_MAX) - TILE_FT * rows).alias("y_min"), F.lit(X_MIN + TILE_FT * GRID_COLS).alias("x_max"), F.lit(Y_MAX).alias("y_max"),
        F.lit(TILE_FT).alias("tile_size_ft"), F.lit(RESOLUTION).alias("resolution_ft"), rows.alias("grid_rows"), F.lit(GRID_COLS).alias("grid_cols"), F.lit("EPSG:3735").alias("crs"),
    )


def cust_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").crossJoin(F.broadcast(corpus_meta(spark, sf_dir))).select(
        "c_custkey",
        (F.col("x_min") - 200 + ((key * 7919) % 10007) / F.lit(10007.0) * 8400).alias("x"),
        (F.col("y_max") + 200 - ((key * 104729) % 10009) / F.lit(10009.0) * (F.lit(800.0) * F.col("grid_rows") + 400)).alias("y"),
    )


def nums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(256).withColumnRenamed("id", "i")


VIEWS = {f.__name__: f for f in (emb_raster, p8, evt_raster, p16, p64, vec_index, corpus_patches, corpus_tiles, corpus_meta, cust_points, nums)}

#: The same views for the SQL check, as common table expressions.
SQL = {
    "nums": "nums AS (SELECT range AS i FROM range(256))",
    "emb_raster": "emb_raster AS (SELECT vec_id AS y, u.i - 1 AS x, CAST(embedding[u.i] AS DOUBLE) AS z FROM embeddings, unnest(range(1, 65)) AS u(i))",
    "p8": "p8 AS (SELECT vec_id AS patch_id, label AS tile, (u.i - 1) // 8 AS y, (u.i - 1) % 8 AS x, CAST(embedding[u.i] AS DOUBLE) AS z FROM embeddings, unnest(range(1, 65)) AS u(i))",
    "evt_raster": """evt_cells AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS y, user_id AS x, avg(value) AS z FROM events GROUP BY ALL),
evt_raster AS (SELECT a.y, b.x, c.z FROM (SELECT unnest(range(0, (SELECT max(y) + 1 FROM evt_cells))) AS y) AS a
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(x) + 1 FROM evt_cells))) AS x) AS b LEFT JOIN evt_cells AS c ON a.y = c.y AND b.x = c.x)""",
    "p16": """p16_raster AS (SELECT vec_id AS gy, u.i - 1 AS gx, CAST(embedding[u.i] AS DOUBLE) AS z FROM embeddings, unnest(range(1, 65)) AS u(i)),
p16_boxes AS (SELECT gy // 16 AS r, gx // 16 AS c, avg(z) AS m, row_number() OVER (ORDER BY gy // 16, gx // 16) - 1 AS patch_id FROM p16_raster GROUP BY 1, 2),
p16 AS (SELECT b.patch_id, a.i AS y, k.i AS x, coalesce(e.z, b.m) AS z FROM p16_boxes AS b CROSS JOIN range(16) AS a(i) CROSS JOIN range(16) AS k(i)
  LEFT JOIN p16_raster AS e ON e.gy = b.r * 16 + a.i AND e.gx = b.c * 16 + k.i)""",
    "p64": """p64_m AS (SELECT vec_id // 64 AS patch_id, avg(CAST(u.v AS DOUBLE)) AS m FROM embeddings, unnest(embedding) AS u(v) GROUP BY 1),
p64 AS (SELECT p.patch_id, a.i AS y, k.i AS x, coalesce(CAST(e.embedding[k.i + 1] AS DOUBLE), p.m) AS z FROM p64_m AS p CROSS JOIN range(64) AS a(i) CROSS JOIN range(64) AS k(i)
  LEFT JOIN embeddings AS e ON e.vec_id = p.patch_id * 64 + a.i)""",
    "vec_index": "vec_index AS (SELECT vec_id AS patch_id, CAST(embedding AS DOUBLE[]) AS embedding, label AS tile_group FROM embeddings)",
    "corpus_patches": """corpus_patches AS (SELECT vec_id AS patch_id, printf('R%02d_C%02d', CAST(vec_id // 250 AS INTEGER), CAST((vec_id // 25) % 10 AS INTEGER)) AS tile_id,
  CAST(vec_id % 25 AS INTEGER) AS local_id, CAST(64 * ((vec_id % 25) // 5) AS INTEGER) AS y_start, CAST(64 * (vec_id % 5) AS INTEGER) AS x_start, 64 AS patch_size FROM embeddings)""",
    "corpus_tiles": """corpus_tiles AS (SELECT printf('R%02d_C%02d', CAST(vec_id // 250 AS INTEGER), CAST((vec_id // 25) % 10 AS INTEGER)) AS tile_id,
  CAST(vec_id // 250 AS INTEGER) AS tile_row, CAST((vec_id // 25) % 10 AS INTEGER) AS tile_col, 320 AS h, 320 AS w, count(*) AS n_patches, min(vec_id) AS global_id_start FROM embeddings GROUP BY 1, 2, 3)""",
    "corpus_meta": """corpus_meta AS (SELECT 1950000e0 AS x_min, 760000e0 - 800e0 * g AS y_min, 1958000e0 AS x_max, 760000e0 AS y_max, 800e0 AS tile_size_ft, 2.5e0 AS resolution_ft,
  g AS grid_rows, 10 AS grid_cols, 'EPSG:3735' AS crs FROM (SELECT CAST(ceil((max(vec_id) // 25 + 1) / 10) AS INTEGER) AS g FROM embeddings))""",
    "cust_points": """cust_points AS (SELECT c_custkey, 1949800e0 + ((c_custkey * 7919) % 10007) / CAST(10007 AS DOUBLE) * 8400 AS x,
  760200e0 - ((c_custkey * 104729) % 10009) / CAST(10009 AS DOUBLE) * (800e0 * g + 400) AS y
  FROM customer, (SELECT CAST(ceil((max(vec_id) // 25 + 1) / 10) AS INTEGER) AS g FROM embeddings))""",
}
