"""Search results laid over the raster: similarity labels, a fade mask, box corners and colours, a colour map.

Results are ``patch_id, rank, distance, y_start, x_start, patch_size``; a result covers its patch's cells only, so the
work follows the number of results and not the raster, except for the mask, which is the raster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cells(hits: DataFrame) -> DataFrame:
    axis = lambda start: F.explode(F.sequence(F.col(start), F.col(start) + F.col("patch_size") - 1))
    return hits.withColumn("y", axis("y_start")).withColumn("x", axis("x_start"))


def heatmap(hits: DataFrame, threshold: float) -> DataFrame:
    """``y, x, label`` (1 to 100, nearer is higher) under results within ``threshold``; where results overlap, the
    farther one paints last. Labels are scaled over all results, those beyond the threshold included."""
    low = hits.agg(F.min("distance").alias("low"), F.greatest(F.max("distance") - F.min("distance"), F.lit(0.001)).alias("span"))
    labelled = hits.crossJoin(F.broadcast(low)).where(F.col("distance") <= threshold)
    labelled = labelled.withColumn("label", F.floor(1 + (1 - (F.col("distance") - F.col("low")) / F.col("span")) * 99).cast("long"))
    return _cells(labelled).groupBy("y", "x").agg(F.max_by("label", "rank").alias("label"))


def fade(hits: DataFrame, shape: DataFrame, threshold: float) -> DataFrame:
    """``y, x, fade`` over the raster: 0 under results within ``threshold``, -0.5 elsewhere."""
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    grid = shape.select("width", axis("height").alias("y")).select("y", axis("width").alias("x"))
    hit = _cells(hits.where(F.col("distance") <= threshold)).select("y", "x").distinct().withColumn("hit", F.lit(True))
    return grid.join(hit, ["y", "x"], "left").select("y", "x", F.when(F.col("hit"), 0.0).otherwise(-0.5).alias("fade"))


def boxes(hits: DataFrame, query_id: int) -> DataFrame:
    """``patch_id, rank, corners, color``: green for the query, else from red towards yellow with distance."""
    most = hits.agg(F.greatest(F.max("distance"), F.lit(0.001)).alias("most"))
    far = F.col("distance") / F.col("most")
    two = lambda c: F.lower(F.lpad(F.hex(F.floor(c).cast("long")), 2, "0"))
    color = F.when(F.col("patch_id") == query_id, "#00ff00").otherwise(F.concat(F.lit("#ff"), two(100 + 100 * far), two(50 * far)))
    y, x, size = F.col("y_start"), F.col("x_start"), F.col("patch_size")
    corners = F.array(F.array(y, x), F.array(y, x + size), F.array(y + size, x + size), F.array(y + size, x))
    return hits.crossJoin(F.broadcast(most)).select("patch_id", "rank", corners.alias("corners"), color.alias("color"))


def colormap(spark: SparkSession) -> DataFrame:
    """``label, r, g, b, a`` of labels 0 (transparent) to 100."""
    t = (F.col("label") - 1) / 99.0
    part = lambda c: F.when(F.col("label") == 0, 0).otherwise(F.floor(c)).cast("long")
    return spark.range(101).withColumnRenamed("id", "label").select("label", part(255 * t).alias("r"), part(100 * (1 - F.abs(2 * t - 1))).alias("g"), part(255 * (1 - t)).alias("b"), part(F.lit(180)).alias("a"))


def clicks_to_pixels(clicks: DataFrame, shape: DataFrame, height: int = 400, width: int = 90) -> DataFrame:
    """``clicks`` (click_y, click_x, on a picture of ``height`` by ``width``) with the raster pixel ``py, px`` under
    each, held inside the raster. ``shape`` is one row."""
    held = lambda at, whole, size: F.least(F.greatest(F.floor(F.col(at) * (F.col(whole) / F.lit(float(size)))), F.lit(0)), F.col(whole) - 1).cast("long")
    own = clicks.crossJoin(F.broadcast(shape))
    return own.select(*clicks.columns, held("click_y", "height", height).alias("py"), held("click_x", "width", width).alias("px"))
