"""Shaded relief of patch cells, as window functions over a patch's rows and columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _slope(z: str, along: str, across: str):
    """Central difference along an axis, one-sided at the patch's edges."""
    order = Window.partitionBy("patch_id", across).orderBy(along)
    before, after = F.lag(z).over(order), F.lead(z).over(order)
    own = F.col(z)
    return F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2)


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """``patch_id, y, x, shade`` (0 to 1) of cells ``patch_id, y, x, z`` lit from ``azimuth`` at ``altitude`` degrees.

    Shades are stretched over the patch; of a flat patch the plain light is held between 0 and 1.
    """
    turn, height = math.radians(90.0 - azimuth), math.radians(altitude)
    sloped = cells.withColumns({"dy": _slope("z", "y", "x"), "dx": _slope("z", "x", "y")})
    light = -F.col("dx") * (math.cos(turn) * math.cos(height)) + F.col("dy") * (math.sin(turn) * math.cos(height)) + math.sin(height)
    lit = sloped.withColumn("v", light / F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + 1))
    whole = Window.partitionBy("patch_id")
    ranged = lit.withColumns({"low": F.min("v").over(whole), "high": F.max("v").over(whole)})
    shade = F.when(F.col("high") - F.col("low") > 1e-6, (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0)))
    return ranged.select("patch_id", "y", "x", shade.alias("shade"))
