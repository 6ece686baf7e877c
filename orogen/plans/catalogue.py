"""The query catalogue over the driver's tables: DataFrame queries, shared SQL, and the SQL that checks them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import analysis, linear, spectral, terrain, texture
from ..functions import decomposition as dec
from ..functions.registry import DECOMPOSITIONS, TERRAIN, TEXTURE, UPSAMPLERS
from ..operators import blocks, build, cells, coords, embed, evaluate, filters, overlay, relief, surfaces, tiling, vectors
from ..operators.index import Index
from ..sources import fixtures as fx
from ..sources import elevation, storage
from ..sources.storage import stored
from . import shared_sql
from .shared_sql import r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query and, where SQL can express it, the SQL over ``views`` that checks it."""

    def add(func: Query) -> Query:
        QUERIES[name] = func
        if sql:
            ORACLES[name] = with_views(sql, views)
        return func

    return add


def _patches16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.as_arrays(fx.p16(spark, sf_dir), 16)


def _instead_of(name: str):
    """A query by an operator, checked by the SQL that is registered under its name."""

    def add(func: Query) -> Query:
        QUERIES[name] = func
        return func

    return add


def with_views(sql: str, views) -> str:
    """SQL with the fixture views it names put before it."""
    ctes = ",\n".join(fx.SQL[v] for v in views)
    sql = sql.strip()
    if not ctes:
        return sql
    return f"WITH {ctes},\n{sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes}\n{sql}"


def _shared(name: str, sql: str) -> None:
    """One SQL text for both engines; here its views and tables are DataFrames that are handed to it."""
    views = tuple(v for v in fx.VIEWS if f" {v} " in f"{sql} ".replace("\n", " ").replace(",", " ").replace(")", " "))
    tables = tuple(t for t in ("embeddings", "customer") if f"FROM {t}" in sql)
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join((*views, *tables)) or '$'})\b", r"\1 {\2}", sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {v: fx.VIEWS[v](spark, sf_dir) for v in views} | {t: fx.read(spark, sf_dir, t) for t in tables}
        if "p16" in frames:  # tiled once, however often the text refers to it
            frames["p16"] = stored(frames["p16"])
        return spark.sql(text, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})

    query(name, sql, views)(run)


for _name, _sql in shared_sql.QUERIES.items():
    _shared(_name, _sql)


def rounded(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


# --- elevation files --------------------------------------------------------------------------------------------


def _written_tiles(spark: SparkSession, sf_dir: str) -> str:
    """A folder of elevation files in the shared folder: each 150 rows of the raster are a tile, written by a task."""
    folder = f"{storage.shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    rows = fx.read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 150).cast("long").alias("tile"), (F.col("vec_id") % 150).alias("y"), "embedding")

    def write(tile: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((int(tile["y"].max()) + 1, len(tile["embedding"].iloc[0])), np.nan)
        grid[tile["y"].to_numpy()] = np.stack(tile["embedding"].to_numpy())
        elevation.write_grid(f"{folder}/{tile['tile'].iloc[0]}_dem.npy", grid)
        return tile[["tile"]].iloc[:1]

    elevation.make_folder(folder)
    rows.groupBy("tile").applyInPandas(write, "tile long").count()
    return folder


_ELEVATION = """WITH g AS (SELECT CAST(y // 150 AS VARCHAR) AS tile_id, (y % 150) // 16 AS r, x // 16 AS c, z FROM emb_raster),
p AS (SELECT tile_id, r, c, avg(z) AS m, CAST(count(z) AS DOUBLE) / count(*) AS vf, count(*) AS n, count(*) - count(z) AS gaps FROM g GROUP BY tile_id, r, c)"""


@query("elevation_blocks", f"""{_ELEVATION}
SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY r, c) - 1 AS local_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, {r('vf')} AS valid_fraction, {r('m')} AS mean FROM p""", ("emb_raster",))  # fmt: skip
def elevation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster as files, read again in blocks of rows and cut into patches."""
    cut = elevation.patches(spark, _written_tiles(spark, sf_dir), patch_size=16, block_bytes=40_000)
    mean = F.aggregate("data", F.lit(0.0), lambda a, v: a + v) / F.size("data")
    return cut.select("tile_id", "local_id", "row", "col", rounded("valid_fraction"), (F.round(mean, 6) + F.lit(0.0)).alias("mean"))


@query("elevation_counts", f"""{_ELEVATION}
SELECT tile_id, CAST(r AS INT) AS "row", CAST(sum(n) AS BIGINT) AS n_cells, CAST(sum(gaps) AS BIGINT) AS n_missing, CAST(count(*) AS BIGINT) AS n_patches FROM p GROUP BY tile_id, r""", ("emb_raster",))  # fmt: skip
def elevation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, gaps and patches of each row of patches, from which ids follow."""
    counted = elevation.read(spark, _written_tiles(spark, sf_dir), counts="true", patch_size=16, block_bytes=40_000)
    return counted.select("tile_id", "row", "n_cells", "n_missing", "n_patches")


# --- tiling -----------------------------------------------------------------------------------------------------


def _tiles_sql(raster: str, size: int, overlap: int, least: float, partial: bool, ranges: str = "range(0, 300) AS a(i), range(0, 3000) AS b(i)") -> str:
    stride = size - overlap
    count = lambda n: f"(({n} - {overlap}) // {stride}" + (f" + CASE WHEN ({n} - {overlap}) % {stride} > 0 THEN 1 ELSE 0 END)" if partial else ")")
    return f"""WITH sh AS (SELECT max(y) + 1 AS hh, max(x) + 1 AS ww FROM {raster}),
gr AS (SELECT a.i AS r, b.i AS c FROM sh, {ranges} WHERE a.i < {count('hh')} AND b.i < {count('ww')}),
bx AS (SELECT gr.r, gr.c, count(*) AS n, count(z) AS v, avg(z) AS m, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w
  FROM gr JOIN {raster} AS e ON e.y >= gr.r * {stride} AND e.y < gr.r * {stride} + {size} AND e.x >= gr.c * {stride} AND e.x < gr.c * {stride} + {size} GROUP BY gr.r, gr.c),
kp AS (SELECT *, 1.0 - CAST(n - v AS DOUBLE) / n AS vf FROM bx WHERE 1.0 - CAST(n - v AS DOUBLE) / n >= {least}),
t AS (SELECT row_number() OVER (ORDER BY r, c) - 1 AS patch_id, r AS "row", c AS col, r * {stride} AS y_start, c * {stride} AS x_start, h, w, vf, m FROM kp)"""


_TILE_COLUMNS = f'patch_id, "row", col, y_start, x_start, h, w, {r("vf")} AS valid_fraction, {r("m")} AS mean'


def _tiles(name: str, raster: str, size: int, overlap: int = 0, least: float = 0.8, partial: bool = True) -> None:
    @query(name, _tiles_sql(raster, size, overlap, least, partial) + f"\nSELECT {_TILE_COLUMNS} FROM t", (raster,))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tiling.tile(fx.VIEWS[raster](spark, sf_dir), size, overlap, least, partial)
        return found.select("patch_id", "row", "col", "y_start", "x_start", "h", "w", rounded("valid_fraction"), rounded("mean"))


_tiles("tile_patches_16", "emb_raster", 16)
_tiles("tile_patches_overlap4", "emb_raster", 16, 4)
_tiles("tile_patches_nodata", "evt_raster", 16, 0, 0.88)
_tiles("tile_patches_nopad", "emb_raster", 24, 0, 0.8, False)


@query("patch_metadata", _tiles_sql("emb_raster", 16, 0, 0.8, True) + '\nSELECT patch_id, "row", col, y_start, x_start, CAST(y_start + h // 2 AS BIGINT) AS center_y, CAST(x_start + w // 2 AS BIGINT) AS center_x FROM t', ("emb_raster",))
def patch_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda start, size: (F.col(start) + F.floor(F.col(size) / 2)).cast("long")
    return tiling.tile(fx.emb_raster(spark, sf_dir), 16).select("patch_id", "row", "col", "y_start", "x_start", half("y_start", "h").alias("center_y"), half("x_start", "w").alias("center_x"))


@query(
    "patch_padfill_mean",
    _tiles_sql("evt_raster", 16, 0, 0.88, True) + f"""
SELECT t.patch_id, a.i AS y, b.i AS x, {r('coalesce(e.z, CASE WHEN t.h < 16 OR t.w < 16 THEN t.m END)')} AS z FROM t CROSS JOIN range(16) AS a(i) CROSS JOIN range(16) AS b(i)
LEFT JOIN evt_raster AS e ON e.y = t.y_start + a.i AND e.x = t.x_start + b.i""",
    ("evt_raster",),
)
def patch_padfill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.patch_cells(fx.evt_raster(spark, sf_dir), 16, 0, 0.88).select("patch_id", "y", "x", rounded("z"))


@query("tiling_info", """WITH s AS (SELECT max(y) + 1 AS height, max(x) + 1 AS width FROM emb_raster)
SELECT height, width, CAST(12 AS BIGINT) AS stride, (height - 4 + 11) // 12 AS n_rows, (width - 4 + 11) // 12 AS n_cols, ((height - 4 + 11) // 12) * ((width - 4 + 11) // 12) AS n_patches,
  round(CAST(((height - 4 + 11) // 12) * ((width - 4 + 11) // 12) * 256 AS DOUBLE) / (height * width), 6) + 0.0 AS coverage FROM s""", ("emb_raster",))  # fmt: skip
def tiling_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.info(tiling.shape_of(fx.emb_raster(spark, sf_dir)), 16, 4)
    return found.select("height", "width", "stride", "n_rows", "n_cols", "n_patches", rounded("coverage"))


@query("reconstruct_mean_blend", f"SELECT y, x, {r('z')} AS z FROM emb_raster", ("emb_raster",))
def reconstruct_mean_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping patches of a raster blended again, which gives the raster back."""
    raster = fx.emb_raster(spark, sf_dir)
    placed = tiling.tile(raster, 16, 4).select("patch_id", "y_start", "x_start")
    cells = tiling.patch_cells(raster, 16, 4).join(placed, "patch_id").select((F.col("y_start") + F.col("y")).alias("gy"), (F.col("x_start") + F.col("x")).alias("gx"), "z")
    shape = tiling.shape_of(raster)
    return tiling.reconstruct(cells, shape).select("y", "x", rounded("z"))


def _points_of(spark: SparkSession, sf_dir: str, shape: DataFrame) -> DataFrame:
    """Points on all rows of a raster and a few beyond its edges, as far as there are customers."""
    key = F.col("c_custkey")
    points = fx.read(spark, sf_dir, "customer").crossJoin(F.broadcast(shape))
    return points.select((key % (F.col("height") + 20) - 5).alias("y"), ((key * 17 + F.floor(key / (F.col("height") + 20))) % (F.col("width") + 6) - 3).alias("x")).distinct()


def _patch_at_whole(name: str, overlap: int) -> None:
    sql = _tiles_sql("emb_raster", 16, overlap, 0.8, True, "unnest(range(0, hh)) AS a(i), unnest(range(0, ww)) AS b(i)") + """, p AS (SELECT DISTINCT c_custkey % (hh + 20) - 5 AS y, (c_custkey * 17 + c_custkey // (hh + 20)) % (ww + 6) - 3 AS x FROM customer CROSS JOIN sh)
SELECT p.y, p.x, min(t.patch_id) AS patch_id FROM p LEFT JOIN t ON p.y >= t.y_start AND p.y < t.y_start + 16 AND p.x >= t.x_start AND p.x < t.x_start + 16 GROUP BY p.y, p.x"""

    @query(name, sql, ("emb_raster",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raster = fx.emb_raster(spark, sf_dir)
        return tiling.patch_at(_points_of(spark, sf_dir, tiling.shape_of(raster)), tiling.tile(raster, 16, overlap), 16, overlap)


_patch_at_whole("patch_at_coords_whole", 0)
_patch_at_whole("patch_at_coords_overlap_whole", 4)


@query("feature_snr", f"""WITH q AS (SELECT patch_id, quantile_cont(abs(z), 0.95) AS t FROM p8 GROUP BY patch_id)
SELECT p.patch_id, {r('coalesce(stddev_pop(z) FILTER (abs(z) >= t) / nullif(stddev_pop(z) FILTER (abs(z) < t), 0), 0)')} AS feature_snr FROM p8 AS p JOIN q ON p.patch_id = q.patch_id GROUP BY p.patch_id""", ("p8",))  # fmt: skip
def feature_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.p8(spark, sf_dir)
    top = cells.groupBy("patch_id").agg(F.percentile(F.abs("z"), F.lit(0.95)).alias("t"))
    spread = lambda keep: F.stddev_pop(F.when(keep, F.col("z")))
    joined = cells.join(top, "patch_id").groupBy("patch_id").agg(spread(F.abs("z") >= F.col("t")).alias("big"), spread(F.abs("z") < F.col("t")).alias("rest"))
    return joined.select("patch_id", (F.round(F.coalesce(F.col("big") / F.when(F.col("rest") != 0, F.col("rest")), F.lit(0.0)), 6) + F.lit(0.0)).alias("feature_snr"))


@query("method_catalog")
def method_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g.kind, m.name, m.category, str(m.default_params), str(m.param_ranges), m.preserves, m.changes, m.description) for g in (DECOMPOSITIONS, UPSAMPLERS, TERRAIN, TEXTURE) for m in g.values()]
    return spark.createDataFrame(rows, "kind string, name string, category string, default_params string, param_ranges string, preserves string, changes string, description string")


# --- filters on the 8 by 8 patches ------------------------------------------------------------------------------


def _values(name: str, columns: str, rows) -> str:
    number = lambda v: f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(number(v) for v in row) + ")" for row in rows) + ")"


def _separable(matrix: np.ndarray, source: str = "p8", tag: str = "") -> str:
    """CTEs that apply one matrix along both axes; the result is ``b{tag}``."""
    rows = [(o, i, float(matrix[o, i])) for o in range(matrix.shape[0]) for i in range(matrix.shape[1]) if matrix[o, i] != 0]
    return f"""{_values(f'm{tag}', 'o, i, w', rows)},
a{tag} AS (SELECT patch_id, m.o AS y, s.x, sum(m.w * s.z) AS z FROM {source} AS s JOIN m{tag} AS m ON s.y = m.i GROUP BY patch_id, m.o, s.x),
b{tag} AS (SELECT patch_id, s.y, m.o AS x, sum(m.w * s.z) AS z FROM a{tag} AS s JOIN m{tag} AS m ON s.x = m.i GROUP BY patch_id, s.y, m.o)"""


def _spot(ctes: str, residual: str | None = None, trend: str = "b.z") -> str:
    residual, trend = (residual or "p.z - b.z"), (trend if residual is None else f"p.z - ({residual})")
    return f"WITH {ctes}\nSELECT p.patch_id, CAST(p.y AS BIGINT) AS y, CAST(p.x AS BIGINT) AS x, {r(trend)} AS trend, {r(residual)} AS residual FROM p8 AS p JOIN b ON p.patch_id = b.patch_id AND p.y = b.y AND p.x = b.x"


def _near(offsets, agg: str, source: str, out: str, mirror: bool = False) -> str:
    """CTE ``out``: an aggregate over a footprint with repeated edges."""
    rows = [(y, x, (y + (-dy if mirror else dy)) % 16, (x + (-dx if mirror else dx)) % 16) for y in range(8) for x in range(8) for dy, dx in offsets]
    fold = lambda v: v if v < 8 else 15 - v
    rows = [(y, x, fold(a), fold(b)) for y, x, a, b in rows]
    return f"{_values(f'f_{out}', 'y, x, ny, nx', rows)},\n{out} AS (SELECT s.patch_id, f.y, f.x, {agg}(s.z) AS z FROM {source} AS s JOIN f_{out} AS f ON s.y = f.ny AND s.x = f.nx GROUP BY s.patch_id, f.y, f.x)"


def _opening(offsets, tag: str = "o") -> str:
    return f"{_near(offsets, 'min', 'p8', f'e{tag}')},\n{_near(offsets, 'max', f'e{tag}', tag, True)}"


def _closing(offsets, tag: str = "c") -> str:
    return f"{_near(offsets, 'max', 'p8', f'd{tag}', True)},\n{_near(offsets, 'min', f'd{tag}', tag)}"


def _join(a: str, b: str, expression: str) -> str:
    return f"b AS (SELECT p.patch_id, p.y, p.x, {expression} AS z FROM p8 AS p JOIN {a} AS u ON u.patch_id = p.patch_id AND u.y = p.y AND u.x = p.x JOIN {b} AS v ON v.patch_id = p.patch_id AND v.y = p.y AND v.x = p.x)"


def _polynomial(degree: int) -> str:
    y, x = (a.ravel().astype(float) for a in np.mgrid[:8, :8])
    design = np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], axis=1)
    hat = design @ np.linalg.pinv(design)
    rows = [(int(o // 8), int(o % 8), int(i // 8), int(i % 8), float(hat[o, i])) for o in range(64) for i in range(64)]
    return f"{_values('hat', 'y, x, iy, ix, w', rows)},\nb AS (SELECT p.patch_id, h.y, h.x, sum(h.w * p.z) AS z FROM p8 AS p JOIN hat AS h ON p.y = h.iy AND p.x = h.ix GROUP BY p.patch_id, h.y, h.x)"


def _guided(radius: int, eps: float) -> str:
    box = linear.uniform_matrix(8, 2 * radius + 1)
    return f"""mm AS (SELECT patch_id, min(z) AS mn, max(z) - min(z) AS rg FROM p8 GROUP BY patch_id),
v1 AS (SELECT p.patch_id, y, x, (z - mn) / rg AS z FROM p8 AS p JOIN mm ON p.patch_id = mm.patch_id), v2 AS (SELECT patch_id, y, x, z * z AS z FROM v1),
{_separable(box, 'v1', '1')},
{_separable(box, 'v2', '2')},
ab AS (SELECT p.patch_id, p.y, p.x, (q.z - p.z * p.z) / (q.z - p.z * p.z + {eps}) AS sl, p.z AS me FROM b1 AS p JOIN b2 AS q ON p.patch_id = q.patch_id AND p.y = q.y AND p.x = q.x),
s3 AS (SELECT patch_id, y, x, sl AS z FROM ab), s4 AS (SELECT patch_id, y, x, me - sl * me AS z FROM ab),
{_separable(box, 's3', '3')},
{_separable(box, 's4', '4')},
b AS (SELECT v1.patch_id, v1.y, v1.x, (g.z * v1.z + h.z) * rg + mn AS z FROM v1 JOIN b3 AS g ON g.patch_id = v1.patch_id AND g.y = v1.y AND g.x = v1.x JOIN b4 AS h ON h.patch_id = v1.patch_id AND h.y = v1.y AND h.x = v1.x JOIN mm ON mm.patch_id = v1.patch_id)"""


def _diffusion(steps: int, kappa: float, gamma: float) -> str:
    """A patch is a list of 64 cells, of which a step reads four others; edges wrap around."""
    ctes = ["z0 AS MATERIALIZED (SELECT patch_id, list(z ORDER BY y, x) AS g FROM p8 GROUP BY patch_id)"]
    near = ("(i + 56) % 64", "(i + 8) % 64", "i // 8 * 8 + (i + 7) % 8", "i // 8 * 8 + (i + 1) % 8")
    flow = " + ".join(f"(g[{n} + 1] - g[i + 1]) * exp(-pow((g[{n} + 1] - g[i + 1]) / CAST({kappa} AS DOUBLE), 2))" for n in near)
    for k in range(steps):
        ctes.append(f"z{k + 1} AS MATERIALIZED (SELECT patch_id, list_transform(range(64), lambda i: g[i + 1] + CAST({gamma} AS DOUBLE) * ({flow})) AS g FROM z{k})")
    return ",\n".join([*ctes, f"b AS (SELECT patch_id, u.i // 8 AS y, u.i % 8 AS x, g[u.i + 1] AS z FROM z{steps}, unnest(range(64)) AS u(i))"])


def _bilateral(radius: int, sigma_color: float, sigma_space: float) -> str:
    fold = lambda v: abs(v) if v < 8 else 14 - v
    rows = [(y, x, fold(y + dy), fold(x + dx), dy * dy + dx * dx) for y in range(8) for x in range(8) for dy, dx in dec.disk(radius)]
    return f"""{_values('f', 'y, x, ny, nx, d2', rows)},
mm AS (SELECT patch_id, min(z) AS mn, max(z) - min(z) AS rg FROM p8 GROUP BY patch_id),
v AS (SELECT p.patch_id, y, x, (z - mn) / rg * 255 AS z, mn, rg FROM p8 AS p JOIN mm ON p.patch_id = mm.patch_id),
w AS (SELECT c.patch_id, c.y, c.x, c.mn, c.rg, n.z, exp(-CAST(f.d2 AS DOUBLE) / {2 * sigma_space**2} - pow(n.z - c.z, 2) / {2 * sigma_color**2}) AS w FROM v AS c JOIN f ON c.y = f.y AND c.x = f.x JOIN v AS n ON n.patch_id = c.patch_id AND n.y = f.ny AND n.x = f.nx),
b AS (SELECT patch_id, y, x, sum(w * z) / sum(w) / 255 * max(rg) + max(mn) AS z FROM w GROUP BY patch_id, y, x)"""


def _rolling_ball(radius: int) -> str:
    """Erosion less a bowl's heights, then dilation with them; the centre, of height 0, is left out."""
    offsets = [(y, x, radius - max(radius**2 - x * x - y * y, 0) ** 0.5) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if x or y]
    fold = lambda v: v % 16 if v % 16 < 8 else 15 - v % 16
    cells = lambda sign: [(y, x, fold(y + sign * dy), fold(x + sign * dx), float(h)) for y in range(8) for x in range(8) for dy, dx, h in offsets]
    return f"""{_values('fe', 'y, x, ny, nx, h', cells(1))},
{_values('fd', 'y, x, ny, nx, h', cells(-1))},
er AS (SELECT s.patch_id, f.y, f.x, min(s.z - f.h) AS z FROM p8 AS s JOIN fe AS f ON s.y = f.ny AND s.x = f.nx GROUP BY s.patch_id, f.y, f.x),
b AS (SELECT s.patch_id, f.y, f.x, max(s.z + f.h) AS z FROM er AS s JOIN fd AS f ON s.y = f.ny AND s.x = f.nx GROUP BY s.patch_id, f.y, f.x)"""


def _decomposition(name: str, params: dict, sql: str | None) -> None:
    @query(f"decomp_{name}", sql, ("p8",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        method = name.removesuffix("_default")
        return filters.decompose(fx.patches(spark, sf_dir), method, 8, 8, **params).select("patch_id", "y", "x", rounded("trend"), rounded("residual"))


_D2 = dec.disk(2)
_median = f"{_near(dec.square(3), 'median', 'p8', 'b')}"
_two_sided = f"{_opening(_D2)},\n{_closing(_D2)}"
_dog = f"{_separable(linear.gaussian_matrix(8, 1.0, 'nearest'), 'p8', '1')},\n{_separable(linear.gaussian_matrix(8, 3.0, 'nearest'), 'p8', '2')},\n{_join('b1', 'b2', 'u.z - v.z')}"
_g5, _l8 = linear.gaussian_matrix(8, 1.5), linear.laplace_matrix(8)
_log = f"""{_separable(_g5, 'p8', '1')},
{_values('lp', 'o, i, w', [(o, i, float(_l8[o, i])) for o in range(8) for i in range(8) if _l8[o, i]])},
ly AS (SELECT patch_id, lp.o AS y, s.x, sum(lp.w * s.z) AS z FROM b1 AS s JOIN lp ON s.y = lp.i GROUP BY patch_id, lp.o, s.x),
lx AS (SELECT patch_id, s.y, lp.o AS x, sum(lp.w * s.z) AS z FROM b1 AS s JOIN lp ON s.x = lp.i GROUP BY patch_id, s.y, lp.o),
{_join('ly', 'lx', '(u.z + v.z) * 2.25')}"""
_aniso = f"""{_values('my', 'o, i, w', [(o, i, float(linear.gaussian_matrix(8, 1.0)[o, i])) for o in range(8) for i in range(8) if linear.gaussian_matrix(8, 1.0)[o, i]])},
ay AS (SELECT patch_id, my.o AS y, s.x, sum(my.w * s.z) AS z FROM p8 AS s JOIN my ON s.y = my.i GROUP BY patch_id, my.o, s.x),
{_values('mx', 'o, i, w', [(o, i, float(linear.gaussian_matrix(8, 2.0)[o, i])) for o in range(8) for i in range(8) if linear.gaussian_matrix(8, 2.0)[o, i]])},
b AS (SELECT patch_id, s.y, mx.o AS x, sum(mx.w * s.z) AS z FROM ay AS s JOIN mx ON s.x = mx.i GROUP BY patch_id, s.y, mx.o)"""

for _name, _params, _sql in [
    ("gaussian", {"sigma": 2}, _spot(_separable(linear.gaussian_matrix(8, 2.0)))),
    ("bilateral", {}, _spot(_bilateral(4, 75, 75))),
    ("wavelet_dwt", {}, _spot(_separable(linear.wavelet_trend_matrix(8, "db4", 3)))),
    ("morphological", {"size": 2}, _spot(_opening(_D2, "b"))),
    ("tophat", {"size": 2}, _spot(_opening(_D2, "b"))),
    ("polynomial", {"degree": 2}, _spot(_polynomial(2))),
    ("gaussian_anisotropic", {"sigma_y": 1, "sigma_x": 2}, _spot(_aniso)),
    ("median", {"size": 3}, _spot(_median)),
    ("uniform", {"size": 3}, _spot(_separable(linear.uniform_matrix(8, 3)))),
    ("dog", {"sigma_low": 1, "sigma_high": 3}, _spot(_dog, "b.z")),
    ("log", {"sigma": 1.5}, _spot(_log, "b.z")),
    ("morphological_square", {"operation": "closing", "size": 3}, _spot(_closing(dec.square(3), "b"))),
    ("morphological_diamond", {"operation": "opening", "radius": 2}, _spot(_opening(dec.diamond(2), "b"))),
    ("morphological_gradient", {"size": 1}, _spot(f"{_near(dec.disk(1), 'max', 'p8', 'hi', True)},\n{_near(dec.disk(1), 'min', 'p8', 'lo')},\n{_join('hi', 'lo', 'u.z - v.z')}", "b.z")),
    ("tophat_combined", {"size": 2}, _spot(f"{_two_sided},\n{_join('o', 'c', '(p.z - u.z) - (v.z - p.z)')}", "b.z")),
    ("anisotropic_diffusion", {"iterations": 2, "kappa": 0.2}, _spot(_diffusion(2, 0.2, 0.1))),
    ("guided", {"radius": 1}, _spot(_guided(1, 0.01))),
    ("rolling_ball", {"radius": 3}, _spot(_rolling_ball(3))),
    ("wavelet_biorthogonal", {}, _spot(_separable(linear.wavelet_trend_matrix(8, "bior3.5", 3)))),
]:
    _decomposition(_name, _params, _sql)

# At the operators' own sizes.
_decomposition("anisotropic_diffusion_default", {}, _spot(_diffusion(10, 50, 0.1)))


@query("decomp_rolling_ball_default")
def decomp_rolling_ball_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bowl of 7,852 heights can't be put together from runs, so it stays one NumPy pass; a test holds it to brute force."""
    return embed.grids(fx.patches(spark, sf_dir), DECOMPOSITIONS, "rolling_ball").select("patch_id", "y", "x", rounded("trend"), rounded("residual"))


def _up_sql(matrix: np.ndarray) -> str:
    return f"WITH {_separable(matrix)}\nSELECT patch_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {r('z')} AS z FROM b"


def _fft_sql() -> str:
    """Zero-padding along one axis is a complex matrix, so both axes give the difference of two real products."""
    k = np.arange(8)
    forward = np.exp(-2j * np.pi * np.outer(k, k) / 8)
    backward = np.exp(2j * np.pi * np.outer(np.arange(16), np.where(k < 4, k, k - 8)) / 16) / 8
    whole = backward @ forward
    return f"""WITH {_separable(whole.real, 'p8', '1')},
{_separable(whole.imag, 'p8', '2')}
SELECT b1.patch_id, CAST(b1.y AS BIGINT) AS y, CAST(b1.x AS BIGINT) AS x, {r('b1.z - coalesce(b2.z, 0)')} AS z FROM b1 LEFT JOIN b2 ON b1.patch_id = b2.patch_id AND b1.y = b2.y AND b1.x = b2.x"""


def _regularized_sql() -> str:
    """Ten linear steps from a linear start are one matrix over all cells."""
    zoom, lap = linear.zoom_matrix(8, 2.0, 3), linear.laplace_matrix(16)
    whole = np.kron(zoom, zoom)
    step = np.eye(256) - 0.01 * (np.kron(lap, np.eye(16)) + np.kron(np.eye(16), lap))
    known = [(2 * y) * 16 + 2 * x for y in range(8) for x in range(8)]
    for _ in range(10):
        whole = step @ whole
        whole[known] = np.eye(64)
    rows = [(o // 16, o % 16, i // 8, i % 8, float(whole[o, i])) for o in range(256) for i in range(64) if abs(whole[o, i]) > 1e-15]
    return f"""WITH {_values('hat', 'y, x, iy, ix, w', rows)}
SELECT p.patch_id, CAST(h.y AS BIGINT) AS y, CAST(h.x AS BIGINT) AS x, {r('sum(h.w * p.z)')} AS z FROM p8 AS p JOIN hat AS h ON p.y = h.iy AND p.x = h.ix GROUP BY p.patch_id, h.y, h.x"""


def _edge_sql() -> str:
    bilinear = linear.zoom_matrix(8, 2.0, 1)
    return f"""WITH gr AS (SELECT patch_id, y, x, {shared_sql.gradient('z', shared_sql.BY_Y)} AS dy, {shared_sql.gradient('z', shared_sql.BY_X)} AS dx FROM p8),
gy AS (SELECT patch_id, y, x, dy AS z FROM gr), gx AS (SELECT patch_id, y, x, dx AS z FROM gr),
{_separable(linear.zoom_matrix(8, 2.0, 3), 'p8', '1')},
{_separable(linear.lanczos_matrix(8, 2), 'p8', '2')},
{_separable(bilinear, 'gy', '3')},
{_separable(bilinear, 'gx', '4')},
st AS (SELECT u.patch_id, u.y, u.x, sqrt(u.z * u.z + v.z * v.z) AS s FROM b3 AS u JOIN b4 AS v ON u.patch_id = v.patch_id AND u.y = v.y AND u.x = v.x),
sh AS (SELECT patch_id, y, x, s / (max(s) OVER (PARTITION BY patch_id) + 1e-10) AS s FROM st)
SELECT sh.patch_id, CAST(sh.y AS BIGINT) AS y, CAST(sh.x AS BIGINT) AS x, {r('b1.z * (1 - s) + b2.z * s')} AS z FROM sh JOIN b1 ON b1.patch_id = sh.patch_id AND b1.y = sh.y AND b1.x = sh.x JOIN b2 ON b2.patch_id = sh.patch_id AND b2.y = sh.y AND b2.x = sh.x"""


def _upsampler(name: str, sql: str | None) -> None:
    @query(f"up_{name}", sql, ("p8",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.upsample(fx.patches(spark, sf_dir), name, 8, 8).select("patch_id", "y", "x", rounded("z"))


_window = lambda w: linear.stuffed_matrix(8, 2, np.sinc(np.arange(-8, 9) / 2) * w)
_t = np.abs(np.arange(-8, 9) / 2)
_mitchell = np.where(_t < 1, (7 * _t**3 - 12 * _t**2 + 16 / 3) / 6, np.where(_t < 2, (-7 / 3 * _t**3 + 12 * _t**2 - 20 * _t + 32 / 3) / 6, 0.0))
for _name, _matrix in {
    "bicubic": linear.zoom_matrix(8, 2.0, 3), "lanczos": linear.lanczos_matrix(8, 2), "bspline": linear.zoom_matrix(8, 2.0, 2), "fft_zeropad": _fft_sql(),
    "nearest": linear.zoom_matrix(8, 2.0, 0), "bilinear": linear.zoom_matrix(8, 2.0, 1), "quadratic": linear.zoom_matrix(8, 2.0, 2), "quartic": linear.zoom_matrix(8, 2.0, 4), "quintic": linear.zoom_matrix(8, 2.0, 5),
    "sinc_hamming": _window(np.hamming(17)), "sinc_blackman": _window(np.blackman(17)), "cubic_catmull_rom": linear.not_a_knot_matrix(8, 16), "cubic_mitchell": linear.stuffed_matrix(8, 2, _mitchell),
    "edge_directed": _edge_sql(), "regularized": _regularized_sql(),
}.items():
    _upsampler(_name, _matrix if isinstance(_matrix, str) else _up_sql(_matrix))


# --- signatures -------------------------------------------------------------------------------------------------


def _signature(name: str, config: cfg.SignatureConfig) -> None:
    @query(f"signature_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return embed.embed(fx.patches(spark, sf_dir), config)


for _name in ("default", "classic", "texture", "hybrid", "minimal", "spectral", "spectral_hybrid"):
    _signature(_name, cfg.preset(_name))


def _residuals(**changes) -> cfg.SignatureConfig:
    config = cfg.preset("residuals")
    for key, value in changes.items():
        setattr(config.residuals, key, value)
    return config


_signature("residuals", _residuals())
_signature("residuals_bidirectional", _residuals(bidirectional=True))
_signature("residuals_turing", _residuals(turing=True, turing_iterations=10))
_signature("residuals_turing_default", _residuals(turing=True))


@query("residuals_failures")
def residuals_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of a configuration of which one upsampler can't run on patches of 3 by 3 cells."""
    small = fx.patches(spark, sf_dir).select("patch_id", F.lit(3).alias("h"), F.lit(3).alias("w"), F.slice("data", 1, 9).alias("data"))
    config = _residuals(decomposition_methods=["gaussian"], upsampling_methods=["bilinear", "cubic_catmull_rom"], bidirectional=True)
    return embed.diagnostics(embed.embed(small, config))


@query("sweep_variant_best")
def sweep_variant_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residual variant that tells tiles apart best, over all patches."""
    return evaluate.best(evaluate.variants(fx.patches(spark, sf_dir))).select("variant", rounded("ratio"), "dim", rounded("gain_pct", 4), rounded("cost"))


def _partly_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of a configuration of which one upsampler can't run on the patches of every second tile, which are cut
    down to 3 by 3 cells."""
    odd = F.col("tile") % 2 == 1
    own = fx.patches(spark, sf_dir).select(
        "patch_id", F.col("tile").cast("string").alias("tile_id"), F.when(odd, 3).otherwise(8).alias("h"), F.when(odd, 3).otherwise(8).alias("w"), F.when(odd, F.slice("data", 1, 9)).otherwise(F.col("data")).alias("data")
    )
    config = _residuals(decomposition_methods=["gaussian"], upsampling_methods=["bilinear", "cubic_catmull_rom"], bidirectional=True)
    placed = own.withColumns({"local_id": F.col("patch_id"), "y_start": F.lit(0), "x_start": F.lit(0), "tile_h": F.lit(8), "tile_w": F.lit(8)})
    return embed.embed(placed, config, ("patch_id", "tile_id", "local_id", "y_start", "x_start", "tile_h", "tile_w"))


_FAILED = "e(entry) AS (VALUES ('gaussian/cubic_catmull_rom:A:ValueError'), ('gaussian/cubic_catmull_rom:B:no_A_to_compare'))"


@query("diagnostics_rollup", f"""WITH {_FAILED}
SELECT entry, CAST(count(*) AS BIGINT) AS n_patches, CAST(count(DISTINCT label) AS BIGINT) AS tiles_with_failures FROM embeddings CROSS JOIN e WHERE label % 2 = 1 GROUP BY entry""")  # fmt: skip
def diagnostics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_partly_failing(spark, sf_dir))
    return build.failures(build.records(rows, rows.select("tile_id").distinct()))


ORACLES["residuals_failures"] = f"WITH {_FAILED}\nSELECT entry, CAST(count(*) AS BIGINT) AS n_patches FROM embeddings CROSS JOIN e GROUP BY entry"


@query("diagnostics_by_tile", f"WITH {_FAILED}\nSELECT label AS tile, entry, CAST(count(*) AS BIGINT) AS n_patches FROM embeddings CROSS JOIN e GROUP BY label, entry")
def diagnostics_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the configuration of residuals_failures, tile by tile."""
    small = fx.patches(spark, sf_dir).select("patch_id", "tile", F.lit(3).alias("h"), F.lit(3).alias("w"), F.slice("data", 1, 9).alias("data"))
    config = _residuals(decomposition_methods=["gaussian"], upsampling_methods=["bilinear", "cubic_catmull_rom"], bidirectional=True)
    entries = embed.embed(small, config, ("patch_id", "tile")).select("patch_id", "tile", F.explode("failed").alias("entry"))
    return entries.groupBy("tile", "entry").agg(F.countDistinct("patch_id").alias("n_patches"))


@query("lbp_hist_stats")
def lbp_hist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = cfg.preset("texture")
    config.texture.features = ["lbp"]
    return embed.embed(fx.patches(spark, sf_dir), config).select("patch_id", F.col("embedding").alias("stats"))


# --- vectors ----------------------------------------------------------------------------------------------------

_LONG = """WITH l AS (SELECT patch_id, u.d AS d, embedding[u.d] AS v FROM vec_index, unnest(range(1, 65)) AS u(d)),
s AS (SELECT d, {shift} AS a, CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END AS b FROM l GROUP BY d),
n AS (SELECT patch_id, l.d, (v - a) / b AS z FROM l JOIN s ON l.d = s.d),
"""
_Z = _LONG.format(shift="avg(v)", spread="stddev_pop(v)")


def _normalized(name: str, method: str, shift: str, spread: str) -> None:
    @query(name, _LONG.format(shift=shift, spread=spread) + f"o AS (SELECT 1)\nSELECT patch_id, CAST(d - 1 AS BIGINT) AS d, {r('z')} AS v FROM n", ("vec_index",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors.normalize(fx.vec_index(spark, sf_dir), method).select("patch_id", F.posexplode("embedding").alias("d", "v"))
        return rows.select("patch_id", F.col("d").cast("long").alias("d"), rounded("v"))


_normalized("zscore_vectors", "zscore", "avg(v)", "stddev_pop(v)")
_normalized("minmax_vectors", "minmax", "min(v)", "max(v) - min(v)")


@query("embedding_summary", f"""WITH l AS (SELECT unnest(embedding) AS v, patch_id FROM vec_index)
SELECT CAST(count(DISTINCT patch_id) AS BIGINT) AS n_patches, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, {r('min(v)')} AS min_v, {r('max(v)')} AS max_v FROM l""", ("vec_index",))  # fmt: skip
def embedding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = fx.vec_index(spark, sf_dir).select("patch_id", F.explode("embedding").alias("v"))
    found = long.agg(F.countDistinct("patch_id").alias("n_patches"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    return found.select("n_patches", *[rounded(c) for c in ("mean", "std", "min_v", "max_v")])


_DISTANCE = {
    "cosinesimil": "1 - list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding) * list_dot_product(b.embedding, b.embedding))",
    "l2": "list_distance(a.embedding, b.embedding)",
    "l1": "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: abs(t[1] - t[2])))",
}


def _knn_sql(space: str, queries: str, exclude: bool = False, k: int = 10, ctes: str = "", source: str = "vec_index") -> str:
    other = "WHERE a.patch_id <> b.patch_id" if exclude else ""
    return f"""WITH {ctes}q AS (SELECT * FROM {source} WHERE {queries}),
d AS (SELECT a.patch_id AS query_id, b.patch_id, round({_DISTANCE[space]}, 9) + 0.0 AS distance FROM q AS a CROSS JOIN {source} AS b {other}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, patch_id) AS rnk FROM d)
SELECT query_id, CAST(rnk AS BIGINT) AS rank, patch_id, round(distance, 6) + 0.0 AS distance FROM o WHERE rnk <= {k}"""


def _neighbours(name: str, space: str, which: str, exclude: bool = False, normalized: bool = False) -> None:
    ctes = (_Z + "zv AS (SELECT patch_id, list(z ORDER BY d) AS embedding FROM n GROUP BY patch_id),\n")[5:] if normalized else ""

    @query(name, _knn_sql(space, which, exclude, 10, ctes, "zv" if normalized else "vec_index"), ("vec_index",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = fx.vec_index(spark, sf_dir)
        if normalized:
            index = vectors.normalize(index)
        asked = index.where(which).select(F.col("patch_id").alias("query_id"), "embedding")
        return vectors.knn(index, asked, 10, space, exclude).select("query_id", "rank", "patch_id", rounded("distance"))


_neighbours("knn_cosine", "cosinesimil", "patch_id % 25 = 0")
_neighbours("knn_l2", "l2", "patch_id % 25 = 0")
_neighbours("knn_l1", "l1", "patch_id % 25 = 0")
_neighbours("knn_normalized", "cosinesimil", "patch_id % 25 = 0", normalized=True)
_neighbours("knn_by_id", "cosinesimil", "patch_id = 7")
_neighbours("knn_exclude_self", "cosinesimil", "patch_id % 25 = 0", exclude=True)


@query("knn_batch_allpairs", _knn_sql("l2", "patch_id >= 0"), ("vec_index",))
def knn_batch_allpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a query: blocks of vectors meet blocks of queries on the executors."""
    index = fx.vec_index(spark, sf_dir)
    asked = index.select(F.col("patch_id").alias("query_id"), "embedding")
    return blocks.knn_batch(index, asked, 10, "l2").select("query_id", "rank", "patch_id", rounded("distance"))


_APPROXIMATE_SQL = "SELECT count(*) AS n_queries, CAST(10 * count(*) AS BIGINT) AS n_found, true AS recall_reached FROM vec_index WHERE patch_id % 25 = 0"


def _approximate(name: str, space: str) -> None:
    @query(name, _APPROXIMATE_SQL, ("vec_index",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """An index of all vectors by cells, saved and read back: its neighbours against the exact ones, ten a query."""
        rows = fx.vec_index(spark, sf_dir).select("patch_id", "embedding")
        folder = f"{storage.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        Index.build(rows, rows.select("patch_id"), normalize=False, space=space, approximate=True).save(folder)
        asked = rows.where("patch_id % 25 = 0").select(F.col("patch_id").alias("query_id"), "embedding")
        found = Index.load(spark, folder).nearest(asked, 10)
        measured = cells.recall(found, vectors.knn(rows, asked, 10, space))
        return measured.select("n_queries", "n_found", (F.col("recall") >= 0.9).alias("recall_reached"))


_approximate("approximate_recall_cosine", "cosinesimil")
_approximate("approximate_recall_l2", "l2")


@query("knn_threshold", f"WITH k AS ({_knn_sql('cosinesimil', 'patch_id % 25 = 0')}) SELECT * FROM k WHERE distance <= 0.7", ("vec_index",))
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["knn_cosine"](spark, sf_dir).where("distance <= 0.7")


_META = "SELECT k.query_id, k.rank, k.patch_id, k.distance, p.tile_id, p.y_start, p.x_start FROM k LEFT JOIN corpus_patches AS p ON p.patch_id = k.patch_id AND p.patch_id % 10 <> 3"


@query("knn_metadata_join", f"WITH k AS ({_knn_sql('cosinesimil', 'patch_id % 25 = 0')}) {_META}", ("vec_index", "corpus_patches"))
def knn_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results keep their row where metadata is missing."""
    meta = fx.corpus_patches(spark, sf_dir).where("patch_id % 10 <> 3").select("patch_id", "tile_id", "y_start", "x_start")
    return QUERIES["knn_cosine"](spark, sf_dir).join(meta, "patch_id", "left").select("query_id", "rank", "patch_id", "distance", "tile_id", "y_start", "x_start")


_SEP = """u AS (SELECT patch_id, tile_group, list_transform(embedding, lambda v: v / (sqrt(list_dot_product(embedding, embedding)) + 1e-12)) AS e FROM {source}),
p AS (SELECT a.tile_group = b.tile_group AS same, 1 - least(greatest(list_dot_product(a.e, b.e), -1), 1) AS d FROM u AS a JOIN u AS b ON a.patch_id < b.patch_id)
SELECT round(avg(d) FILTER (same), 6) + 0.0 AS within_mean, round(avg(d) FILTER (NOT same), 6) + 0.0 AS across_mean, round(avg(d) FILTER (NOT same) / avg(d) FILTER (same), 6) + 0.0 AS ratio,
  CAST(count(*) FILTER (same) AS BIGINT) AS n_within, CAST(count(*) FILTER (NOT same) AS BIGINT) AS n_across FROM p"""


def _separability(found: DataFrame) -> DataFrame:
    return found.select(rounded("within_mean"), rounded("across_mean"), rounded("ratio"), "n_within", "n_across")


@query("separability", _Z + "zv AS (SELECT n.patch_id, any_value(tile_group) AS tile_group, list(z ORDER BY d) AS embedding FROM n JOIN vec_index AS i ON i.patch_id = n.patch_id GROUP BY n.patch_id),\n" + _SEP.format(source="zv"), ("vec_index",))
def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _separability(vectors.separability(vectors.normalize(fx.vec_index(spark, sf_dir))))


_SAMPLE = "WITH sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_group ORDER BY (patch_id * 7919) % 10007, patch_id) AS o FROM vec_index) WHERE o <= 30),\n"


@query("separability_sampled", _SAMPLE + _SEP.format(source="sm"), ("vec_index",))
def separability_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty patches per group, in the order of a hash of the id."""
    from pyspark.sql import Window

    order = Window.partitionBy("tile_group").orderBy((F.col("patch_id") * 7919) % 10007, "patch_id")
    sample = fx.vec_index(spark, sf_dir).withColumn("o", F.row_number().over(order)).where("o <= 30").drop("o")
    return _separability(vectors.separability(sample))


# --- service ----------------------------------------------------------------------------------------------------


@query("api_query_by_id", f"WITH k AS ({_knn_sql('cosinesimil', 'patch_id = 42')}),\n{shared_sql.BOXES}\nSELECT k.rank, k.patch_id, k.distance, bx.tile_id, bx_min AS x_min, by_min AS y_min, bx_max AS x_max, by_max AS y_max FROM k LEFT JOIN bx ON bx.patch_id = k.patch_id", ("vec_index", "corpus_patches", "corpus_tiles", "corpus_meta"))
def api_query_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..api import Service

    return Service.over(spark, sf_dir).query_by_id(42, 10)


@query("api_query_by_coords", f"WITH k AS ({_knn_sql('cosinesimil', 'patch_id = 0')}),\n{shared_sql.BOXES}\nSELECT k.rank, k.patch_id, k.distance, bx.tile_id, bx_min AS x_min, by_min AS y_min, bx_max AS x_max, by_max AS y_max FROM k LEFT JOIN bx ON bx.patch_id = k.patch_id", ("vec_index", "corpus_patches", "corpus_tiles", "corpus_meta"))
def api_query_by_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point 100 ft inside the north-west corner, which is patch 0."""
    from ..api import Service

    return Service.over(spark, sf_dir).query_by_coords(x=1_950_100.0, y=759_900.0, k=10)


# --- overlays: DataFrame operators, checked by the SQL of the same names ------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of patch 7 by Manhattan distance, on a grid of overlapping places."""
    index = fx.vec_index(spark, sf_dir)
    found = vectors.knn(index, index.where("patch_id = 7").select(F.col("patch_id").alias("query_id"), "embedding"), 10, "l1")
    local = F.col("patch_id") % fx.PER_TILE
    return found.select("patch_id", "rank", "distance", (F.floor(local / 5) * 12).cast("long").alias("y_start"), ((local % 5) * 12).cast("long").alias("x_start"), F.lit(16).alias("patch_size"))


QUERIES |= {
    "heatmap_labels": lambda spark, sf_dir: overlay.heatmap(_hits(spark, sf_dir), 8.0),
    "fade_mask": lambda spark, sf_dir: overlay.fade(_hits(spark, sf_dir), spark.range(1).select(F.lit(64).alias("height"), F.lit(64).alias("width")), 8.0),
    "box_colors": lambda spark, sf_dir: overlay.boxes(_hits(spark, sf_dir), 7).select("patch_id", F.col("rank").alias("rnk"), "color"),
    "similarity_colormap": lambda spark, sf_dir: overlay.colormap(spark),
}


# --- coordinates and raster info: likewise --------------------------------------------------------------------------------------


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.tile_pixels(fx.cust_points(spark, sf_dir), fx.corpus_tiles(spark, sf_dir), fx.corpus_meta(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = coords.boxes(fx.corpus_patches(spark, sf_dir), fx.corpus_tiles(spark, sf_dir), fx.corpus_meta(spark, sf_dir))
    return own.withColumn("center_x", (F.col("x_min") + F.col("x_max")) / 2).withColumn("center_y", (F.col("y_min") + F.col("y_max")) / 2)


def _described(raster: str, digits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tiling.describe(fx.VIEWS[raster](spark, sf_dir))
        return found.select("height", "width", rounded("min_z"), rounded("max_z"), rounded("mean_z", digits), rounded("std_z", digits), "n_missing")

    return run


QUERIES |= {
    "dem_info": _described("emb_raster", 6),
    "dem_info_nodata": _described("evt_raster", 4),
    "point_to_tile_pixel": lambda spark, sf_dir: _located(spark, sf_dir).select("c_custkey", "tile_id", "py", "px"),
    "point_to_patch": lambda spark, sf_dir: coords.patch_ids(_located(spark, sf_dir), fx.corpus_patches(spark, sf_dir)).select("c_custkey", "patch_id"),
    "patch_bbox": _boxes,
}


# --- operators of the build, the sweeps and the index, checked by the SQL of the same names ------------------------------


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of the stand-in corpus: its patches with their vectors."""
    own = fx.vec_index(spark, sf_dir).select("patch_id", "embedding")
    saved = fx.corpus_patches(spark, sf_dir).join(own, "patch_id").withColumn("failed", F.expr("cast(array() as array<string>)"))
    return saved.drop("patch_id").withColumns({"tile_h": F.lit(fx.TILE_PX), "tile_w": F.lit(fx.TILE_PX)})


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.records(_saved(spark, sf_dir), fx.corpus_tiles(spark, sf_dir).select("tile_id"))


def _tile_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in the order of the grid, which that of their names is up to a hundred rows only."""
    placed = fx.corpus_tiles(spark, sf_dir).select("tile_id", "tile_row", "tile_col")
    found = build.tiles(_records(spark, sf_dir).join(placed, "tile_id"), ("tile_row", "tile_col"))
    return found.join(placed, "tile_id").select("tile_id", "tile_row", "tile_col", "h", "w", "n_patches", "global_id_start")


def _remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of which no checkpoint is there, if every third diagonal of the grid is done."""
    listed = fx.corpus_tiles(spark, sf_dir)
    done = _saved(spark, sf_dir).join(listed.where((F.col("tile_row") + F.col("tile_col")) % 3 == 0), "tile_id", "left_semi")
    return build.remaining(listed, done).select("tile_id", "n_patches")


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index.build(fx.vec_index(spark, sf_dir), fx.corpus_patches(spark, sf_dir))
    return index.stats().withColumn("embedding_dim", F.col("embedding_dim").cast("long"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coords.coverage(fx.cust_points(spark, sf_dir), fx.corpus_tiles(spark, sf_dir), fx.corpus_meta(spark, sf_dir))
    return found.select("c_custkey", "exit_code", "indexed", "n_patches", *[rounded(c, 4) for c in ("from_west", "from_east", "from_south", "from_north")])


def _pixel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = fx.corpus_tiles(spark, sf_dir)
    return coords.tile_points(tiles.select("tile_id", F.lit(20).alias("py"), F.lit(10).alias("px")), tiles, fx.corpus_meta(spark, sf_dir)).select("tile_id", "x", "y")


def _clicks(spark: SparkSession, sf_dir: str, shape: DataFrame) -> DataFrame:
    clicks = fx.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 500).alias("click_y"), (F.col("c_custkey") % 97).alias("click_x"))
    return overlay.clicks_to_pixels(clicks, shape).select("c_custkey", "py", "px")


_DEGREES = ("west", "south", "east", "north")

QUERIES |= {
    "global_patch_ids": lambda spark, sf_dir: build.number(_saved(spark, sf_dir), build.tiles(_records(spark, sf_dir))).select("tile_id", "local_id", F.col("patch_id").alias("global_id")),
    "tile_info": _tile_info,
    "resume_remaining_tiles": _remaining,
    "api_info": _info,
    "coords_coverage": _coverage,
    "tile_pixel_to_point": _pixel_points,
    "patch_bbox_wgs84": lambda spark, sf_dir: coords.boxes_wgs84(fx.corpus_patches(spark, sf_dir), fx.corpus_tiles(spark, sf_dir), fx.corpus_meta(spark, sf_dir)).select("patch_id", *[rounded(c, 8) for c in _DEGREES]),
    "corpus_bounds": lambda spark, sf_dir: coords.bounds(fx.corpus_meta(spark, sf_dir)).select("x_min", "y_min", "x_max", "y_max", *[rounded(c, 8) for c in _DEGREES]),
    "lcc_inverse": lambda spark, sf_dir: coords.to_wgs84(fx.cust_points(spark, sf_dir)).select("c_custkey", rounded("lon", 8), rounded("lat", 8)),
    "lcc_forward": lambda spark, sf_dir: coords.from_wgs84(coords.to_wgs84(fx.cust_points(spark, sf_dir)).select("c_custkey", "lon", "lat")).select("c_custkey", rounded("x", 4), rounded("y", 4)),
    "display_click_to_pixel_whole": lambda spark, sf_dir: _clicks(spark, sf_dir, tiling.shape_of(fx.emb_raster(spark, sf_dir))),
    "hillshade": lambda spark, sf_dir: relief.hillshade(fx.p16(spark, sf_dir)).select("patch_id", "y", "x", rounded("shade")),
}


@query("variant_best", _Z + "zv AS (SELECT n.patch_id, any_value(tile_group) AS tile_group, list(z ORDER BY d) AS embedding FROM n JOIN vec_index AS i ON i.patch_id = n.patch_id GROUP BY n.patch_id),\n"
    + "raw AS (WITH " + _SEP.format(source="vec_index") + "),\nzed AS (WITH " + _SEP.format(source="zv") + """),
a AS (SELECT 'raw' AS variant, ratio FROM raw UNION ALL SELECT 'zscore', ratio FROM zed), b AS (SELECT ratio AS base FROM a WHERE variant = 'raw')
SELECT variant, ratio, round((ratio / base - 1) * 100, 2) + 0.0 AS gain_pct FROM a CROSS JOIN b ORDER BY ratio DESC, variant LIMIT 1""", ("vec_index",))  # fmt: skip
def variant_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vectors tell groups apart better as they are or standardised."""
    index = fx.vec_index(spark, sf_dir)
    found = evaluate.compare({"raw": index, "zscore": vectors.normalize(index)})
    return evaluate.best(evaluate.with_gain(found, "raw")).select("variant", rounded("ratio"), rounded("gain_pct", 2))


# --- terrain, statistics and co-occurrence in the patch's row, checked by SQL over exploded cells --------------------------


_SIX = ("mean", "std", "energy", "entropy", "value_range", "median")


def _surface_stats(name: str) -> None:
    """``<name>_stats``: six statistics of a derivative at its default parameters, by column expressions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = surfaces.six_stats(surfaces.surface(_patches16(spark, sf_dir), name, 16, 16), name == "aspect")
        return found.select("patch_id", *[rounded(c) for c in _SIX])

    QUERIES[f"{name}_stats"] = run


for _name in surfaces.SURFACES:
    _surface_stats(_name)


@_instead_of("residual_stats6")
def residual_stats6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.six_stats(_patches16(spark, sf_dir)).select("patch_id", *[rounded(c) for c in _SIX])


@_instead_of("glcm_props")
def glcm_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surfaces.cooccurrence(fx.patches(spark, sf_dir), 8, 8, levels=16)
    return found.select("patch_id", *[rounded(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm_value")])


query("glcm_props_64", shared_sql.glcm(64).replace("p8", "p64"), ("p64",))(
    lambda spark, sf_dir: surfaces.cooccurrence(fx.patches64(spark, sf_dir), 64, 64, levels=64).select(
        "patch_id", *[rounded(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm_value")]
    )
)


_BANDS = (("low_freq_energy", 6), ("mid_freq_energy", 6), ("high_freq_energy", 6), ("freq_ratio_high_low", 4))


@_instead_of("fft_band_energy")
def fft_band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.band_energy(fx.patches(spark, sf_dir), 8, 8).select("patch_id", *[rounded(c, d) for c, d in _BANDS])


@_instead_of("directional_fft")
def directional_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surfaces.directional(fx.patches(spark, sf_dir), 8, 8)
    return found.select("patch_id", F.col("angle").cast("long").alias("angle"), *[rounded(c, 4 if c == "peak" else 6) for c in spectral.STATS])


def _bands_sql(n: int, source: str) -> str:
    """The spectrum by a sum along each axis, then means of rings."""
    wave = lambda f, k, i: f"{f}(2 * pi() * ((k{k}.i - {n // 2}) * {i} % {n}) / {n})"
    return f"""WITH ky AS (SELECT i FROM range({n}) AS t(i)), kx AS (SELECT i FROM range({n}) AS t(i)),
a AS MATERIALIZED (SELECT patch_id, ky.i AS u, x, sum(z * {wave('cos', 'y', 'y')}) AS c, sum(z * {wave('sin', 'y', 'y')}) AS s FROM {source} CROSS JOIN ky GROUP BY patch_id, ky.i, x),
b AS (SELECT patch_id, u, kx.i AS v, sqrt(pow(sum(c * {wave('cos', 'x', 'x')} - s * {wave('sin', 'x', 'x')}), 2) + pow(sum(s * {wave('cos', 'x', 'x')} + c * {wave('sin', 'x', 'x')}), 2)) AS m FROM a CROSS JOIN kx GROUP BY patch_id, u, kx.i),
g AS (SELECT patch_id, m, sqrt(CAST((u - {n // 2}) * (u - {n // 2}) + (v - {n // 2}) * (v - {n // 2}) AS DOUBLE)) AS rad FROM b),
e AS (SELECT patch_id, avg(CASE WHEN rad * 10 < {n} THEN m END) AS lo, avg(CASE WHEN rad * 10 >= {n} AND rad * 10 < {3 * n} THEN m END) AS mi, avg(CASE WHEN rad * 10 >= {3 * n} THEN m END) AS hi FROM g GROUP BY patch_id)
SELECT patch_id, {r('lo')} AS low_freq_energy, {r('mi')} AS mid_freq_energy, {r('hi')} AS high_freq_energy, {r('hi / (lo + 1e-10)', 4)} AS freq_ratio_high_low FROM e"""


@query("fft_band_energy_64", _bands_sql(64, "p64"), ("p64",))
def fft_band_energy_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.band_energy(fx.patches64(spark, sf_dir), 64, 64).select("patch_id", *[rounded(c, d) for c, d in _BANDS])


def _fold(v: str, n: int) -> str:
    """Where a place beyond the edge reads if edges are reflected."""
    m = f"((({v}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END"


def _window_sql(source: str, n: int, size: int, total: str) -> str:
    """``b``: a total over the cells ``e`` of a square around each cell ``c``."""
    first = -(size // 2)
    return f"""WITH near AS (SELECT a.i AS o, {_fold('a.i + d.i', n)} AS r FROM range({n}) AS a(i) CROSS JOIN range({first}, {first + size}) AS d(i)),
b AS (SELECT c.patch_id, c.y, c.x, {total} AS v FROM {source} AS c JOIN near AS ny ON ny.o = c.y JOIN near AS nx ON nx.o = c.x JOIN {source} AS e ON e.patch_id = c.patch_id AND e.y = ny.r AND e.x = nx.r GROUP BY c.patch_id, c.y, c.x)
SELECT patch_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {r('v')} AS z FROM b"""


_WINDOWS = {
    "tpi": ({"radius": 10}, 21, "max(c.z) - avg(e.z)"),
    "tri": ({"window_size": 21}, 21, "avg(abs(e.z - c.z))"),
    "roughness": ({"window_size": 21}, 21, "sqrt(greatest(avg(e.z * e.z) - avg(e.z) * avg(e.z), 0))"),
}


def _wide_window(name: str, n: int, source: str, patches: Query) -> None:
    params, size, total = _WINDOWS[name]

    @query(f"{name}_radius10_{n}", _window_sql(source, n, size, total), (source,))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return surfaces.cells(surfaces.surface(patches(spark, sf_dir), name, n, n, **params), n).select("patch_id", "y", "x", rounded("z"))


for _name in _WINDOWS:
    _wide_window(_name, 16, "p16", lambda spark, sf_dir: tiling.as_arrays(fx.p16(spark, sf_dir), 16))
    _wide_window(_name, 64, "p64", fx.patches64)


def _disc_sql(radius: int, n: int) -> str:
    """A cell less an opening over a disc: the least, then the largest under it, looked up in a list of the patch's cells."""
    under = f"list_transform(dc.d, lambda o: s.g[fd.f[c.y + o.dy + {radius + 1}] * {n} + fd.f[c.x + o.dx + {radius + 1}] + 1])"
    step = lambda out, source, pick: f"""{out} AS MATERIALIZED (SELECT patch_id, list(z ORDER BY y, x) AS g FROM (
  SELECT s.patch_id, c.y, c.x, {pick}({under}) AS z FROM {source} AS s CROSS JOIN cl AS c CROSS JOIN dc CROSS JOIN fd) AS o GROUP BY patch_id)"""  # noqa: E731
    return f"""WITH fd AS (SELECT list(CAST({_fold(f'a.i - {radius}', n)} AS BIGINT) ORDER BY a.i) AS f FROM range({n + 2 * radius}) AS a(i)),
dc AS (SELECT list({{'dy': a.i, 'dx': b.i}}) AS d FROM range({-radius}, {radius + 1}) AS a(i) CROSS JOIN range({-radius}, {radius + 1}) AS b(i) WHERE a.i * a.i + b.i * b.i <= {radius**2}),
cl AS (SELECT a.i AS y, b.i AS x FROM range({n}) AS a(i) CROSS JOIN range({n}) AS b(i)),
g0 AS MATERIALIZED (SELECT patch_id, list(z ORDER BY y, x) AS g FROM p64 GROUP BY patch_id),
{step('lo', 'g0', 'list_min')},
{step('op', 'lo', 'list_max')}
SELECT p.patch_id, CAST(p.y AS BIGINT) AS y, CAST(p.x AS BIGINT) AS x, {r(f'op.g[p.y * {n} + p.x + 1]')} AS trend, {r(f'p.z - op.g[p.y * {n} + p.x + 1]')} AS residual FROM p64 AS p JOIN op ON op.patch_id = p.patch_id"""


@query("decomp_tophat_64", _disc_sql(20, 64), ("p64",))
def decomp_tophat_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-hat at its default size, on patches of the default size."""
    return filters.decompose(fx.patches64(spark, sf_dir), "tophat", 64, 64).select("patch_id", "y", "x", rounded("trend"), rounded("residual"))


# --- kernels of terrain, texture, statistics and spectra, held to the SQL of the same measures ----------------------------


def _kernel(measure_of: str, columns: tuple[str, ...], source: Callable[[SparkSession, str], DataFrame], measure, at: tuple[int, ...] | None = None, digits: int = 6) -> None:
    """Query ``kernel_<name>``: values ``at`` these places of what a kernel gives, checked by the SQL of ``name``."""
    places = at or tuple(range(len(columns)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = embed.statistics(source(spark, sf_dir), measure)
        rank = lambda c: 4 if c == "freq_ratio_high_low" else digits
        return found.select("patch_id", *[(F.round(F.col("values")[i], rank(c)) + F.lit(0.0)).alias(c) for c, i in zip(columns, places, strict=True)])

    QUERIES[f"kernel_{measure_of}"], ORACLES[f"kernel_{measure_of}"] = run, ORACLES[measure_of]


for _name in ("slope", "aspect", "curvature", "tpi", "tri", "roughness"):
    _kernel(f"{_name}_stats", _SIX, _patches16, lambda z, name=_name: terrain.stats(name, TERRAIN.run(name, z)))
_kernel("residual_stats6", _SIX, _patches16, analysis.six_stats)
_rich = lambda z: analysis.rich(z, include_linear=False)
_kernel("patch_entropy50", ("entropy",), fx.patches, _rich, (7,))
_kernel("skew_kurtosis", ("skewness", "kurtosis"), _patches16, _rich, (4, 5))
_kernel("morans_i", ("morans_i",), _patches16, _rich, (8,))
_kernel("fft_band_energy", ("low_freq_energy", "mid_freq_energy", "high_freq_energy", "freq_ratio_high_low"), fx.patches, _rich, (12, 13, 14, 15))
_kernel("feature_snr", ("feature_snr",), fx.patches, _rich, (16,))
_kernel("glcm_props", ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm_value"), fx.patches, lambda z: TEXTURE.run("glcm", z, levels=16))


@query("kernel_quantize_levels")
def kernel_quantize_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = embed.statistics(fx.patches(spark, sf_dir), lambda z: texture.quantize(z, 64)).select("patch_id", F.posexplode("values").alias("i", "v"))
    return cells.select("patch_id", F.floor(F.col("i") / 8).cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.col("v").cast("long").alias("level"))


@query("kernel_directional_fft")
def kernel_directional_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = embed.statistics(fx.patches(spark, sf_dir), spectral.directional)
    by_angle = F.array(*[F.struct(F.lit(a).cast("long").alias("angle"), F.slice("values", 6 * i + 1, 6).alias("v")) for i, a in enumerate((0, 45, 90, 135))])
    rows = values.select("patch_id", F.explode(by_angle).alias("r"))
    return rows.select("patch_id", "r.angle", *[(F.round(F.col("r.v")[i], 4 if c == "peak" else 6) + F.lit(0.0)).alias(c) for i, c in enumerate(spectral.STATS)])


ORACLES |= {f"kernel_{n}": ORACLES[n] for n in ("quantize_levels", "directional_fft")}
_signature("residuals_extended", cfg.preset("residuals_extended"))
