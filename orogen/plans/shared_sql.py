"""Queries that are one SQL text for both engines, over the views of ``sources.fixtures`` and the driver's tables.

Ids, ranks and counts are cast to BIGINT and numbers rounded to six places, so that the engines agree in type and in
the last digits; ``+ 0.0`` turns a negative zero into zero.
"""

from __future__ import annotations

import math

from ..functions.spectral import slice_cells



def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


#: Entropy of a histogram of 50 bins between least and largest value, by group.
def entropy(cells: str, key: str = "patch_id") -> str:
    return f"""
ent_b AS (SELECT {key}, min(z) AS mn, max(z) AS mx, CAST(count(*) AS DOUBLE) AS n FROM {cells} GROUP BY {key}),
ent_h AS (SELECT {key}, b, CAST(count(*) AS DOUBLE) AS c FROM (
  SELECT c.{key}, CASE WHEN b.mx = b.mn THEN 25 ELSE CAST(least(floor((c.z - b.mn) * (50 / (b.mx - b.mn))), 49) AS BIGINT) END AS b
  FROM {cells} AS c JOIN ent_b AS b ON c.{key} = b.{key}) AS x GROUP BY {key}, b),
ent_d AS (SELECT b.{key}, coalesce(h.c, 0) / (b.n * CASE WHEN b.mx = b.mn THEN 0.02 ELSE (b.mx - b.mn) / 50 END) + 1e-10 AS d
  FROM ent_b AS b CROSS JOIN (SELECT i FROM nums WHERE i < 50) AS k LEFT JOIN ent_h AS h ON h.{key} = b.{key} AND h.b = k.i),
ent_t AS (SELECT {key}, sum(d) AS t FROM ent_d GROUP BY {key}),
ent AS (SELECT d.{key}, -sum(d.d / t.t * ln(d.d / t.t)) AS entropy FROM ent_d AS d JOIN ent_t AS t ON d.{key} = t.{key} GROUP BY d.{key})"""


def grid_stats(grid: str, having: str = "") -> str:
    """Six statistics per patch of the cells of CTE ``g(patch_id, y, x, z)``, made by the CTEs ``grid``."""
    return f"""WITH {grid}, {entropy('g')}
SELECT g.patch_id, {r('avg(z)')} AS mean, {r('stddev_pop(z)')} AS std, {r('avg(z * z)')} AS energy, {r('max(entropy)')} AS entropy,
  {r('max(z) - min(z)')} AS value_range, {r('median(z)')} AS median
FROM g JOIN ent ON g.patch_id = ent.patch_id GROUP BY g.patch_id"""


BY_Y, BY_X = "PARTITION BY patch_id, x ORDER BY y", "PARTITION BY patch_id, y ORDER BY x"


def gradient(z: str, window: str) -> str:
    return f"""CASE WHEN lag({z}) OVER ({window}) IS NULL THEN lead({z}) OVER ({window}) - {z}
    WHEN lead({z}) OVER ({window}) IS NULL THEN {z} - lag({z}) OVER ({window})
    ELSE (lead({z}) OVER ({window}) - lag({z}) OVER ({window})) / 2 END"""


SLOPES = f"s AS (SELECT patch_id, y, x, z, {gradient('z', BY_Y)} AS dy, {gradient('z', BY_X)} AS dx FROM p16)"
#: Three by three neighbourhood: columns l, c, r of the cell above, its own and the one below, edges repeated.
AROUND = f"""n1 AS (SELECT patch_id, y, x, z AS c, coalesce(lag(z) OVER ({BY_X}), z) AS l, coalesce(lead(z) OVER ({BY_X}), z) AS e FROM p16),
n9 AS (SELECT patch_id, y, x, c, l, e, coalesce(lag(c) OVER ({BY_Y}), c) AS tc, coalesce(lag(l) OVER ({BY_Y}), l) AS tl, coalesce(lag(e) OVER ({BY_Y}), e) AS te,
  coalesce(lead(c) OVER ({BY_Y}), c) AS bc, coalesce(lead(l) OVER ({BY_Y}), l) AS bl, coalesce(lead(e) OVER ({BY_Y}), e) AS be FROM n1)"""
CELLS9 = ["c", "l", "e", "tc", "tl", "te", "bc", "bl", "be"]

E2 = "0.006694380022903416"  # GRS80, eccentricity squared
FT = "(1200 / CAST(3937 AS DOUBLE))"
_E = f"sqrt(CAST({E2} AS DOUBLE))"


def _m(phi: str) -> str:
    return f"(cos({phi}) / sqrt(1 - {_E} * {_E} * pow(sin({phi}), 2)))"


def _t(phi: str) -> str:
    return f"(tan(pi() / 4 - ({phi}) / 2) / pow((1 - {_E} * sin({phi})) / (1 + {_E} * sin({phi})), {_E} / 2))"


#: Fixed: Lambert conic of EPSG:3735 (parallels, origin, false easting in metres), one row.
LCC = f"""k0 AS (SELECT radians(CAST(40 AS DOUBLE) + CAST(2 AS DOUBLE) / 60) AS p1, radians(CAST(38 AS DOUBLE) + CAST(44 AS DOUBLE) / 60) AS p2, radians(CAST(38 AS DOUBLE)) AS p0, radians(CAST(-825 AS DOUBLE) / 10) AS l0),
k1 AS (SELECT l0, (ln({_m('p1')}) - ln({_m('p2')})) / (ln({_t('p1')}) - ln({_t('p2')})) AS n, {_m('p1')} AS m1, {_t('p1')} AS t1, {_t('p0')} AS t0 FROM k0),
lcc AS (SELECT l0, n, m1 / (n * pow(t1, n)) * 6378137 AS af, m1 / (n * pow(t1, n)) * 6378137 * pow(t0, n) AS rho0 FROM k1)"""


def inverse(points: str, x: str, y: str, keep: str) -> str:
    """CTE ``inv`` with ``lon, lat`` (degrees) of state-plane feet, five steps of the latitude series unrolled."""
    steps = ",\n".join(
        f"i{k} AS (SELECT i{k - 1}.*, pi() / 2 - 2 * atan(t * pow((1 - {_E} * sin(phi{k - 1})) / (1 + {_E} * sin(phi{k - 1})), {_E} / 2)) AS phi{k} FROM i{k - 1})" for k in range(1, 6)
    )
    return f"""ia AS (SELECT {keep}, ({x}) * {FT} - 600000 AS dx, rho0 - ({y}) * {FT} AS dy, n, af, l0 FROM {points} CROSS JOIN lcc),
ib AS (SELECT ia.*, pow(sqrt(dx * dx + dy * dy) / af, 1 / n) AS t FROM ia),
i0 AS (SELECT ib.*, pi() / 2 - 2 * atan(t) AS phi0 FROM ib),
{steps},
inv AS (SELECT {keep}, degrees(atan2(dx, dy) / n + l0) AS lon, degrees(phi5) AS lat FROM i5)"""


def forward(points: str, keep: str) -> str:
    """CTE ``fwd`` with ``fx, fy`` (feet) of ``lon, lat``."""
    return f"""fa AS (SELECT {keep}, af * pow({_t('radians(lat)')}, n) AS rho, n * (radians(lon) - l0) AS th, rho0 FROM {points} CROSS JOIN lcc),
fwd AS (SELECT {keep}, (rho * sin(th) + 600000) / {FT} AS fx, (rho0 - rho * cos(th)) / {FT} AS fy FROM fa)"""


INSIDE = "x >= x_min AND x < x_max AND y > y_min AND y <= y_max"
PIXELS = f"""tp0 AS (SELECT c_custkey, x, y, CASE WHEN {INSIDE} THEN CAST(least(floor((x - x_min) / tile_size_ft), grid_cols - 1) AS BIGINT) END AS tc,
  CASE WHEN {INSIDE} THEN CAST(least(floor((y_max - y) / tile_size_ft), grid_rows - 1) AS BIGINT) END AS tr, x_min, y_max, tile_size_ft, resolution_ft FROM cust_points CROSS JOIN corpus_meta),
tp AS (SELECT c_custkey, x, y, t.tile_id,
  CASE WHEN t.tile_id IS NOT NULL THEN CAST(least(floor((y_max - tr * tile_size_ft - y) / resolution_ft), t.h - 1) AS BIGINT) END AS py,
  CASE WHEN t.tile_id IS NOT NULL THEN CAST(least(floor((x - x_min - tc * tile_size_ft) / resolution_ft), t.w - 1) AS BIGINT) END AS px
  FROM tp0 LEFT JOIN corpus_tiles AS t ON t.tile_row = tp0.tr AND t.tile_col = tp0.tc)"""
BOXES = """bx AS (SELECT p.patch_id, p.tile_id, x_min + t.tile_col * tile_size_ft + p.x_start * resolution_ft AS bx_min, x_min + t.tile_col * tile_size_ft + (p.x_start + p.patch_size) * resolution_ft AS bx_max,
  y_max - t.tile_row * tile_size_ft - (p.y_start + p.patch_size) * resolution_ft AS by_min, y_max - t.tile_row * tile_size_ft - p.y_start * resolution_ft AS by_max
  FROM corpus_patches AS p JOIN corpus_tiles AS t ON p.tile_id = t.tile_id CROSS JOIN corpus_meta)"""
#: Results of a search: the ten nearest of query 7, by Manhattan distance of its 8 by 8 patch's cells.
HITS = """ds AS (SELECT b.patch_id, sum(abs(a.z - b.z)) AS distance FROM p8 AS a JOIN p8 AS b ON a.y = b.y AND a.x = b.x WHERE a.patch_id = 7 GROUP BY b.patch_id),
hits AS (SELECT patch_id, distance, rnk FROM (SELECT patch_id, round(distance, 9) AS distance, CAST(row_number() OVER (ORDER BY round(distance, 9), patch_id) AS BIGINT) AS rnk FROM ds) AS o WHERE rnk <= 10)"""
PLACED = """placed AS (SELECT h.patch_id, h.distance, h.rnk, CAST(floor((h.patch_id % 25) / 5) * 12 AS BIGINT) AS y0, CAST((h.patch_id % 5) * 12 AS BIGINT) AS x0 FROM hits AS h)"""


def glcm(levels: int = 16) -> str:
    turns = [(d, a, round(math.sin(math.radians(a)) * d), round(math.cos(math.radians(a)) * d)) for d in (1, 2, 4) for a in (0, 45, 90, 135)]
    offsets = " UNION ALL ".join(f"SELECT CAST({dy} AS BIGINT) AS oy, CAST({dx} AS BIGINT) AS ox, {1000 * d + a} AS combo" for d, a, dy, dx in turns)
    return f"""WITH b AS (SELECT patch_id, min(z) AS mn, max(z) AS mx FROM p8 GROUP BY patch_id),
q AS (SELECT p.patch_id, p.y, p.x, CAST(CASE WHEN b.mx - b.mn < 1e-10 THEN 0 ELSE floor((p.z - b.mn) / (b.mx - b.mn) * {levels - 1}) END AS BIGINT) AS v FROM p8 AS p JOIN b ON p.patch_id = b.patch_id),
o AS ({offsets}),
pr AS (SELECT a.patch_id, o.combo, a.v AS i, c.v AS j FROM q AS a CROSS JOIN o JOIN q AS c ON c.patch_id = a.patch_id AND c.y = a.y + o.oy AND c.x = a.x + o.ox),
sy AS (SELECT patch_id, combo, i, j FROM pr UNION ALL SELECT patch_id, combo, j, i FROM pr),
ct AS (SELECT patch_id, combo, i, j, CAST(count(*) AS DOUBLE) AS c FROM sy GROUP BY patch_id, combo, i, j),
tt AS (SELECT patch_id, combo, sum(c) AS t, sum(c * i) / sum(c) AS mi FROM ct GROUP BY patch_id, combo),
pp AS (SELECT ct.patch_id, ct.combo, i, j, c / t AS p, mi FROM ct JOIN tt ON ct.patch_id = tt.patch_id AND ct.combo = tt.combo),
pc AS (SELECT patch_id, combo, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm_value,
  sum(p * (i - mi) * (i - mi)) AS var, sum(p * (i - mi) * (j - mi)) AS cov FROM pp GROUP BY patch_id, combo)
SELECT patch_id, {r('avg(contrast)')} AS contrast, {r('avg(dissimilarity)')} AS dissimilarity, {r('avg(homogeneity)')} AS homogeneity, {r('avg(sqrt(asm_value))')} AS energy,
  {r('avg(CASE WHEN var < 1e-15 THEN 1 ELSE cov / var END)')} AS correlation, {r('avg(asm_value)')} AS asm_value FROM pc GROUP BY patch_id"""


def spectrum(window: str) -> str:
    """CTE ``mag(patch_id, ky, kx, m)``: centred magnitude of the 8 by 8 spectrum."""
    return f"""f AS (SELECT i FROM nums WHERE i < 8),
mag AS (SELECT p.patch_id, (u.i + 4) % 8 AS ky, (v.i + 4) % 8 AS kx, sqrt(pow(sum(p.z * {window} * cos(2 * pi() * (u.i * p.y + v.i * p.x) / 8)), 2) + pow(sum(p.z * {window} * sin(2 * pi() * (u.i * p.y + v.i * p.x) / 8)), 2)) AS m
  FROM p8 AS p CROSS JOIN f AS u CROSS JOIN f AS v GROUP BY p.patch_id, u.i, v.i)"""


HANN = "(CAST(5 AS DOUBLE) / 10 - CAST(5 AS DOUBLE) / 10 * cos(2 * pi() * p.y / 7)) * (CAST(5 AS DOUBLE) / 10 - CAST(5 AS DOUBLE) / 10 * cos(2 * pi() * p.x / 7))"


def directional() -> str:
    cells = [(a, i, int(y), int(x)) for a in (0, 45, 90, 135) for i, (y, x) in enumerate(zip(*slice_cells(8, 8, a), strict=True))]
    rows = " UNION ALL ".join(f"SELECT {a} AS angle, {i} AS i, {y} AS ky, {x} AS kx" for a, i, y, x in cells)
    return f"""WITH {spectrum(HANN)}, line AS ({rows}),
v AS (SELECT mag.patch_id, line.angle, line.i, mag.m, row_number() OVER (PARTITION BY mag.patch_id, line.angle ORDER BY round(mag.m, 9) DESC, line.i) AS top FROM mag JOIN line ON mag.ky = line.ky AND mag.kx = line.kx),
c AS (SELECT patch_id, angle, sum(m * m) AS e, sum(CASE WHEN i < 1 THEN m ELSE 0 END) AS lo, sum(CASE WHEN i >= 2 THEN m ELSE 0 END) AS hi, max(CASE WHEN top = 1 THEN i END) AS pk, sum(i * m * m) / sum(m * m) AS ce FROM v GROUP BY patch_id, angle)
SELECT c.patch_id, CAST(c.angle AS BIGINT) AS angle, {r('max(ln(1 + e))')} AS energy, {r('max(lo)')} AS low, {r('max(hi)')} AS high, {r('max(pk / CAST(3 AS DOUBLE))', 4)} AS peak, {r('max(ce / 3)')} AS centroid,
  {r('sqrt(sum((v.i - ce) * (v.i - ce) * v.m * v.m) / max(e)) / 3')} AS spread FROM c JOIN v ON c.patch_id = v.patch_id AND c.angle = v.angle GROUP BY c.patch_id, c.angle"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


QUERIES: dict[str, str] = {
    "dem_info": f"SELECT CAST(max(y) + 1 AS BIGINT) AS height, CAST(max(x) + 1 AS BIGINT) AS width, {r('min(z)')} AS min_z, {r('max(z)')} AS max_z, {r('avg(z)')} AS mean_z, {r('stddev_pop(z)')} AS std_z, CAST(count(*) - count(z) AS BIGINT) AS n_missing FROM emb_raster",
    "dem_info_nodata": f"SELECT CAST(max(y) + 1 AS BIGINT) AS height, CAST(max(x) + 1 AS BIGINT) AS width, {r('min(z)')} AS min_z, {r('max(z)')} AS max_z, {r('avg(z)', 4)} AS mean_z, {r('stddev_pop(z)', 4)} AS std_z, CAST(count(*) - count(z) AS BIGINT) AS n_missing FROM evt_raster",
    "residual_stats6": grid_stats("g AS (SELECT patch_id, y, x, z FROM p16)"),
    "patch_entropy50": _with(entropy("p8").strip(), f"SELECT patch_id, {r('entropy')} AS entropy FROM ent"),
    "skew_kurtosis": f"""WITH a AS (SELECT patch_id, avg(z) AS m FROM p16 GROUP BY patch_id),
c AS (SELECT p.patch_id, avg(pow(p.z - m, 2)) AS m2, avg(pow(p.z - m, 3)) AS m3, avg(pow(p.z - m, 4)) AS m4 FROM p16 AS p JOIN a ON p.patch_id = a.patch_id GROUP BY p.patch_id)
SELECT patch_id, {r('m3 / pow(m2, CAST(15 AS DOUBLE) / 10)')} AS skewness, {r('m4 / (m2 * m2) - 3')} AS kurtosis FROM c""",
    "morans_i": f"""WITH {AROUND}, q AS (SELECT patch_id, c, (tc + bc + l + e) / 4 AS lag4 FROM n9),
a AS (SELECT patch_id, avg(c) AS mc, avg(lag4) AS ml FROM q GROUP BY patch_id)
SELECT q.patch_id, {r('sum((c - mc) * (lag4 - ml)) / sum((c - mc) * (c - mc))')} AS morans_i FROM q JOIN a ON q.patch_id = a.patch_id GROUP BY q.patch_id""",
    "slope_stats": grid_stats(f"{SLOPES}, g AS (SELECT patch_id, y, x, degrees(atan(sqrt(dx * dx + dy * dy))) AS z FROM s)"),
    "aspect_stats": grid_stats(f"{SLOPES}, g AS (SELECT patch_id, y, x, (degrees(atan2(-dx, dy)) + 360) % 360 AS z FROM s WHERE NOT (abs(dx) < 1e-8 AND abs(dy) < 1e-8))"),
    "curvature_stats": grid_stats(f"{SLOPES}, g AS (SELECT patch_id, y, x, -({gradient('dy', BY_Y)} + {gradient('dx', BY_X)}) AS z FROM s)"),
    "tri_stats": grid_stats(f"{AROUND}, g AS (SELECT patch_id, y, x, ({' + '.join(f'abs({v} - c)' for v in CELLS9)}) / 9 AS z FROM n9)"),
    "roughness_stats": grid_stats(f"{AROUND}, g AS (SELECT patch_id, y, x, sqrt(greatest(({' + '.join(f'{v} * {v}' for v in CELLS9)}) / 9 - pow(({' + '.join(CELLS9)}) / 9, 2), 0)) AS z FROM n9)"),
    "tpi_stats": grid_stats("""ix AS (SELECT a.i AS i, CASE WHEN (a.i + d.i - 10 + 32) % 32 < 16 THEN (a.i + d.i - 10 + 32) % 32 ELSE 31 - (a.i + d.i - 10 + 32) % 32 END AS j
  FROM nums AS a CROSS JOIN nums AS d WHERE a.i < 16 AND d.i < 21),
w AS (SELECT i, j, count(*) AS w FROM ix GROUP BY i, j),
rw AS (SELECT p.patch_id, w.i AS y, p.x, sum(p.z * w.w) / 21 AS z FROM p16 AS p JOIN w ON p.y = w.j GROUP BY p.patch_id, w.i, p.x),
bx AS (SELECT rw.patch_id, rw.y, w.i AS x, sum(rw.z * w.w) / 21 AS m FROM rw JOIN w ON rw.x = w.j GROUP BY rw.patch_id, rw.y, w.i),
g AS (SELECT p.patch_id, p.y, p.x, p.z - bx.m AS z FROM p16 AS p JOIN bx ON p.patch_id = bx.patch_id AND p.y = bx.y AND p.x = bx.x)"""),
    "hillshade": f"""WITH {SLOPES}, l AS (SELECT patch_id, y, x, (-dx * cos(radians(-225)) * cos(radians(45)) + dy * sin(radians(-225)) * cos(radians(45)) + sin(radians(45))) / sqrt(dx * dx + dy * dy + 1) AS v FROM s),
m AS (SELECT patch_id, min(v) AS mn, max(v) AS mx FROM l GROUP BY patch_id)
SELECT l.patch_id, y, x, {r('CASE WHEN mx - mn > 1e-6 THEN (v - mn) / (mx - mn) ELSE least(greatest(v, 0), 1) END')} AS shade FROM l JOIN m ON l.patch_id = m.patch_id""",
    "quantize_levels": """WITH b AS (SELECT patch_id, min(z) AS mn, max(z) AS mx FROM p8 GROUP BY patch_id)
SELECT p.patch_id, p.y, p.x, CAST(CASE WHEN mx - mn < 1e-10 THEN 0 ELSE floor((z - mn) / (mx - mn) * 63) END AS BIGINT) AS level FROM p8 AS p JOIN b ON p.patch_id = b.patch_id""",
    "glcm_props": glcm(),
    "fft_band_energy": f"""WITH {spectrum('1')}, g AS (SELECT patch_id, m, sqrt(CAST((ky - 4) * (ky - 4) + (kx - 4) * (kx - 4) AS DOUBLE)) AS rad FROM mag),
s AS (SELECT patch_id, avg(CASE WHEN rad * 10 < 8 THEN m END) AS lo, avg(CASE WHEN rad * 10 >= 8 AND rad * 10 < 24 THEN m END) AS mi, avg(CASE WHEN rad * 10 >= 24 THEN m END) AS hi FROM g GROUP BY patch_id)
SELECT patch_id, {r('lo')} AS low_freq_energy, {r('mi')} AS mid_freq_energy, {r('hi')} AS high_freq_energy, {r('hi / (lo + 1e-10)', 4)} AS freq_ratio_high_low FROM s""",
    "directional_fft": directional(),
    "lcc_inverse": _with(f"{LCC}, {inverse('cust_points', 'x', 'y', 'c_custkey')}", f"SELECT c_custkey, {r('lon', 8)} AS lon, {r('lat', 8)} AS lat FROM inv"),
    "lcc_forward": _with(f"{LCC}, {inverse('cust_points', 'x', 'y', 'c_custkey')}, {forward('inv', 'c_custkey')}", f"SELECT c_custkey, {r('fx', 4)} AS x, {r('fy', 4)} AS y FROM fwd"),
    "point_to_tile_pixel": _with(PIXELS, "SELECT c_custkey, tile_id, py, px FROM tp"),
    "point_to_patch": _with(PIXELS, "SELECT tp.c_custkey, p.patch_id FROM tp LEFT JOIN corpus_patches AS p ON p.tile_id = tp.tile_id AND p.y_start = CAST(floor(tp.py / CAST(64 AS DOUBLE)) * 64 AS BIGINT) AND p.x_start = CAST(floor(tp.px / CAST(64 AS DOUBLE)) * 64 AS BIGINT)"),
    "patch_bbox": _with(BOXES, "SELECT patch_id, tile_id, bx_min AS x_min, by_min AS y_min, bx_max AS x_max, by_max AS y_max, (bx_min + bx_max) / 2 AS center_x, (by_min + by_max) / 2 AS center_y FROM bx"),
    "patch_bbox_wgs84": _with(
        f"{BOXES}, {LCC}, cn AS (SELECT patch_id, 0 AS c, bx_min AS x, by_min AS y FROM bx UNION ALL SELECT patch_id, 1, bx_max, by_max FROM bx), {inverse('cn', 'x', 'y', 'patch_id, c')}",
        f"SELECT patch_id, {r('min(lon)', 8)} AS west, {r('min(lat)', 8)} AS south, {r('max(lon)', 8)} AS east, {r('max(lat)', 8)} AS north FROM inv GROUP BY patch_id",
    ),
    "corpus_bounds": _with(
        f"{LCC}, cn AS (SELECT 0 AS c, x_min AS x, y_min AS y FROM corpus_meta UNION ALL SELECT 1, x_max, y_max FROM corpus_meta), {inverse('cn', 'x', 'y', 'c, x, y')}, cb AS (SELECT c, lon, lat FROM inv)",
        f"SELECT x_min, y_min, x_max, y_max, {r('west', 8)} AS west, {r('south', 8)} AS south, {r('east', 8)} AS east, {r('north', 8)} AS north FROM corpus_meta CROSS JOIN (SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM cb) AS b",
    ),
    "coords_coverage": f"""WITH {PIXELS}, c AS (SELECT tp.c_custkey, CASE WHEN {INSIDE} THEN 0 ELSE 1 END AS exit_code, tile_id, x, y, x_min, y_min, x_max, y_max FROM tp CROSS JOIN corpus_meta)
SELECT c.c_custkey, exit_code, c.tile_id IS NOT NULL AS indexed, CAST(coalesce(t.n_patches, 0) AS BIGINT) AS n_patches, {r('x - x_min', 4)} AS from_west, {r('x_max - x', 4)} AS from_east, {r('y - y_min', 4)} AS from_south, {r('y_max - y', 4)} AS from_north
FROM c LEFT JOIN corpus_tiles AS t ON c.tile_id = t.tile_id""",
    "tile_pixel_to_point": """SELECT tile_id, x_min + tile_col * tile_size_ft + 10 * resolution_ft AS x, y_max - tile_row * tile_size_ft - 20 * resolution_ft AS y FROM corpus_tiles CROSS JOIN corpus_meta""",
    "resume_remaining_tiles": "SELECT t.tile_id, t.n_patches FROM corpus_tiles AS t WHERE NOT EXISTS (SELECT 1 FROM corpus_tiles AS done WHERE done.tile_id = t.tile_id AND (done.tile_row + done.tile_col) % 3 = 0)",
    "tile_info": "SELECT tile_id, tile_row, tile_col, h, w, n_patches, CAST(sum(n_patches) OVER (ORDER BY tile_row, tile_col ROWS UNBOUNDED PRECEDING) - n_patches AS BIGINT) AS global_id_start FROM corpus_tiles",
    "global_patch_ids": """WITH t AS (SELECT tile_id, CAST(sum(n_patches) OVER (ORDER BY tile_id ROWS UNBOUNDED PRECEDING) - n_patches AS BIGINT) AS start FROM corpus_tiles)
SELECT p.tile_id, p.local_id, CAST(t.start + row_number() OVER (PARTITION BY p.tile_id ORDER BY p.local_id) - 1 AS BIGINT) AS global_id FROM corpus_patches AS p JOIN t ON p.tile_id = t.tile_id""",
    "heatmap_labels": f"""WITH {HITS}, {PLACED}, mm AS (SELECT min(distance) AS mn, greatest(max(distance) - min(distance), CAST(1 AS DOUBLE) / 1000) AS rg FROM hits),
lb AS (SELECT y0, x0, rnk, CAST(floor(1 + (1 - (distance - mn) / rg) * 99) AS BIGINT) AS label FROM placed CROSS JOIN mm WHERE distance <= 8),
cl AS (SELECT y0 + a.i AS y, x0 + b.i AS x, label, row_number() OVER (PARTITION BY y0 + a.i, x0 + b.i ORDER BY rnk DESC) AS o FROM lb CROSS JOIN nums AS a CROSS JOIN nums AS b WHERE a.i < 16 AND b.i < 16)
SELECT y, x, label FROM cl WHERE o = 1""",
    "fade_mask": f"""WITH {HITS}, {PLACED}, hit AS (SELECT DISTINCT y0 + a.i AS y, x0 + b.i AS x FROM placed CROSS JOIN nums AS a CROSS JOIN nums AS b WHERE a.i < 16 AND b.i < 16 AND distance <= 8)
SELECT a.i AS y, b.i AS x, CASE WHEN hit.y IS NULL THEN CAST(-5 AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END AS fade FROM nums AS a CROSS JOIN nums AS b LEFT JOIN hit ON hit.y = a.i AND hit.x = b.i WHERE a.i < 64 AND b.i < 64""",
    "box_colors": f"""WITH {HITS}, mx AS (SELECT greatest(max(distance), CAST(1 AS DOUBLE) / 1000) AS d FROM hits),
c AS (SELECT patch_id, rnk, CAST(floor(100 + 100 * (distance / d)) AS INTEGER) AS g, CAST(floor(50 * (distance / d)) AS INTEGER) AS b FROM hits CROSS JOIN mx)
SELECT patch_id, rnk, CASE WHEN patch_id = 7 THEN '#00ff00' ELSE concat('#ff', substr('0123456789abcdef', CAST(floor(g / 16) AS INTEGER) + 1, 1), substr('0123456789abcdef', g % 16 + 1, 1), substr('0123456789abcdef', CAST(floor(b / 16) AS INTEGER) + 1, 1), substr('0123456789abcdef', b % 16 + 1, 1)) END AS color FROM c""",
    "similarity_colormap": """SELECT i AS label, CAST(CASE WHEN i = 0 THEN 0 ELSE floor(255 * ((i - 1) / CAST(99 AS DOUBLE))) END AS BIGINT) AS r, CAST(CASE WHEN i = 0 THEN 0 ELSE floor(100 * (1 - abs(2 * ((i - 1) / CAST(99 AS DOUBLE)) - 1))) END AS BIGINT) AS g,
  CAST(CASE WHEN i = 0 THEN 0 ELSE floor(255 * (1 - (i - 1) / CAST(99 AS DOUBLE))) END AS BIGINT) AS b, CAST(CASE WHEN i = 0 THEN 0 ELSE 180 END AS BIGINT) AS a FROM nums WHERE i <= 100""",
    "display_click_to_pixel_whole": """WITH sh AS (SELECT max(y) + 1 AS hh, max(x) + 1 AS ww FROM emb_raster)
SELECT c_custkey, CAST(least(greatest(floor((c_custkey % 500) * (hh / CAST(400 AS DOUBLE))), 0), hh - 1) AS BIGINT) AS py, CAST(least(greatest(floor((c_custkey % 97) * (ww / CAST(90 AS DOUBLE))), 0), ww - 1) AS BIGINT) AS px FROM customer CROSS JOIN sh""",
    "gray_scott_step": f"""WITH b AS (SELECT patch_id, min(z) AS mn, max(z) AS mx FROM p8 GROUP BY patch_id),
v AS (SELECT p.patch_id, p.y, p.x, (z - mn) / (mx - mn) / 2 AS v FROM p8 AS p JOIN b ON p.patch_id = b.patch_id),
n AS (SELECT v.patch_id, v.y, v.x, v.v, 1 - v.v AS u, u1.v + d1.v + l1.v + r1.v - 4 * v.v AS lv FROM v
  JOIN v AS u1 ON u1.patch_id = v.patch_id AND u1.x = v.x AND u1.y = (v.y + 7) % 8 JOIN v AS d1 ON d1.patch_id = v.patch_id AND d1.x = v.x AND d1.y = (v.y + 1) % 8
  JOIN v AS l1 ON l1.patch_id = v.patch_id AND l1.y = v.y AND l1.x = (v.x + 7) % 8 JOIN v AS r1 ON r1.patch_id = v.patch_id AND r1.y = v.y AND r1.x = (v.x + 1) % 8)
SELECT patch_id, y, x, {r('v + CAST(8 AS DOUBLE) / 100 * lv + u * v * v - CAST(95 AS DOUBLE) / 1000 * v')} AS v FROM n""",
    "api_info": """SELECT CAST(count(*) AS BIGINT) AS n_patches, CAST(max(n) AS BIGINT) AS embedding_dim, 'cosinesimil' AS space, 16 AS m, true AS normalized, true AS is_built FROM (SELECT patch_id, count(*) AS n FROM p8 GROUP BY patch_id) AS e""",
}
