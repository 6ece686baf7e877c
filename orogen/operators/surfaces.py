"""Terrain derivatives, statistics and co-occurrence of patches (``patch_id, data``) in the patch's own row.

Everything is a chain of column expressions over arrays of rows (see ``running``): no shuffle, no explode, no Python, and
a neighbourhood costs a few operations a cell whatever its size (but ``tri`` one difference for each of its cells).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..functions.registry import TERRAIN
from . import running
from .filters import Chain
from .running import gathered, padded

Use = Callable[[str, Callable[[str], str]], str]


def _difference(c: Chain, rows: str, step, along_x: bool, cell_size: float) -> str:
    """Rows of central differences, one-sided at the ends."""
    h, w = c.height, c.width
    n, at, reach = (w, "x", (0, 2)) if along_x else (h, "y", (2, 0))
    if n < 2:
        raise ValueError("a slope needs two cells along each axis")
    wide = step(padded(rows, h, w, *((0, 0, 1, 1) if along_x else (1, 1, 0, 0)), mode="nearest"))
    ends = f"if({at} = 0 or {at} = {n - 1}, {float(cell_size)}D, {2.0 * cell_size}D)"
    return step(gathered([(wide, 0, 0), (wide, *reach)], h, w, lambda cells: f"({cells[1]} - {cells[0]}) / {ends}"))


def _slopes(c: Chain, cell_size: float, use: Callable[[str, str], str]) -> str:
    def rows(own: str, step) -> str:
        dy, dx = (_difference(c, own, step, along_x, cell_size) for along_x in (False, True))
        return gathered([(dy, 0, 0), (dx, 0, 0)], c.height, c.width, lambda cells: use(*cells))

    return c.windowed("z", rows)


def _slope(c: Chain, cell_size: float) -> str:
    return _slopes(c, cell_size, lambda dy, dx: f"degrees(atan(sqrt({dx} * {dx} + {dy} * {dy})))")


def _aspect(c: Chain, cell_size: float) -> str:
    flat = "abs({0}) < 1e-8D and abs({1}) < 1e-8D"
    return _slopes(c, cell_size, lambda dy, dx: f"if({flat.format(dy, dx)}, -1D, (degrees(atan2(-{dx}, {dy})) + 360D) % 360D)")


def _curvature(c: Chain, cell_size: float) -> str:
    def rows(own: str, step) -> str:
        twice = [_difference(c, _difference(c, own, step, along_x, cell_size), step, along_x, cell_size) for along_x in (False, True)]
        return gathered([(t, 0, 0) for t in twice], c.height, c.width, lambda cells: f"-({cells[0]} + {cells[1]})")

    return c.windowed("z", rows)


def _tpi(c: Chain, radius: int) -> str:
    return c.minus("z", c.box("z", 2 * int(radius) + 1))


def _tri(c: Chain, window_size: int) -> str:
    size = int(window_size)
    before, after = size // 2, size - 1 - size // 2

    def rows(own: str, step) -> str:
        wide = step(padded(own, c.height, c.width, before, after, before, after))
        # A row's windows are cut once for all rows of cells that read them. A window is looped over: as a sum of a term for
        # each of its cells, the expression would be as deep as the window is large.
        cut = step(f"transform({wide}, r -> transform(sequence(1, {c.width}), x -> slice(r, x, {size})))")
        total = "aggregate(l, 0D, (a, r) -> aggregate(get(r, x), a, (b, v) -> b + abs(v - o)))"
        cell = f"get(transform(array(get(get(get(l, {before}), x), {before})), o -> {total} / {float(size * size)}D), 0)"
        row = f"transform(sequence(0, {c.width - 1}), x -> {cell})"
        return running.bound(cut, lambda g: f"transform(sequence(0, {c.height - 1}), y -> get(transform(array(slice({g}, y + 1, {size})), l -> {row}), 0))")

    return c.windowed("z", rows)


def _roughness(c: Chain, window_size: int) -> str:
    mean = c.box("z", int(window_size))
    square = c.box(c.both("z", "z", lambda a, b: a * b), int(window_size))
    return c.both(square, mean, lambda s, m: F.sqrt(F.greatest(s - m * m, F.lit(0.0))))


SURFACES: dict[str, Callable[..., str]] = {"slope": _slope, "aspect": _aspect, "curvature": _curvature, "tpi": _tpi, "tri": _tri, "roughness": _roughness}


def surface(patches: DataFrame, name: str, height: int, width: int, **params) -> DataFrame:
    """``patch_id, data``: a terrain derivative of each patch, row-major; gaps take the mean of the patch's other cells."""
    c = Chain(patches, height, width)
    out = SURFACES[name](c, **(TERRAIN.named(name).default_params | params))
    return c.df.select("patch_id", F.col(out).alias("data"))


def cells(surfaces: DataFrame, width: int) -> DataFrame:
    # Of a bare column a filter on its size would be inferred, and pushed down to before the patches are dealt out: surfaces
    # were worked out there too, in whatever tasks held the patches.
    rows = surfaces.select("patch_id", F.posexplode(F.arrays_zip(F.col("data").alias("z"))).alias("i", "c"))
    return rows.select("patch_id", F.floor(F.col("i") / width).cast("long").alias("y"), (F.col("i") % width).cast("long").alias("x"), "c.z")


def _mean(array: str, of: str = "v") -> str:
    return f"aggregate({array}, 0D, (a, v) -> a + {of}) / size({array})"


def entropy(array: str, bins: int = 50) -> str:
    """Entropy of a histogram between least and largest value; a constant array lies in the middle bin of a unit range."""
    low, high = f"array_min({array})", f"array_max({array})"
    place = f"transform({array}, v -> if(k.high = k.low, {bins // 2}, cast(least(floor((v - k.low) * ({bins} / (k.high - k.low))), {bins - 1}) as int)))"
    width = f"if(k.high = k.low, {1 / bins}D, (k.high - k.low) / {bins})"
    counted = f"transform(sequence(0, {bins - 1}), b -> size(filter(p, q -> q = b)) / (size({array}) * {width}) + 1e-10D)"
    dense = f"get(transform(array({place}), p -> {counted}), 0)"
    share = "aggregate(d, 0D, (a, v) -> a + v)"
    total = f"get(transform(array({dense}), d -> get(transform(array({share}), t -> -aggregate(d, 0D, (a, v) -> a + v / t * ln(v / t))), 0)), 0)"
    return f"get(transform(array(named_struct('low', {low}, 'high', {high})), k -> {total}), 0)"


def six_stats(surfaces: DataFrame, leave_out_negative: bool = False) -> DataFrame:
    """``patch_id, mean, std, energy, entropy, value_range, median`` of each array; for aspects flat cells are left out
    unless all are flat."""
    own = "if(exists(data, v -> v >= 0), filter(data, v -> v >= 0), data)" if leave_out_negative else "data"
    rows = surfaces.select("patch_id", F.expr(own).alias("g")).withColumn("mean", F.expr(_mean("g")))
    middle = "(get(s, cast(floor((size(s) - 1) / 2) as int)) + get(s, cast(floor(size(s) / 2) as int))) / 2"
    return rows.select(
        "patch_id", "mean", F.expr(f"sqrt({_mean('g', '(v - mean) * (v - mean)')})").alias("std"), F.expr(_mean("g", "v * v")).alias("energy"), F.expr(entropy("g")).alias("entropy"),
        F.expr("array_max(g) - array_min(g)").alias("value_range"), F.expr(f"get(transform(array(array_sort(g)), s -> {middle}), 0)").alias("median"),
    )


#: Fixed: distances and angles (degrees) of co-occurrence.
DISTANCES, ANGLES = (1, 2, 4), (0, 45, 90, 135)


def _pair(cells: list[str]) -> str:
    return f"named_struct('i', {cells[0]}, 'j', {cells[1]})"


def cooccurrence(patches: DataFrame, height: int, width: int, levels: int = 64, distances=DISTANCES, angles=ANGLES) -> DataFrame:
    """``patch_id, contrast, dissimilarity, homogeneity, energy, correlation, asm_value``: means over distances and angles.

    For each offset the pairs of levels are an array of codes, in both orders. Sorted, equal codes stand together: their
    numbers give the sum of squares, and all other properties are means over the pairs, so no matrix is made.
    """
    c = Chain(patches, height, width)
    low, span = "array_min(z)", "array_max(z) - array_min(z)"
    level = f"transform(z, v -> if(k.span < 1e-10D, 0, cast(floor((v - k.low) / k.span * {levels - 1}) as int)))"
    q = c.step(F.expr(f"get(transform(array(named_struct('low', {low}, 'span', {span})), k -> {level}), 0)"))
    rows = c.step(F.expr(running.as_rows(q, height, width)))
    found = []
    for d in distances:
        for a in np.radians(angles):
            dy, dx = int(round(np.sin(a) * d)), int(round(np.cos(a) * d))
            h, w = height - abs(dy), width - abs(dx)
            if h <= 0 or w <= 0:
                continue
            terms = [(rows, max(-dy, 0), max(-dx, 0)), (rows, max(dy, 0), max(dx, 0))]
            pairs = c.step(F.expr(f"flatten({gathered(terms, h, w, _pair)})"))
            n = 2 * h * w
            codes = f"concat(transform({pairs}, p -> p.i * {levels} + p.j), transform({pairs}, p -> p.j * {levels} + p.i))"
            start = "named_struct('code', -1, 'run', 0L, 'total', 0L)"
            more = "named_struct('code', v, 'run', if(v = a.code, a.run + 1, 1L), 'total', a.total + if(v = a.code, 2 * a.run + 1, 1L))"
            squares = c.step(F.expr(f"aggregate(array_sort({codes}), {start}, (a, v) -> {more}, a -> a.total) / {float(n * n)}D"))
            sums = "named_struct('c', 0L, 'd', 0L, 'h', 0D, 's', 0L, 'ss', 0L, 'ij', 0L)"
            add = "named_struct('c', a.c + (v.i - v.j) * (v.i - v.j), 'd', a.d + abs(v.i - v.j), 'h', a.h + 1D / (1 + (v.i - v.j) * (v.i - v.j)), 's', a.s + v.i + v.j, 'ss', a.ss + v.i * v.i + v.j * v.j, 'ij', a.ij + v.i * v.j)"
            m = c.step(F.expr(f"aggregate({pairs}, {sums}, (a, v) -> {add})"))
            mean, var = f"({m}.s / {float(n)}D)", f"({m}.ss / {float(n)}D - pow({m}.s / {float(n)}D, 2))"
            cov = f"(2D * {m}.ij / {float(n)}D - {mean} * {mean})"
            half = float(h * w)
            parts = [f"{m}.c / {half}D", f"{m}.d / {half}D", f"{m}.h / {half}D", f"sqrt({squares})", f"if({var} < 1e-12D, 1D, {cov} / {var})", squares]
            found.append(c.step(F.expr(f"array({', '.join(parts)})")))
            c.df = c.df.drop(pairs, squares, m)
    many = len(distances) * len(angles)
    # An offset beyond the patch has no pairs: it counts as correlated and as 0 otherwise.
    missing = many - len(found)
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm_value")
    mean = lambda i: f"({' + '.join([f'get({f}, {i})' for f in found] + [f'{float(missing if i == 4 else 0)}D'])}) / {many}"
    return c.df.select("patch_id", *[F.expr(mean(i)).alias(n) for i, n in enumerate(names)])


def _spectrum(c: Chain, grid: str) -> str:
    """Centred magnitude of a patch's spectrum: a row–column transform, each a product with cosines and with sines."""
    turn = lambda n: 2 * np.pi * np.outer(np.arange(n) - n // 2, np.arange(n)) / n
    by_y, by_x = turn(c.height), turn(c.width)
    even, odd = c.rows(grid, np.cos(by_y)), c.rows(grid, np.sin(by_y))
    real = c.minus(c.columns(even, np.cos(by_x)), c.columns(odd, np.sin(by_x)))
    imaginary = c.both(c.columns(odd, np.cos(by_x)), c.columns(even, np.sin(by_x)), lambda a, b: a + b)
    return c.both(real, imaginary, lambda a, b: F.sqrt(a * a + b * b))


def band_energy(patches: DataFrame, height: int, width: int) -> DataFrame:
    """``patch_id, low_freq_energy, mid_freq_energy, high_freq_energy, freq_ratio_high_low``: mean magnitude of three rings
    around frequency 0 (0 for a ring without cells), and the outer over the inner."""
    c = Chain(patches, height, width)
    m = _spectrum(c, "z")
    y, x = np.mgrid[:height, :width]
    r, top = np.hypot(y - height // 2, x - width // 2).ravel(), min(height // 2, width // 2)
    rings = [np.flatnonzero(ring).tolist() for ring in (r < top * 0.2, (r >= top * 0.2) & (r < top * 0.6), r >= top * 0.6)]
    held = c.table(rings, "array<array<int>>")
    total = lambda k: f"aggregate(get({held}, {k}), 0D, (a, i) -> a + get(g, i)) / {max(len(rings[k]), 1)}D"
    c.df = c.df.select("patch_id", F.expr(running.bound(m, lambda g: f"array({', '.join(total(k) for k in range(3))})")).alias("e"))
    low, mid, high = (F.get("e", F.lit(k)) for k in range(3))
    return c.df.select(
        "patch_id", low.alias("low_freq_energy"), mid.alias("mid_freq_energy"), high.alias("high_freq_energy"), (high / (low + 1e-10)).alias("freq_ratio_high_low")
    )


def directional(patches: DataFrame, height: int, width: int, angles=(0.0, 45.0, 90.0, 135.0)) -> DataFrame:
    """``patch_id, angle, energy, low, high, peak, centroid, spread``: statistics of the magnitudes on a line through the
    centre of the spectrum, under a Hann window (defined as in ``functions.spectral.directional``)."""
    c = Chain(patches, height, width)
    window = c.table(np.outer(np.hanning(height), np.hanning(width)).ravel().tolist(), "array<double>")
    m = _spectrum(c, c.both("z", window, lambda a, b: a * b))
    lines = []
    for angle in angles:
        y, x = spectral.slice_cells(height, width, angle)
        lines.append((y * width + x).tolist())
    held = c.table(lines, "array<array<int>>")
    rows = c.step(F.expr(running.bound(m, lambda g: f"transform({held}, l -> transform(l, i -> get({g}, i)))")))
    n = len(lines[0]) // 2
    power = "aggregate(v, 0D, (a, w) -> a + w * w)"
    centre = "aggregate(sequence(0, size(v) - 1), 0D, (a, i) -> a + i * get(v, i) * get(v, i))"
    around = "aggregate(sequence(0, size(v) - 1), 0D, (a, i) -> a + (i - t.c / t.p) * (i - t.c / t.p) * get(v, i) * get(v, i))"
    part = lambda text: f"aggregate({text}, 0D, (a, w) -> a + w)"
    # Mirrored frequencies are equal but for rounding, and the first of them is the peak.
    peak = "array_position(transform(v, w -> round(w, 9)), array_max(transform(v, w -> round(w, 9)))) - 1"
    fields = {
        "energy": "ln(1 + t.p)", "low": part(f"slice(v, 1, {n // 3})"), "high": part(f"slice(v, {2 * n // 3 + 1}, size(v))"), "peak": f"({peak}) / {max(n, 1)}D",
        "centroid": f"if(t.p > 0, t.c / t.p / {max(n, 1)}D, 0D)", "spread": f"if(t.p > 0, sqrt(greatest({around} / t.p, 0D)) / {max(n, 1)}D, 0D)",
    }
    measured = f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields.items())})"
    totals = f"get(transform(array(named_struct('p', {power}, 'c', {centre})), t -> {measured}), 0)"
    found = c.step(F.expr(f"transform({rows}, v -> {totals})"))
    out = c.df.select("patch_id", *[F.struct(F.lit(float(a)).alias("angle"), F.get(found, F.lit(k)).alias("s")).alias(f"a{k}") for k, a in enumerate(angles)])
    # A row for each angle of a patch, as that is the result; no cell becomes a row.
    return out.select("patch_id", F.explode(F.array(*[f"a{k}" for k in range(len(angles))])).alias("r")).select("patch_id", "r.angle", "r.s.*")
