"""Decompositions and upsamplers of patches as column expressions: no Python runs on the patches.

A patch is one row (``patch_id, data``, row-major), so nothing is shuffled: a filter is a chain of higher-order functions
over the array. What depends on the patch's size alone (filter weights, offsets, where an index beyond the edge reads) is
worked out once on the driver and sent along as one row of small tables. ``functions`` has the same methods on stacks of
patches, for signatures that fuse many of them; tests hold the two to each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decomposition as shapes
from ..functions import linear
from ..functions.registry import DECOMPOSITIONS, UPSAMPLERS
from . import running
from .embed import spread

Offsets = list[tuple[int, int]]


class Chain:
    """Patches of one size and the steps taken so far, each a column of its own."""

    def __init__(self, patches: DataFrame, height: int, width: int) -> None:
        self.height, self.width, self.steps = height, width, 0
        self.known: dict[str, str] = {}
        gap = lambda v: v.isNull() | F.isnan(v)
        known = F.filter("data", lambda v: ~gap(v))
        mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(known), F.lit(1))
        self.df = spread(patches).select("patch_id", F.col("data").cast("array<double>").alias("data")).withColumn("mean", mean)
        self.df = self.df.withColumn("z", F.transform("data", lambda v: F.when(gap(v), F.col("mean")).otherwise(v)))

    def step(self, expression: Column) -> str:
        self.steps += 1
        self.df = self.df.withColumn(name := f"s{self.steps}", expression)
        return name

    def table(self, value: list, schema: str) -> str:
        """A constant that goes to every task as one broadcast row, once however often it is asked for."""
        if (key := repr(value)) not in self.known:
            self.steps += 1
            one = self.df.sparkSession.createDataFrame([(value,)], f"s{self.steps} {schema}")
            self.df = self.df.crossJoin(F.broadcast(one))
            self.known[key] = f"s{self.steps}"
        return self.known[key]

    def cells(self, grid: str, value: Callable[[Column, Column, Column], Column], height: int | None = None, width: int | None = None) -> str:
        """A grid of ``value`` of the grid, the row and the column.

        The grid is bound to a variable first: were its expression merged into the function, each cell would repeat it.
        """
        h, w = height or self.height, width or self.width
        whole = lambda g: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda c: value(g, F.floor(c / w).cast("int"), (c % w).cast("int")))
        return self.step(F.get(F.transform(F.array(F.col(grid)), whole), F.lit(0)))

    def both(self, a: str, b: str, join: Callable[[Column, Column], Column]) -> str:
        return self.step(F.zip_with(a, b, join))

    def minus(self, a: str, b: str) -> str:
        return self.both(a, b, lambda x, y: x - y)

    # --- linear filters -----------------------------------------------------------------------------------------

    def _taps(self, matrix: np.ndarray) -> str:
        rows = [[(int(i), float(row[i])) for i in np.flatnonzero(row)] for row in matrix]
        return self.table(rows, "array<array<struct<i:int,w:double>>>")

    def rows(self, grid: str, matrix: np.ndarray, width: int | None = None) -> str:
        """The matrix applied down each column."""
        taps, w = self._taps(matrix), width or self.width
        return self.cells(grid, lambda g, y, x: F.aggregate(F.get(F.col(taps), y), F.lit(0.0), lambda a, t: a + t["w"] * F.get(g, t["i"] * w + x)), len(matrix), w)

    def columns(self, grid: str, matrix: np.ndarray, height: int | None = None) -> str:
        """The matrix applied along each row."""
        taps, w = self._taps(matrix), matrix.shape[1]
        return self.cells(grid, lambda g, y, x: F.aggregate(F.get(F.col(taps), x), F.lit(0.0), lambda a, t: a + t["w"] * F.get(g, y * w + t["i"])), height or self.height, len(matrix))

    def filtered(self, grid: str, of: Callable[[int], np.ndarray], of_x: Callable[[int], np.ndarray] | None = None) -> str:
        """A separable filter, by its matrix for an axis of a size."""
        by_y, by_x = of(self.height), (of_x or of)(self.width)
        return self.columns(self.rows(grid, by_y), by_x, len(by_y))

    def dense(self, grid: str, matrix: np.ndarray) -> str:
        rows = self.table(matrix.tolist(), "array<array<double>>")
        whole = lambda g: F.transform(rows, lambda row: F.aggregate(F.zip_with(row, g, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
        return self.step(F.get(F.transform(F.array(F.col(grid)), whole), F.lit(0)))

    # --- neighbourhoods -----------------------------------------------------------------------------------------

    def around(self, grid: str, offsets: Offsets, use: Callable[[Column, Callable[[Column], Column], Column], Column], mode: str = "reflect", sign: int = 1, numbers: list[float] | None = None) -> str:
        """For each cell ``use(offsets, read, own)``: ``read`` gives the value at an offset (``number`` is its number)."""
        reach = max(max(abs(y), abs(x)) for y, x in offsets)
        span = np.arange(-reach, reach + 1)
        index = lambda n: [linear.index_map(np.arange(n) + d, n, mode).tolist() for d in span]
        by_y, by_x = self.table(index(self.height), "array<array<int>>"), self.table(index(self.width), "array<array<int>>")
        listed = self.table([(sign * y + reach, sign * x + reach, float(v)) for (y, x), v in zip(offsets, numbers or [0.0] * len(offsets), strict=True)], "array<struct<y:int,x:int,number:double>>")

        def value(g: Column, y: Column, x: Column) -> Column:
            read = lambda o: F.get(g, F.get(F.get(F.col(by_y), o["y"]), y) * self.width + F.get(F.get(F.col(by_x), o["x"]), x))
            return use(F.col(listed), read, F.get(g, y * self.width + x))

        return self.cells(grid, value)

    def windowed(self, grid: str, use: Callable[[str, Callable[[str], str]], str]) -> str:
        """A grid from rows of another by ``running``; the steps between are given up."""
        began = self.steps
        stepped = lambda text: self.step(F.expr(text))
        out = stepped(f"flatten({use(stepped(running.as_rows(grid, self.height, self.width)), stepped)})")
        self.df = self.df.drop(*[f"s{k}" for k in range(began + 1, self.steps)])
        return out

    def flat_extreme(self, grid: str, offsets: Offsets, largest: bool) -> str:
        return self.windowed(grid, lambda rows, step: running.extreme(rows, self.height, self.width, offsets, largest, step))

    def box(self, grid: str, size: int) -> str:
        """Mean over a square, edges reflected."""
        total = self.windowed(grid, lambda rows, step: running.box_total(rows, self.height, self.width, size, step))
        return self.step(F.transform(total, lambda v: v / float(size * size)))

    def least(self, grid: str, offsets: Offsets, heights: list[float] | None = None) -> str:
        if heights is None:
            return self.flat_extreme(grid, offsets, False)
        return self.around(grid, offsets, lambda o, read, _: F.array_min(F.transform(o, lambda k: read(k) - k["number"])), numbers=heights)

    def most(self, grid: str, offsets: Offsets, heights: list[float] | None = None) -> str:
        if heights is None:
            return self.flat_extreme(grid, offsets, True)
        return self.around(grid, offsets, lambda o, read, _: F.array_max(F.transform(o, lambda k: read(k) + k["number"])), sign=-1, numbers=heights)

    def opened(self, grid: str, offsets: Offsets) -> str:
        return self.most(self.least(grid, offsets), offsets)

    def closed(self, grid: str, offsets: Offsets) -> str:
        return self.least(self.most(grid, offsets), offsets)

    def scaled(self, top: float) -> tuple[str, str, str]:
        """Values scaled to 0..top, the least value and the range (1 where constant)."""
        low = self.step(F.array_min("z"))
        span = self.step(F.array_max("z") - F.col(low))
        span = self.step(F.when(F.col(span) == 0, 1.0).otherwise(F.col(span)))
        return self.step(F.transform("z", lambda v: (v - F.col(low)) / F.col(span) * top)), low, span

    def unscaled(self, grid: str, low: str, span: str, top: float = 1.0) -> str:
        return self.step(F.transform(grid, lambda v: v / top * F.col(span) + F.col(low)))


def _smooth(c: Chain, grid: str, sigma: float, mode: str = "reflect") -> str:
    return c.filtered(grid, lambda n: linear.gaussian_matrix(n, float(sigma), mode))


def _box(c: Chain, grid: str, size: int) -> str:
    return c.box(grid, int(size))


def _bilateral(c: Chain, d: int, sigma_color: float, sigma_space: float) -> str:
    v, low, span = c.scaled(255.0)
    offsets = shapes.disk(max(d // 2, 1))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weight"))

    def mean(listed, read, own):
        # Each value and weight is an element of its own, so it is worked out once, not wherever it is used.
        near = F.transform(listed, lambda o: F.struct(read(o).alias("v"), o["number"].alias("number")))
        weighed = F.transform(near, lambda n: F.struct(n["v"].alias("v"), F.exp(n["number"] - 0.5 * (n["v"] - own) * (n["v"] - own) / float(sigma_color) ** 2).alias("w")))
        return F.aggregate(weighed, start, lambda a, n: F.struct((a["total"] + n["w"] * n["v"]).alias("total"), (a["weight"] + n["w"]).alias("weight")), lambda a: a["total"] / a["weight"])

    found = c.around(v, offsets, mean, "mirror", numbers=[-0.5 * (y * y + x * x) / sigma_space**2 for y, x in offsets])
    return c.unscaled(found, low, span, 255.0)


def _polynomial(c: Chain, degree: int) -> str:
    top = degree if degree in (1, 2) else 3
    y, x = (a.ravel().astype(float) for a in np.mgrid[: c.height, : c.width])
    design = np.stack([x**i * y**j for i in range(top + 1) for j in range(top + 1 - i)], axis=1)
    return c.dense(c.dense("z", np.linalg.pinv(design)), design)


def _median(c: Chain, size: int) -> str:
    offsets = shapes.square(size)
    return c.around("z", offsets, lambda o, read, _: F.get(F.sort_array(F.transform(o, read)), F.lit(len(offsets) // 2)))


def _diffusion(c: Chain, iterations: int, kappa: float, gamma: float) -> str:
    def flow(listed, read, own):
        total = F.aggregate(listed, F.lit(0.0), lambda a, o: a + (read(o) - own) * F.exp(-((read(o) - own) / float(kappa)) * ((read(o) - own) / float(kappa))))
        return own + float(gamma) * total

    grid = "z"
    for _ in range(int(iterations)):
        grid = c.around(grid, [(-1, 0), (1, 0), (0, -1), (0, 1)], flow, "wrap")
    return grid


def _guided(c: Chain, radius: int, eps: float) -> str:
    v, low, span = c.scaled(1.0)
    mean, square = _box(c, v, 2 * radius + 1), _box(c, c.both(v, v, lambda a, b: a * b), 2 * radius + 1)
    var = c.both(square, mean, lambda s, m: s - m * m)
    slope = c.step(F.transform(var, lambda x: x / (x + float(eps))))
    rest = c.minus(mean, c.both(slope, mean, lambda a, b: a * b))
    line = c.both(_box(c, slope, 2 * radius + 1), v, lambda a, b: a * b)
    return c.unscaled(c.both(line, _box(c, rest, 2 * radius + 1), lambda a, b: a + b), low, span)


def _rolling_ball(c: Chain, radius: int) -> str:
    every = [(y, x, radius - max(radius**2 - x * x - y * y, 0) ** 0.5) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]
    kept = [o for o in every if o[2] > 0]
    offsets, heights = [o[:2] for o in kept], [o[2] for o in kept]
    return c.most(c.least("z", offsets, heights), offsets, heights)


def _laplace(c: Chain, grid: str, height: int | None = None, width: int | None = None) -> str:
    h, w = height or c.height, width or c.width
    return c.both(c.rows(grid, linear.laplace_matrix(h), w), c.columns(grid, linear.laplace_matrix(w), h), lambda a, b: a + b)


def _morphology(c: Chain, operation: str, offsets: Offsets) -> str:
    if operation == "opening":
        return c.opened("z", offsets)
    if operation == "closing":
        return c.closed("z", offsets)
    return c.both(c.opened("z", offsets), c.closed("z", offsets), lambda a, b: (a + b) / 2)


def _log(c: Chain, sigma: float) -> str:
    return c.step(F.transform(_laplace(c, _smooth(c, "z", sigma)), lambda v: v * float(sigma) ** 2))


def _dog(c: Chain, sigma_low: float, sigma_high: float) -> str:
    high = sigma_high if sigma_high > sigma_low else 2 * sigma_low
    return c.minus(_smooth(c, "z", sigma_low, "nearest"), _smooth(c, "z", high, "nearest"))


def _gradient_range(c: Chain, size: int, shape: str) -> str:
    offsets = {"disk": shapes.disk, "square": shapes.square}.get(shape, shapes.diamond)(size)
    return c.minus(c.most("z", offsets), c.least("z", offsets))


def _tophat(c: Chain, size: int, mode: str) -> str:
    return c.minus("z", c.opened("z", shapes.disk(size))) if mode == "white" else c.minus(c.closed("z", shapes.disk(size)), "z")


def _two_tophats(c: Chain, size: int) -> str:
    return c.minus(_tophat(c, size, "white"), _tophat(c, size, "black"))


def _wavelet(c: Chain, wavelet: str, level: int) -> str:
    return c.filtered("z", lambda n: linear.wavelet_trend_matrix(n, wavelet, int(level)))


#: Methods that give the trend, and methods that give the residual.
TRENDS: dict[str, Callable[..., str]] = {
    "gaussian": lambda c, sigma: _smooth(c, "z", sigma),
    "bilateral": _bilateral,
    "wavelet_dwt": _wavelet,
    "morphological": lambda c, operation, size: _morphology(c, operation, shapes.disk(size)),
    "polynomial": _polynomial,
    "gaussian_anisotropic": lambda c, sigma_x, sigma_y: c.filtered("z", lambda n: linear.gaussian_matrix(n, float(sigma_y)), lambda n: linear.gaussian_matrix(n, float(sigma_x))),
    "median": _median,
    "uniform": lambda c, size: _box(c, "z", size),
    "morphological_square": lambda c, operation, size: _morphology(c, operation, shapes.square(size)),
    "morphological_diamond": lambda c, operation, radius: _morphology(c, operation, shapes.diamond(radius)),
    "anisotropic_diffusion": _diffusion,
    "guided": _guided,
    "rolling_ball": _rolling_ball,
    "wavelet_biorthogonal": _wavelet,
}
RESIDUALS: dict[str, Callable[..., str]] = {"tophat": _tophat, "dog": _dog, "log": _log, "morphological_gradient": _gradient_range, "tophat_combined": _two_tophats}


def _zoom(order: int) -> Callable[[Chain, float], str]:
    return lambda c, scale: c.filtered("z", lambda n: linear.zoom_matrix(n, float(scale), order))


def _lanczos(c: Chain, scale: int) -> str:
    single = c.step(F.transform("z", lambda v: v.cast("float").cast("double")))
    return c.filtered(single, lambda n: linear.lanczos_matrix(n, int(scale)))


def _zero_padded(c: Chain, scale: int) -> str:
    """Zero-padding of the spectrum along an axis is a complex matrix; both axes give two real products."""

    def matrix(n: int) -> np.ndarray:
        k = np.arange(n)
        signed = np.where(k < (n + 1) // 2, k, k - n)
        return np.exp(2j * np.pi * np.outer(np.arange(n * scale), signed) / (n * scale)) @ np.exp(-2j * np.pi * np.outer(k, k) / n) / n

    return c.minus(c.filtered("z", lambda n: matrix(n).real), c.filtered("z", lambda n: matrix(n).imag))


def _stuffed(c: Chain, scale: int, kernel: np.ndarray) -> str:
    return c.filtered("z", lambda n: linear.stuffed_matrix(n, int(scale), kernel))


def _sinc(window: Callable[[int], np.ndarray]) -> Callable[..., str]:
    return lambda c, scale, kernel_size: _stuffed(c, scale, np.sinc(np.arange(-kernel_size, kernel_size + 1) / scale) * window(2 * kernel_size + 1))


def _mitchell(c: Chain, scale: int) -> str:
    t = np.abs(np.arange(-4 * scale, 4 * scale + 1) / scale)
    near, far = (7 * t**3 - 12 * t**2 + 16 / 3) / 6, (-7 / 3 * t**3 + 12 * t**2 - 20 * t + 32 / 3) / 6
    return _stuffed(c, scale, np.where(t < 1, near, np.where(t < 2, far, 0.0)))


def _difference(n: int) -> np.ndarray:
    """Central differences, one-sided at the ends."""
    m = (np.eye(n, k=1) - np.eye(n, k=-1)) / 2
    m[0, :2], m[-1, -2:] = (-1, 1), (-1, 1)
    return m


def _edge_directed(c: Chain, scale: int) -> str:
    wide = lambda grid: c.filtered(grid, lambda n: linear.zoom_matrix(n, float(scale), 1))
    steep = c.both(wide(c.rows("z", _difference(c.height))), wide(c.columns("z", _difference(c.width))), lambda a, b: F.sqrt(a * a + b * b))
    most = c.step(F.array_repeat(F.array_max(steep) + 1e-10, c.height * c.width * scale * scale))
    share = c.both(steep, most, lambda v, m: v / m)
    smooth = c.both(_zoom(3)(c, scale), share, lambda v, s: v * (1 - s))
    return c.both(smooth, c.both(_lanczos(c, scale), share, lambda v, s: v * s), lambda a, b: a + b)


def _regularized(c: Chain, scale: int, lambda_reg: float) -> str:
    h, w = c.height * scale, c.width * scale
    own = lambda z, y, x: F.when((y % scale == 0) & (x % scale == 0), F.get(z, F.floor(y / scale).cast("int") * c.width + F.floor(x / scale).cast("int")))
    known = c.cells("z", own, h, w)
    grid = _zoom(3)(c, scale)
    for _ in range(10):
        moved = c.both(grid, _laplace(c, grid, h, w), lambda v, b: v - float(lambda_reg) * b)
        grid = c.both(known, moved, lambda k, v: F.coalesce(k, v))
    return grid


ZOOMS: dict[str, Callable[..., str]] = {
    "bicubic": _zoom(3), "lanczos": _lanczos, "bspline": _zoom(2), "fft_zeropad": _zero_padded, "nearest": _zoom(0), "bilinear": _zoom(1), "quadratic": _zoom(2), "quartic": _zoom(4), "quintic": _zoom(5),
    "sinc_hamming": _sinc(np.hamming), "sinc_blackman": _sinc(np.blackman), "cubic_catmull_rom": lambda c, scale: c.filtered("z", lambda n: linear.not_a_knot_matrix(n, int(n * scale))),
    "cubic_mitchell": _mitchell, "edge_directed": _edge_directed, "regularized": _regularized,
}


def _cells(c: Chain, width: int, **grids: str) -> DataFrame:
    rows = c.df.select("patch_id", F.posexplode(F.arrays_zip(*[F.col(g).alias(n) for n, g in grids.items()])).alias("i", "c"))
    return rows.select("patch_id", F.floor(F.col("i") / width).cast("long").alias("y"), (F.col("i") % width).cast("long").alias("x"), *[F.col(f"c.{n}").alias(n) for n in grids])


def decompose(patches: DataFrame, name: str, height: int, width: int, **params) -> DataFrame:
    """Cells ``patch_id, y, x, trend, residual`` of patches (patch_id, data) of one size; trend and residual add up to the
    patch. Gaps take the mean of the patch's other cells; given parameters override the defaults."""
    own = DECOMPOSITIONS.named(name).default_params | params
    c = Chain(patches, height, width)
    if name in TRENDS:
        trend = TRENDS[name](c, **own)
        residual = c.minus("z", trend)
    else:
        residual = RESIDUALS[name](c, **own)
        trend = c.minus("z", residual)
    return _cells(c, width, trend=trend, residual=residual)


def upsample(patches: DataFrame, name: str, height: int, width: int, **params) -> DataFrame:
    """Cells ``patch_id, y, x, z`` of patches (patch_id, data) of one size, ``scale`` times as many along each axis."""
    own = UPSAMPLERS.named(name).default_params | params
    c = Chain(patches, height, width)
    out = ZOOMS[name](c, **own)
    return _cells(c, int(round(width * own["scale"])), z=out)
