"""Decompositions of patches into a trend and a residual that add up to the patch."""

from __future__ import annotations

import numpy as np

from . import linear
from .registry import DECOMPOSITIONS as METHODS

register = METHODS.register


def split(z: np.ndarray, trend: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return trend, z - trend


def scaled(z: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patches scaled to 0..top, their least values and their ranges (1 where constant)."""
    low = z.min(axis=(1, 2), keepdims=True)
    span = z.max(axis=(1, 2), keepdims=True) - low
    span = np.where(span == 0, 1.0, span)
    return (z - low) / span * top, low, span


@register("gaussian", "core", "broad forms", "detail under sigma", sigma=10)
def gaussian(z, sigma):
    """Gaussian low-pass."""
    return split(z, linear.gaussian(z, sigma, sigma))


@register("bilateral", "core", "edges", "texture", d=9, sigma_color=75, sigma_space=75)
def bilateral(z, d, sigma_color, sigma_space):
    """Mean over a disc, weighted by distance in space and in value (values scaled to 0..255)."""
    v, low, span = scaled(z, 255.0)
    radius = max(d // 2, 1)
    total, weight = np.zeros_like(v), np.zeros_like(v)
    rows, columns = np.arange(v.shape[1]), np.arange(v.shape[2])
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                near = v[:, linear.index_map(rows + dy, len(rows), "mirror")][:, :, linear.index_map(columns + dx, len(columns), "mirror")]
                w = np.exp(-0.5 * (dy * dy + dx * dx) / sigma_space**2 - 0.5 * (near - v) ** 2 / sigma_color**2)
                total += w * near
                weight += w
    return split(z, total / weight / 255.0 * span + low)


def wavelet_split(z, wavelet, level):
    rows, columns = (linear.wavelet_trend_matrix(n, wavelet, int(level)) for n in z.shape[1:])
    return split(z, linear.both(z, rows, columns))


@register("wavelet_dwt", "core", "coarse scales", "fine scales", wavelet="db4", level=3)
def wavelet_dwt(z, wavelet, level):
    """Approximation of a discrete wavelet transform."""
    return wavelet_split(z, wavelet, level)


def disk(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= r * r]


def diamond(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if abs(x) + abs(y) <= r]


def square(s: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-(s // 2), s - s // 2) for x in range(-(s // 2), s - s // 2)]


def extreme(z: np.ndarray, offsets: list[tuple[int, int]], largest: bool, height=None) -> np.ndarray:
    """Erosion (least) or dilation (largest, over the mirrored footprint), with a height per offset if it isn't flat."""
    pick, sign, out = (np.maximum, -1, None) if largest else (np.minimum, 1, None)
    rows, columns = np.arange(z.shape[1]), np.arange(z.shape[2])
    for k, (dy, dx) in enumerate(offsets):
        near = z[:, linear.index_map(rows + sign * dy, len(rows), "reflect")][:, :, linear.index_map(columns + sign * dx, len(columns), "reflect")]
        if height is not None:
            near = near - sign * height[k]
        out = near if out is None else pick(out, near)
    return out


def opened(z, offsets):
    return extreme(extreme(z, offsets, False), offsets, True)


def closed(z, offsets):
    return extreme(extreme(z, offsets, True), offsets, False)


def morphology(z, operation, offsets):
    if operation == "opening":
        return split(z, opened(z, offsets))
    if operation == "closing":
        return split(z, closed(z, offsets))
    return split(z, (opened(z, offsets) + closed(z, offsets)) / 2)


@register("morphological", "core", "large forms", "small peaks or pits", operation="opening", size=10)
def morphological(z, operation, size):
    """Opening, closing or their mean over a disc."""
    return morphology(z, operation, disk(size))


@register("tophat", "core", "background", "small peaks (white) or pits (black)", size=20, mode="white")
def tophat(z, size, mode):
    """What an opening (white) or closing (black) over a disc takes away."""
    residual = z - opened(z, disk(size)) if mode == "white" else closed(z, disk(size)) - z
    return z - residual, residual


@register("polynomial", "core", "regional slope", "everything but a low-order surface", degree=2)
def polynomial(z, degree):
    """Least-squares surface of degree 1, 2 or (any other value) 3."""
    y, x = (a.ravel().astype(float) for a in np.mgrid[: z.shape[1], : z.shape[2]])
    top = degree if degree in (1, 2) else 3
    design = np.stack([x**i * y**j for total in range(top + 1) for i, j in [(total - k, k) for k in range(total + 1)]], axis=1)
    # One product per patch, so a patch's values don't depend on which others share its stack.
    fit = np.linalg.pinv(design) @ z.reshape(len(z), -1, 1)
    return split(z, (design @ fit).reshape(z.shape))


@register("gaussian_anisotropic", "classical", "forms along one axis", "detail across it", {"sigma_x": [2, 5, 10, 20, 50], "sigma_y": [2, 5, 10, 20, 50]}, sigma_x=10, sigma_y=10)
def gaussian_anisotropic(z, sigma_x, sigma_y):
    """Gaussian low-pass with a width per axis."""
    return split(z, linear.gaussian(z, sigma_y, sigma_x))


@register("median", "edge_preserving", "edges", "impulses", {"size": [3, 5, 7, 11, 15, 21]}, size=5)
def median(z, size):
    """Median over a square."""
    rows, columns = np.arange(z.shape[1]), np.arange(z.shape[2])
    near = [z[:, linear.index_map(rows + dy, len(rows), "reflect")][:, :, linear.index_map(columns + dx, len(columns), "reflect")] for dy, dx in square(size)]
    return split(z, np.partition(np.stack(near), len(near) // 2, axis=0)[len(near) // 2])


@register("uniform", "classical", "local means", "detail under the box", {"size": [3, 5, 10, 20, 50, 100]}, size=10)
def uniform(z, size):
    """Mean over a square."""
    return split(z, linear.uniform(z, size))


@register("dog", "multiscale", "all but one band of scales", "that band", {"sigma_low": [1, 2, 3, 5], "sigma_high": [5, 10, 20, 50, 100]}, sigma_low=2, sigma_high=10)
def dog(z, sigma_low, sigma_high):
    """Residual is a difference of Gaussians, edges clamped."""
    high = sigma_high if sigma_high > sigma_low else 2 * sigma_low
    residual = linear.gaussian(z, sigma_low, sigma_low, "nearest") - linear.gaussian(z, high, high, "nearest")
    return z - residual, residual


@register("log", "multiscale", "flat areas", "blobs of about sigma", {"sigma": [1, 2, 3, 5, 10, 20]}, sigma=5)
def log(z, sigma):
    """Residual is the scale-normalised Laplacian of a Gaussian."""
    residual = linear.laplace(linear.gaussian(z, sigma, sigma)) * sigma**2
    return z - residual, residual


@register("morphological_square", "morphological", "large forms", "small peaks or pits", {"operation": ["opening", "closing", "average"], "size": [3, 5, 10, 15, 20, 50]}, operation="opening", size=10)
def morphological_square(z, operation, size):
    """Opening, closing or their mean over a square."""
    return morphology(z, operation, square(size))


@register("morphological_diamond", "morphological", "large forms", "small peaks or pits", {"operation": ["opening", "closing", "average"], "radius": [3, 5, 10, 15, 20]}, operation="opening", radius=10)
def morphological_diamond(z, operation, radius):
    """Opening, closing or their mean over a diamond."""
    return morphology(z, operation, diamond(radius))


@register("morphological_gradient", "morphological", "flat areas", "edges", {"size": [3, 5, 7, 10, 15], "shape": ["disk", "square", "diamond"]}, size=5, shape="disk")
def morphological_gradient(z, size, shape):
    """Residual is dilation less erosion."""
    offsets = {"disk": disk, "square": square}.get(shape, diamond)(size)
    residual = extreme(z, offsets, True) - extreme(z, offsets, False)
    return z - residual, residual


@register("tophat_combined", "morphological", "background", "small peaks and pits", {"size": [5, 10, 20, 50, 100]}, size=20)
def tophat_combined(z, size):
    """Residual is the white top-hat less the black one."""
    residual = (z - opened(z, disk(size))) - (closed(z, disk(size)) - z)
    return z - residual, residual


@register("anisotropic_diffusion", "edge_preserving", "edges steeper than kappa", "gentler texture", {"iterations": [5, 10, 20, 50], "kappa": [10, 30, 50, 100], "gamma": [0.05, 0.1, 0.15, 0.2]}, iterations=10, kappa=50, gamma=0.1)
def anisotropic_diffusion(z, iterations, kappa, gamma):
    """Diffusion that slows down at edges, on a periodic grid."""
    v = z.copy()
    for _ in range(int(iterations)):
        flow = np.zeros_like(v)
        for axis, by in ((1, -1), (1, 1), (2, -1), (2, 1)):
            d = np.roll(v, by, axis=axis) - v
            flow += d * np.exp(-((d / kappa) ** 2))
        v = v + gamma * flow
    return split(z, v)


@register("guided", "edge_preserving", "edges", "low-contrast texture", {"radius": [4, 8, 16, 32], "eps": [0.001, 0.01, 0.1, 1.0]}, radius=8, eps=0.01)
def guided(z, radius, eps):
    """Local linear model of the patch on itself (values scaled to 0..1)."""
    v, low, span = scaled(z, 1.0)
    box = lambda a: linear.uniform(a, 2 * radius + 1)
    mean = box(v)
    var = box(v * v) - mean * mean
    slope = var / (var + eps)
    return split(z, (box(slope) * v + box(mean - slope * mean)) * span + low)


@register("rolling_ball", "morphological", "forms under the ball's radius", "background curvature", {"radius": [10, 25, 50, 100, 200]}, radius=50)
def rolling_ball(z, radius):
    """Erosion then dilation by a bowl over the whole square around its disc; the centre has height 0 and is left out."""
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    inside = np.maximum(radius**2 - x * x - y * y, 0)
    bowl = radius - np.sqrt(inside)
    keep = bowl > 0
    offsets = list(zip(y[keep].tolist(), x[keep].tolist(), strict=True))
    height = bowl[keep]
    return split(z, extreme(extreme(z, offsets, False, height), offsets, True, height))


@register("wavelet_biorthogonal", "wavelet", "coarse scales", "fine scales", {"wavelet": ["bior1.3", "bior2.4", "bior3.5", "bior4.4"], "level": [1, 2, 3, 4, 5]}, wavelet="bior3.5", level=3)
def wavelet_biorthogonal(z, wavelet, level):
    """Approximation of a biorthogonal wavelet transform."""
    return wavelet_split(z, wavelet, level)
