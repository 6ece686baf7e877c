"""Terrain derivatives: a grid per patch, and six statistics of each."""

from __future__ import annotations

import numpy as np

from . import linear
from .registry import TERRAIN as METHODS

register = METHODS.register


@register("slope", "gradient", cell_size=1.0)
def slope(z, cell_size):
    """Steepest slope in degrees."""
    dy, dx = np.gradient(z, cell_size, axis=(1, 2))
    return np.degrees(np.arctan(np.hypot(dx, dy)))


@register("aspect", "gradient", cell_size=1.0)
def aspect(z, cell_size):
    """Direction of the slope in degrees; -1 where flat."""
    dy, dx = np.gradient(z, cell_size, axis=(1, 2))
    out = (np.degrees(np.arctan2(-dx, dy)) + 360) % 360
    return np.where((np.abs(dx) < 1e-8) & (np.abs(dy) < 1e-8), -1.0, out)


@register("curvature", "gradient", cell_size=1.0)
def curvature(z, cell_size):
    """Negative sum of the repeated gradients along each axis."""
    return -sum(np.gradient(np.gradient(z, cell_size, axis=a), cell_size, axis=a) for a in (1, 2))


@register("tpi", "neighbourhood", radius=10)
def tpi(z, radius):
    """Height over the mean of a square."""
    return z - linear.uniform(z, 2 * int(radius) + 1)


def around(z: np.ndarray, size: int):
    rows, columns = np.arange(z.shape[1]), np.arange(z.shape[2])
    for dy in range(-(size // 2), size - size // 2):
        for dx in range(-(size // 2), size - size // 2):
            yield z[:, linear.index_map(rows + dy, len(rows), "reflect")][:, :, linear.index_map(columns + dx, len(columns), "reflect")]


@register("tri", "neighbourhood", window_size=3)
def tri(z, window_size):
    """Mean absolute difference from a square's cells, the centre counted in."""
    return sum(np.abs(near - z) for near in around(z, int(window_size))) / window_size**2


@register("roughness", "neighbourhood", window_size=3)
def roughness(z, window_size):
    """Standard deviation within a square."""
    return np.sqrt(np.maximum(linear.uniform(z * z, int(window_size)) - linear.uniform(z, int(window_size)) ** 2, 0))


def stats(name: str, grid: np.ndarray) -> np.ndarray:
    """Six statistics per patch; those of aspect leave flat cells out unless all are."""
    from .analysis import six_stats

    if name != "aspect":
        return six_stats(grid)
    rows = [g[g >= 0] if (g >= 0).any() else g for g in grid.reshape(len(grid), -1)]
    return np.concatenate([six_stats(r[None, None, :]) for r in rows]) if rows else np.zeros((0, 6))
