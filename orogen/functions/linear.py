"""Linear filters along one axis as dense matrices, applied to both axes of a stack of patches.

A separable filter on patches of one size is two small matrix products, so smoothing, resampling and wavelets share
one code path: build the matrix once per size, multiply.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def index_map(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Where an index outside 0..n-1 reads: 'reflect' repeats the edge sample, 'mirror' does not, 'nearest' clamps."""
    if n == 1:
        return np.zeros_like(i)
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    if mode == "wrap":
        return i % n
    if mode == "reflect":
        j = i % (2 * n)
        return np.where(j < n, j, 2 * n - 1 - j)
    j = i % (2 * n - 2)
    return np.where(j < n, j, 2 * n - 2 - j)


def filter_matrix(n: int, weights: np.ndarray, first: int, mode: str = "reflect") -> np.ndarray:
    """``out[i] = sum_k weights[k] * in[i + first + k]``."""
    m = np.zeros((n, n))
    reads = index_map(np.arange(n)[:, None] + first + np.arange(len(weights)), n, mode)
    np.add.at(m, (np.repeat(np.arange(n), len(weights)), reads.ravel()), np.tile(weights, n))
    return m


@lru_cache(maxsize=256)
def gaussian_matrix(n: int, sigma: float, mode: str = "reflect") -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return filter_matrix(n, w / w.sum(), -radius, mode)


@lru_cache(maxsize=256)
def uniform_matrix(n: int, size: int) -> np.ndarray:
    return filter_matrix(n, np.full(size, 1.0 / size), -(size // 2))


@lru_cache(maxsize=16)
def laplace_matrix(n: int) -> np.ndarray:
    return filter_matrix(n, np.array([1.0, -2.0, 1.0]), -1)


def both(z: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return rows @ z @ columns.T


def gaussian(z: np.ndarray, sigma_y: float, sigma_x: float, mode: str = "reflect") -> np.ndarray:
    return both(z, gaussian_matrix(z.shape[1], float(sigma_y), mode), gaussian_matrix(z.shape[2], float(sigma_x), mode))


def uniform(z: np.ndarray, size: int) -> np.ndarray:
    return both(z, uniform_matrix(z.shape[1], int(size)), uniform_matrix(z.shape[2], int(size)))


def laplace(z: np.ndarray) -> np.ndarray:
    return laplace_matrix(z.shape[1]) @ z + z @ laplace_matrix(z.shape[2]).T


def b_spline(x: np.ndarray, order: int) -> np.ndarray:
    """Centred cardinal B-spline, by its two-term recurrence."""
    if order == 0:
        return np.where((x >= -0.5) & (x < 0.5), 1.0, 0.0)
    half = (order + 1) / 2
    return ((half + x) * b_spline(x + 0.5, order - 1) + (half - x) * b_spline(x - 0.5, order - 1)) / order


@lru_cache(maxsize=256)
def zoom_matrix(n: int, factor: float, order: int) -> np.ndarray:
    """Corner-aligned spline resampling to ``round(n * factor)`` samples."""
    out = int(round(n * factor))
    at = np.arange(out) * ((n - 1) / (out - 1) if out > 1 else 0.0)
    if order == 0:
        m = np.zeros((out, n))
        m[np.arange(out), np.clip(np.floor(at + 0.5).astype(int), 0, n - 1)] = 1.0
        return m
    knots = np.arange(-order - 1, n + order + 1)
    spread = np.zeros((len(knots), n))
    spread[np.arange(len(knots)), index_map(knots, n, "mirror")] = 1.0
    evaluate = lambda x: b_spline(x[:, None] - knots[None, :], order) @ spread
    m = evaluate(at.astype(float))
    return m if order == 1 else m @ np.linalg.inv(evaluate(np.arange(n, dtype=float)))


def zoom(z: np.ndarray, factor: float, order: int) -> np.ndarray:
    return both(z, zoom_matrix(z.shape[1], float(factor), order), zoom_matrix(z.shape[2], float(factor), order))


@lru_cache(maxsize=64)
def not_a_knot_matrix(n: int, out: int) -> np.ndarray:
    """Interpolating cubic spline with not-a-knot ends, sampled at ``out`` points from end to end; needs 4 samples."""
    if n < 4:
        raise ValueError("a cubic spline needs at least 4 samples per axis")
    knots = np.concatenate([np.zeros(4), np.arange(2, n - 2), np.full(4, n - 1.0)])

    def basis(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, n - 1)
        span = np.clip(np.searchsorted(knots, x, side="right") - 1, 3, n - 1)
        b = np.zeros((len(x), len(knots) - 1))
        b[np.arange(len(x)), span] = 1.0
        for d in range(1, 4):
            width = knots[d:] - knots[:-d]
            safe = np.where(width > 0, width, 1.0)
            up = np.where(width > 0, (x[:, None] - knots[:-d]) / safe, 0.0)
            left = up[:, : len(knots) - d - 1] * b[:, : len(knots) - d - 1]
            right = (1 - up)[:, 1:] * np.where(width > 0, 1.0, 0.0)[1:] * b[:, 1 : len(knots) - d]
            b = left + right
        return b

    return basis(np.linspace(0, n - 1, out)) @ np.linalg.inv(basis(np.arange(n, dtype=float)))


@lru_cache(maxsize=64)
def lanczos_matrix(n: int, scale: int) -> np.ndarray:
    """Eight-tap windowed sinc at half-pixel centres, edge samples repeated."""
    out = n * scale
    centre = (np.arange(out) + 0.5) / scale - 0.5
    base = np.floor(centre).astype(int)
    taps = np.arange(-3, 5)
    t = centre[:, None] - (base[:, None] + taps)
    w = np.sinc(t) * np.sinc(t / 4)
    w /= w.sum(axis=1, keepdims=True)
    m = np.zeros((out, n))
    np.add.at(m, (np.repeat(np.arange(out), 8), np.clip(base[:, None] + taps, 0, n - 1).ravel()), w.ravel())
    return m


def stuffed_matrix(n: int, scale: int, kernel: np.ndarray) -> np.ndarray:
    """Zero-stuff by ``scale``, then convolve with a symmetric kernel of sum ``scale``."""
    kernel = kernel / kernel.sum() * scale
    return filter_matrix(n * scale, kernel[::-1], -(len(kernel) // 2))[:, ::scale]


#: Fixed filter taps (low-pass for analysis, low-pass for synthesis).
WAVELETS: dict[str, tuple[list[float], list[float]]] = {
    "db4": (
        [-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523],
        [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
    ),
    "bior3.5": (
        [-0.013810679320049757, 0.04143203796014927, 0.052480581416189075, -0.26792717880896527, -0.07181553246425874, 0.966747552403483, 0.966747552403483, -0.07181553246425874, -0.26792717880896527, 0.052480581416189075, 0.04143203796014927, -0.013810679320049757],
        [0.0, 0.0, 0.0, 0.0, 0.17677669529663687, 0.5303300858899106, 0.5303300858899106, 0.17677669529663687, 0.0, 0.0, 0.0, 0.0],
    ),
}


@lru_cache(maxsize=64)
def wavelet_trend_matrix(n: int, wavelet: str, level: int) -> np.ndarray:
    """Analysis over ``level`` levels with symmetric ends, and synthesis from the approximation alone."""
    if wavelet not in WAVELETS:
        raise ValueError(f"unknown wavelet {wavelet!r}; known: {', '.join(WAVELETS)}")
    low, back = (np.array(x) for x in WAVELETS[wavelet])
    taps, sizes, down = len(low), [n], np.eye(n)
    for _ in range(level):
        size = sizes[-1]
        half = (size + taps - 1) // 2
        step = np.zeros((half, size))
        reads = index_map(2 * np.arange(half)[:, None] + 1 - np.arange(taps), size, "reflect")
        np.add.at(step, (np.repeat(np.arange(half), taps), reads.ravel()), np.tile(low, half))
        down = step @ down
        sizes.append(half)
    for size in sizes[-2::-1]:
        half = down.shape[0]
        step = np.zeros((2 * half - taps + 2, half))
        for k in range(half):
            for j in range(taps):
                at = 2 * k - taps + 2 + j
                if 0 <= at < len(step):
                    step[at, k] += back[j]
        down = (step @ down)[:size]
    return down
