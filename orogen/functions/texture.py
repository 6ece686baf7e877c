"""Texture descriptors: co-occurrence properties and local binary patterns."""

from __future__ import annotations

import numpy as np

from .registry import TEXTURE as METHODS

register = METHODS.register

#: Fixed: names of the values of each descriptor.
NAMES = {
    "glcm": ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM"),
    "lbp": ("bin0", "bin1", "bin2", "bin3", "bin4", "bin5", "mean", "std", "entropy", "uniformity"),
}


def quantize(z: np.ndarray, levels: int) -> np.ndarray:
    """Patches scaled to whole levels, cut downwards; nearly constant ones become zeros."""
    low = z.min(axis=(1, 2), keepdims=True)
    span = z.max(axis=(1, 2), keepdims=True) - low
    flat = span < 1e-10
    return np.where(flat, 0, np.floor((z - low) / np.where(flat, 1.0, span) * (levels - 1))).astype(np.int64)


@register("glcm", "co-occurrence", distances=(1, 2, 4), angles=(0, 45, 90, 135), levels=64)
def glcm(z, distances, angles, levels):
    """Contrast, dissimilarity, homogeneity, energy, correlation and ASM, each the mean over distances and angles."""
    q = quantize(z, levels)
    n, h, w = q.shape
    total = np.zeros((n, 6))
    for d in distances:
        for a in np.radians(angles):
            dy, dx = int(round(np.sin(a) * d)), int(round(np.cos(a) * d))
            if abs(dy) >= h or abs(dx) >= w:  # beyond the patch: no pairs
                total[:, 4] += 1.0
                continue
            here = q[:, max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)].reshape(n, -1)
            there = q[:, max(dy, 0) : h - max(-dy, 0), max(dx, 0) : w - max(-dx, 0)].reshape(n, -1)
            i, j = np.concatenate([here, there], axis=1), np.concatenate([there, here], axis=1)
            diff = np.abs(i - j)
            cell = np.sort((np.arange(n)[:, None] * levels + i) * levels + j, axis=1).ravel()
            cell, count = np.unique(cell, return_counts=True)
            asm = np.bincount(cell // levels**2, (count / i.shape[1]) ** 2, n)
            mean = i.mean(axis=1, keepdims=True)
            var = ((i - mean) ** 2).mean(axis=1)
            cov = ((i - mean) * (j - mean)).mean(axis=1)
            same = var < 1e-15
            correlation = np.where(same, 1.0, cov / np.where(same, 1.0, var))
            total += np.stack([(diff**2).mean(axis=1), diff.mean(axis=1), (1 / (1 + diff**2)).mean(axis=1), np.sqrt(asm), correlation, asm], axis=1)
    return total / (len(distances) * len(angles))


def patterns(z: np.ndarray, radius: float, n_points: int, method: str) -> np.ndarray:
    """Binary pattern of each cell against points on a circle, bilinear between cells and 0 outside the patch."""
    q = quantize(z, 256).astype(float)
    n, h, w = q.shape
    pad = int(np.ceil(radius)) + 2
    wide = np.pad(q, ((0, 0), (pad, pad), (pad, pad)))
    bits = []
    for k in range(n_points):
        a = 2 * np.pi * k / n_points
        dy, dx = round(-radius * np.sin(a), 5), round(radius * np.cos(a), 5)
        fy, fx = int(np.floor(dy)), int(np.floor(dx))
        ty, tx = dy - fy, dx - fx
        at = lambda y, x: wide[:, pad + y : pad + y + h, pad + x : pad + x + w]
        top = at(fy, fx) * (1 - tx) + at(fy, fx + 1) * tx
        low = at(fy + 1, fx) * (1 - tx) + at(fy + 1, fx + 1) * tx
        bits.append(top * (1 - ty) + low * ty >= q)
    ring = np.stack(bits)
    if method != "uniform":
        return (ring * (2 ** np.arange(n_points, dtype=float))[:, None, None, None]).sum(axis=0)
    turns = (ring != np.roll(ring, -1, axis=0))[: n_points - 1].sum(axis=0) if n_points > 1 else 0
    return np.where(turns <= 2, ring.sum(axis=0), n_points + 1).astype(float)


@register("lbp", "pattern", radius=3, n_points=24, method="uniform")
def lbp(z, radius, n_points, method):
    """Ten statistics of the pattern histogram: its first six bins, mean, spread, entropy and sum of squares."""
    p = patterns(z, radius, n_points, method)
    bins = n_points + 2 if method == "uniform" else min(2**n_points, 256)
    out = []
    for one in p:
        count = np.histogram(one.ravel(), bins=bins, range=(0, bins))[0]
        density = count / max(count.sum(), 1)
        q = (density + 1e-10) / (density + 1e-10).sum()
        out.append([*np.pad(density, (0, max(6 - bins, 0)))[:6], density.mean(), density.std(), -(q * np.log(q)).sum(), (density**2).sum()])
    return np.array(out).reshape(-1, 10)
