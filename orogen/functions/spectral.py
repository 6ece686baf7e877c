"""Directional spectra: statistics along lines through the centre of the windowed spectrum."""

from __future__ import annotations

import numpy as np

STATS = ("energy", "low", "high", "peak", "centroid", "spread")


def magnitude(z: np.ndarray) -> np.ndarray:
    """Centred spectral magnitude under a Hann window."""
    window = np.outer(np.hanning(z.shape[1]), np.hanning(z.shape[2]))
    return np.abs(np.fft.fftshift(np.fft.fft2(z * window), axes=(1, 2)))


def slice_cells(h: int, w: int, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a line through the centre, outermost negative frequency first, the centre left out; offsets are cut
    towards zero and held inside the grid."""
    top = min(h // 2, w // 2)
    r = np.arange(1, top)
    dy, dx = np.trunc(r * np.sin(np.radians(angle))).astype(int), np.trunc(r * np.cos(np.radians(angle))).astype(int)
    y = np.concatenate([(h // 2 - dy)[::-1], h // 2 + dy])
    x = np.concatenate([(w // 2 - dx)[::-1], w // 2 + dx])
    return np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)


def directional(z: np.ndarray, angles=(0.0, 45.0, 90.0, 135.0), stats=STATS) -> np.ndarray:
    """Per patch, each statistic of each angle's line, angle by angle.

    ``low`` and ``high`` are sums over the first third and from the second third of half the line's length on, and
    positions are divided by that half length; on a line that starts at a negative frequency this is how the
    features are defined, whatever their names say.
    """
    m = magnitude(z)
    out = []
    for angle in angles:
        y, x = slice_cells(*z.shape[1:], angle)
        v = m[:, y, x]
        n = v.shape[1] // 2
        power = v * v
        total = power.sum(axis=1)
        safe = np.where(total > 0, total, 1.0)
        i = np.arange(v.shape[1])
        centre = (i * power).sum(axis=1) / safe
        var = ((i - centre[:, None]) ** 2 * power).sum(axis=1) / safe
        found = {
            "energy": np.log1p(total),
            "low": v[:, : n // 3].sum(axis=1),
            "high": v[:, 2 * n // 3 :].sum(axis=1),
            "peak": v.argmax(axis=1) / max(n, 1) if n else np.zeros(len(z)),
            "centroid": np.where(total > 0, centre / max(n, 1), 0.0),
            "spread": np.where(total > 0, np.sqrt(np.maximum(var, 0)) / max(n, 1), 0.0),
        }
        out += [found[s] if n else np.zeros(len(z)) for s in stats]
    return np.stack(out, axis=1)


def labels(angles, stats) -> list[str]:
    return [f"fft_{int(a)}deg_{s}" for a in angles for s in stats]
