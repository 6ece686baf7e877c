"""Reaction-diffusion patterns seeded by a patch."""

from __future__ import annotations

import numpy as np


def seeded(z: np.ndarray) -> np.ndarray:
    """Patches scaled to 0..0.5 (0.25 where constant), values that are not finite as 0, in single precision."""
    v = np.nan_to_num(np.asarray(z, np.float32), nan=0.0, posinf=0.0, neginf=0.0)
    low = v.min(axis=(-2, -1), keepdims=True)
    span = v.max(axis=(-2, -1), keepdims=True) - low
    return np.where(span > 0, (v - low) / np.where(span > 0, span, 1) * np.float32(0.5), np.float32(0.25)).astype(np.float32)


def gray_scott(z: np.ndarray, n_iter: int = 50, du: float = 0.16, dv: float = 0.08, feed: float = 0.035, kill: float = 0.060, dt: float = 1.0) -> np.ndarray:
    """Second species after ``n_iter`` steps on a periodic grid; none returns the seed."""
    if z.ndim not in (2, 3):
        raise ValueError("a grid or a stack of grids is needed")
    v = seeded(z)
    u = (1 - v).astype(np.float32)
    spread = lambda a: sum(np.roll(a, s, axis=x) for x in (-2, -1) for s in (-1, 1)) - 4 * a
    du, dv, feed, kill, dt = (np.float32(x) for x in (du, dv, feed, kill, dt))
    for _ in range(int(n_iter)):
        both = u * v * v
        u, v = u + dt * (du * spread(u) - both + feed * (1 - u)), v + dt * (dv * spread(v) + both - (feed + kill) * v)
    return v
