"""Registries of numeric kernels by name; a registered kernel works on a stack of equal-sized patches.

A kernel takes ``(n, height, width)`` doubles without gaps and keyword parameters. Registering another kernel makes
it usable in every signature and query that takes a name. Categories, defaults and parameter ranges of the built-in
kernels are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np


@dataclass(frozen=True)
class Method:
    name: str
    func: Callable[..., Any]
    category: str
    default_params: dict[str, Any]
    param_ranges: dict[str, list] = field(default_factory=dict)
    preserves: str = ""
    changes: str = ""
    description: str = ""


class Registry(dict):
    """Methods by name, in order of registration."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def register(self, name: str, category: str, preserves: str = "", changes: str = "", ranges: dict | None = None, **defaults):
        def add(func):
            self[name] = Method(name, func, category, defaults, ranges or {}, preserves, changes, (func.__doc__ or "").strip().split("\n")[0])
            return func

        return add

    def named(self, name: str) -> Method:
        if name not in self:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(self)}")
        return self[name]

    def run(self, name: str, z: np.ndarray, **params):
        """Run a method on one grid or a stack of them, gaps filled with the mean of each; given parameters override
        the defaults."""
        z = np.asarray(z, float)
        method = self.named(name)
        out = method.func(fill(z if z.ndim == 3 else z[None]), **(method.default_params | params))
        if z.ndim == 3:
            return out
        return tuple(x[0] for x in out) if isinstance(out, tuple) else out[0]


def fill(z: np.ndarray) -> np.ndarray:
    """Gaps (NaN) take the mean of their patch's other cells; a patch of gaps alone becomes zeros."""
    gap = np.isnan(z)
    if not gap.any():
        return z
    count = (~gap).sum(axis=(1, 2), keepdims=True)
    mean = np.where(gap, 0.0, z).sum(axis=(1, 2), keepdims=True) / np.maximum(count, 1)
    return np.where(gap, mean, z)


DECOMPOSITIONS = Registry("decomposition")
UPSAMPLERS = Registry("upsampler")
TERRAIN = Registry("terrain feature")
TEXTURE = Registry("texture feature")
#: Fixed: the decompositions that a plain decomposition signature may use.
CORE = ("gaussian", "bilateral", "wavelet_dwt", "morphological", "tophat", "polynomial")
