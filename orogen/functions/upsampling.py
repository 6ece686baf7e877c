"""Upsamplers of patches: ``(n, h, w)`` to ``(n, h * scale, w * scale)``."""

from __future__ import annotations

import numpy as np

from . import linear
from .registry import UPSAMPLERS as METHODS

register = METHODS.register


def spline(order: int):
    def run(z, scale):
        return linear.zoom(z, scale, order)

    run.__doc__ = f"Spline interpolation of order {order}, corners aligned."
    return run


register("bicubic", "interpolation", "smooth surfaces", "slight overshoot", {"scale": [2, 4, 8]}, scale=2)(spline(3))


@register("lanczos", "interpolation", "sharp detail", "ringing", {"scale": [2, 4, 8]}, scale=2)
def lanczos(z, scale):
    """Eight-tap Lanczos resampling in single precision, pixel centres aligned."""
    rows, columns = (linear.lanczos_matrix(n, int(scale)) for n in z.shape[1:])
    return linear.both(z.astype(np.float32).astype(float), rows, columns)


register("bspline", "spline", "smooth surfaces", "slight overshoot", {"scale": [2, 4, 8]}, scale=2)(spline(2))


@register("fft_zeropad", "frequency", "band-limited signal", "ringing at edges", {"scale": [2, 4, 8]}, scale=2)
def fft_zeropad(z, scale):
    """Zero-padding of the spectrum; the middle frequency of an even axis goes to the negative side."""
    n, h, w = z.shape
    spectrum, out = np.fft.fft2(z), np.zeros((n, h * scale, w * scale), complex)
    rows = np.concatenate([np.arange((h + 1) // 2), h * scale - h + np.arange((h + 1) // 2, h)])
    columns = np.concatenate([np.arange((w + 1) // 2), w * scale - w + np.arange((w + 1) // 2, w)])
    out[:, rows[:, None], columns[None, :]] = spectrum
    return np.fft.ifft2(out).real * scale**2


register("nearest", "interpolation", "values", "blocks", {"scale": [2, 4, 8]}, scale=2)(spline(0))
register("bilinear", "interpolation", "range of values", "creases", {"scale": [2, 4, 8]}, scale=2)(spline(1))
register("quadratic", "interpolation", "smooth surfaces", "slight overshoot", {"scale": [2, 4, 8]}, scale=2)(spline(2))
register("quartic", "interpolation", "smooth surfaces", "overshoot", {"scale": [2, 4, 8]}, scale=2)(spline(4))
register("quintic", "interpolation", "smooth surfaces", "overshoot", {"scale": [2, 4, 8]}, scale=2)(spline(5))


def stuffed(z, scale, kernel):
    return linear.both(z, *(linear.stuffed_matrix(n, int(scale), kernel) for n in z.shape[1:]))


@register("sinc_hamming", "frequency", "band-limited signal", "little ringing", {"scale": [2, 4, 8], "kernel_size": [4, 8, 16]}, scale=2, kernel_size=8)
def sinc_hamming(z, scale, kernel_size):
    """Windowed sinc over a zero-stuffed grid, Hamming window."""
    return stuffed(z, scale, np.sinc(np.arange(-kernel_size, kernel_size + 1) / scale) * np.hamming(2 * kernel_size + 1))


@register("sinc_blackman", "frequency", "band-limited signal", "slight blur", {"scale": [2, 4, 8], "kernel_size": [4, 8, 16]}, scale=2, kernel_size=8)
def sinc_blackman(z, scale, kernel_size):
    """Windowed sinc over a zero-stuffed grid, Blackman window."""
    return stuffed(z, scale, np.sinc(np.arange(-kernel_size, kernel_size + 1) / scale) * np.blackman(2 * kernel_size + 1))


@register("cubic_catmull_rom", "interpolation", "control points", "little overshoot", {"scale": [2, 4, 8]}, scale=2)
def cubic_catmull_rom(z, scale):
    """Interpolating bicubic spline with not-a-knot ends; needs four samples per axis."""
    return linear.both(z, *(linear.not_a_knot_matrix(n, int(n * scale)) for n in z.shape[1:]))


@register("cubic_mitchell", "interpolation", "balance of sharp and smooth", "few artefacts", {"scale": [2, 4, 8]}, scale=2)
def cubic_mitchell(z, scale):
    """Piecewise cubic with both parameters 1/3 over a zero-stuffed grid."""
    t = np.abs(np.arange(-4 * scale, 4 * scale + 1) / scale)
    near = (7 * t**3 - 12 * t**2 + 16 / 3) / 6
    far = (-7 / 3 * t**3 + 12 * t**2 - 20 * t + 32 / 3) / 6
    return stuffed(z, scale, np.where(t < 1, near, np.where(t < 2, far, 0.0)))


@register("edge_directed", "adaptive", "edges", "artefacts in texture", {"scale": [2, 4]}, scale=2)
def edge_directed(z, scale):
    """Bicubic in flat areas, Lanczos where the gradient is steep."""
    dy, dx = (linear.zoom(g, scale, 1) for g in np.gradient(z, axis=(1, 2)))
    steep = np.hypot(dx, dy)
    share = steep / (steep.max(axis=(1, 2), keepdims=True) + 1e-10)
    return linear.zoom(z, scale, 3) * (1 - share) + lanczos(z, scale) * share


@register("regularized", "optimization", "smooth surfaces", "slight sharpening between samples", {"scale": [2, 4], "lambda_reg": [0.001, 0.01, 0.1]}, scale=2, lambda_reg=0.01)
def regularized(z, scale, lambda_reg):
    """Ten steps against the Laplacian from a bicubic start, known samples held."""
    v = linear.zoom(z, scale, 3)
    for _ in range(10):
        v = v - lambda_reg * linear.laplace(v)
        v[:, ::scale, ::scale] = z
    return v
