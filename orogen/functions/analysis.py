"""Statistics of patches: the six-value summary and the twenty-value rich vector."""

from __future__ import annotations

import numpy as np

from . import linear

#: Fixed order of the rich vector.
RICH = ("mean", "std", "range", "median", "skewness", "kurtosis", "energy", "entropy", "spatial_autocorr", "linear_feature_count", "max_linear_strength", "mean_linear_strength", "low_freq_energy", "mid_freq_energy", "high_freq_energy", "freq_ratio_high_low", "feature_snr", "min", "max", "reserved")
SIX = ("mean", "std", "energy", "entropy", "range", "median")


def entropy(flat: np.ndarray, bins: int = 50) -> np.ndarray:
    """Shannon entropy (nats) of each row's histogram density, 1e-10 added to every bin.

    All rows are counted at once, with the edges and the rounding of ``np.histogram``.
    """
    low, high = flat.min(axis=1, keepdims=True), flat.max(axis=1, keepdims=True)
    low, high = np.where(low == high, low - 0.5, low), np.where(low == high, high + 0.5, high)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.arange(bins + 1.0) * ((high - low) / bins) + low
    bounds[:, -1:] = high
    if not (bounds[:, :-1] < bounds[:, 1:]).all():
        raise ValueError(f"a range is too narrow or too wide for {bins} bins")
    at = np.minimum(((flat - low) / (high - low) * bins).astype(np.intp), bins - 1)
    at -= flat < np.take_along_axis(bounds, at, axis=1)
    at += (flat >= np.take_along_axis(bounds, at + 1, axis=1)) & (at != bins - 1)
    counts = np.bincount((at + bins * np.arange(len(flat))[:, None]).ravel(), minlength=bins * len(flat)).reshape(-1, bins)
    density = counts / np.diff(bounds, axis=1) / flat.shape[1] + 1e-10
    p = density / density.sum(axis=1, keepdims=True)
    return -(p * np.log(p)).sum(axis=1)


def six_stats(z: np.ndarray) -> np.ndarray:
    """Mean, standard deviation, energy, entropy, range and median; zeros where all is missing, gaps count as 0."""
    flat = z.reshape(len(z), -1)
    if flat.shape[1] == 0:
        return np.zeros((len(z), 6))
    void = np.isnan(flat).all(axis=1)
    flat = np.nan_to_num(flat)
    out = np.stack([flat.mean(axis=1), flat.std(axis=1), (flat * flat).mean(axis=1), entropy(flat), flat.max(axis=1) - flat.min(axis=1), np.median(flat, axis=1)], axis=1)
    out[void] = 0.0
    return out


def autocorrelation(z: np.ndarray) -> np.ndarray:
    """Correlation of each cell with the mean of its four neighbours, edges repeated; 0 for a constant patch."""
    near = sum(linear.filter_matrix(z.shape[1], np.array([1.0]), d) @ z for d in (-1, 1)) + sum(z @ linear.filter_matrix(z.shape[2], np.array([1.0]), d).T for d in (-1, 1))
    near = near / 4
    c, lag = z - z.mean(axis=(1, 2), keepdims=True), near - near.mean(axis=(1, 2), keepdims=True)
    below = (c * c).sum(axis=(1, 2))
    return np.divide((c * lag).sum(axis=(1, 2)), below, out=np.zeros(len(z)), where=below > 0)


def moments(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Biased skewness and excess kurtosis; 0 for ten values or fewer, not a number for constant rows."""
    if flat.shape[1] <= 10:
        return np.zeros(len(flat)), np.zeros(len(flat))
    c = flat - flat.mean(axis=1, keepdims=True)
    m2 = (c * c).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (c**3).mean(axis=1) / m2**1.5, (c**4).mean(axis=1) / m2**2 - 3


def bands(z: np.ndarray) -> np.ndarray:
    """Mean spectral magnitude in three rings around frequency 0, and the ratio of the outer to the inner."""
    magnitude = np.abs(np.fft.fftshift(np.fft.fft2(z), axes=(1, 2)))
    cy, cx = z.shape[1] // 2, z.shape[2] // 2
    y, x = np.mgrid[: z.shape[1], : z.shape[2]]
    r, top = np.hypot(y - cy, x - cx), min(cy, cx)
    rings = (r < top * 0.2, (r >= top * 0.2) & (r < top * 0.6), r >= top * 0.6)
    low, mid, high = (magnitude[:, ring].mean(axis=1) if ring.any() else np.zeros(len(z)) for ring in rings)
    return np.stack([low, mid, high, high / (low + 1e-10)], axis=1)


def signal_to_noise(flat: np.ndarray, percentile: float = 95) -> np.ndarray:
    """Spread of the values of largest magnitude over that of the rest."""
    out, size = np.zeros(len(flat)), np.abs(flat)
    big = size >= np.percentile(size, percentile, axis=1)[:, None]
    count = big.sum(axis=1)
    for n in np.unique(count[(count > 0) & (count < flat.shape[1])]):  # rows that split alike are one array
        own = np.flatnonzero(count == n)
        large, rest = flat[own][big[own]].reshape(len(own), -1), flat[own][~big[own]].reshape(len(own), -1)
        np.divide(large.std(axis=1), below := rest.std(axis=1), out=(ratio := np.zeros(len(own))), where=below > 0)
        out[own] = ratio
    return out


def edges(z: np.ndarray, sigma: float = 2.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Thin edges of each grid of a stack: smoothed gradient, ridge thinning along it, and growth from strong to weak edges."""
    pad = np.pad(linear.gaussian(z, sigma, sigma), ((0, 0), (1, 1), (1, 1)), mode="edge")
    # 3x3 smoothed differences
    column = pad[:, :, :-2] + 2 * pad[:, :, 1:-1] + pad[:, :, 2:]
    row = pad[:, :-2] + 2 * pad[:, 1:-1] + pad[:, 2:]
    gy, gx = (column[:, 2:] - column[:, :-2]) / 4, (row[:, :, 2:] - row[:, :, :-2]) / 4
    m = np.hypot(gy, gx)
    _, h, w = m.shape
    ay, ax = np.abs(gy), np.abs(gx)
    strong = np.zeros(m.shape, bool)
    live = np.flatnonzero((m >= high).any(axis=(1, 2)))  # without a strong cell no edge can grow
    m, ay, ax, same = m[live], ay[live], ax[live], (gy * gx >= 0)[live]
    wide = np.pad(m, ((0, 0), (1, 1), (1, 1)))
    at = lambda dy, dx: wide[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    t = np.divide(np.minimum(ay, ax), np.maximum(ay, ax), out=np.zeros_like(m), where=np.maximum(ay, ax) > 0)
    keep = np.zeros(m.shape, bool)
    for steep in (True, False):
        for positive in (True, False):
            sector = ((ay >= ax) == steep) & (same == positive)
            sx = 1 if positive else -1
            ahead = at(1, 0) * (1 - t) + at(1, sx) * t if steep else at(0, sx) * (1 - t) + at(1, sx) * t
            behind = at(-1, 0) * (1 - t) + at(-1, -sx) * t if steep else at(0, -sx) * (1 - t) + at(-1, -sx) * t
            keep |= sector & (m >= ahead) & (m >= behind)
    keep[:, [0, -1]] = False
    keep[:, :, [0, -1]] = False
    weak, own = keep & (m >= low), keep & (m >= high)
    while True:
        grown = np.pad(own, ((0, 0), (1, 1), (1, 1)))
        near = np.zeros_like(own)
        for dy in range(3):
            for dx in range(3):
                near |= grown[:, dy : dy + h, dx : dx + w]
        near &= weak
        if (near == own).all():
            strong[live] = own
            return strong
        own = near


#: Numbers of the accumulators that are held at once.
_VOTES = 2_000_000


def lines(z: np.ndarray, peaks: int = 20, apart: int = 9, turn: int = 10) -> np.ndarray:
    """Number, strongest and mean strength of straight lines among the edges of each grid of a stack (Hough accumulator
    peaks); zeros for a grid without."""
    v = z - z.min(axis=(1, 2), keepdims=True)
    top = v.max(axis=(1, 2), keepdims=True)
    found = edges(np.divide(v, top, out=v.copy(), where=top > 0))
    out = np.zeros((len(z), 3))
    live = np.flatnonzero(found.any(axis=(1, 2)))
    reach = int(np.ceil(np.hypot(*z.shape[1:])))
    held = 2 * (reach + apart) + 1
    strip = max(1, _VOTES // (held * 180))
    for lo in range(0, len(live), strip):
        out[live[lo : lo + strip]] = _peaks(found[live[lo : lo + strip]], reach, peaks, apart, turn)
    return out


def _peaks(found: np.ndarray, reach: int, peaks: int, apart: int, turn: int) -> np.ndarray:
    """``lines`` of grids of edges, each of which has some. Accumulators have ``apart`` distances more at both ends, which
    get no votes."""
    n, height = len(found), 2 * (reach + apart) + 1
    angle = np.linspace(-np.pi / 2, np.pi / 2, 180, endpoint=False)
    g, y, x = np.nonzero(found)
    rho = np.round(x[:, None] * np.cos(angle) + y[:, None] * np.sin(angle)).astype(int) + reach + apart
    votes = np.bincount(((g[:, None] * height + rho) * 180 + np.arange(180)).ravel(), minlength=n * height * 180).reshape(n, height * 180).astype(np.int32)
    floor = 0.5 * votes.max(axis=1)
    strengths = np.zeros((n, peaks))
    count = np.zeros(n, int)
    steps, around = np.arange(-turn, turn + 1), np.arange(-apart, apart + 1)
    own = np.arange(n)
    for k in range(peaks):
        place = votes[own].argmax(axis=1)
        best = votes[own, place]
        going = best > floor[own]
        own, place = own[going], place[going]
        if not len(own):
            break
        strengths[own, k], count[own] = best[going], k + 1
        d, a = place[:, None] // 180, place[:, None] % 180 + steps
        flip = (a < 0) | (a >= 180)
        c = np.where(flip, height - 1 - d, d)  # a line turned past the end comes back with its distance negated
        cells = (c[:, :, None] + around) * 180 + (a % 180)[:, :, None]
        votes[own[:, None], cells.reshape(len(own), -1)] = 0
    return np.stack([count, strengths.max(axis=1), strengths.sum(axis=1) / count], axis=1)


def rich(z: np.ndarray, include_linear: bool = True, include_frequency: bool = True) -> np.ndarray:
    """Twenty values per patch, gaps as 0; values that are not finite become 0."""
    z = np.nan_to_num(z)
    flat = z.reshape(len(z), -1)
    skew, kurt = moments(flat)
    line = lines(z) if include_linear else np.zeros((len(z), 3))
    band = bands(z) if include_frequency else np.zeros((len(z), 4))
    columns = [flat.mean(axis=1), flat.std(axis=1), flat.max(axis=1) - flat.min(axis=1), np.median(flat, axis=1), skew, kurt, (flat * flat).mean(axis=1), entropy(flat), autocorrelation(z), *line.T, *band.T, signal_to_noise(flat), flat.min(axis=1), flat.max(axis=1), np.zeros(len(z))]
    out = np.stack(columns, axis=1)
    return np.where(np.isfinite(out), out, 0.0)
