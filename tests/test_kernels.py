"""Properties of the numeric kernels."""

import numpy as np
import pytest

from orogen.functions import analysis, linear, spectral, terrain, texture, turing
from orogen.functions import decomposition as dec
from orogen.functions import upsampling as up
from orogen.functions.registry import DECOMPOSITIONS, TERRAIN, TEXTURE, UPSAMPLERS, fill

RNG = np.random.default_rng(1)
Z = RNG.normal(size=(3, 24, 20)).cumsum(axis=1).cumsum(axis=2)
SMALL = {"morphological": {"size": 2}, "tophat": {"size": 3}, "tophat_combined": {"size": 3}, "rolling_ball": {"radius": 4}}


def test_every_method_is_there():
    assert (len(DECOMPOSITIONS), len(UPSAMPLERS), len(TERRAIN), len(TEXTURE)) == (19, 15, 6, 2)
    assert dec.METHODS is DECOMPOSITIONS and up.METHODS is UPSAMPLERS


@pytest.mark.parametrize("name", list(DECOMPOSITIONS))
def test_trend_and_residual_add_up(name):
    z = Z.copy()
    z[0, 3, 4] = np.nan
    trend, residual = DECOMPOSITIONS.run(name, z, **SMALL.get(name, {}))
    assert np.allclose(trend + residual, fill(z))
    flat = DECOMPOSITIONS.run(name, np.full((1, 12, 12), 5.0), **SMALL.get(name, {}))[1]
    assert np.abs(flat).max() < 1e-9


@pytest.mark.parametrize("name", list(UPSAMPLERS))
def test_upsampled_sizes(name):
    assert UPSAMPLERS.run(name, Z).shape == (3, 48, 40)
    assert UPSAMPLERS.run(name, Z[0]).shape == (48, 40)


def test_morphology_orders():
    offsets = dec.disk(2)
    opened, closed = dec.opened(Z, offsets), dec.closed(Z, offsets)
    assert (opened <= Z + 1e-12).all() and (closed >= Z - 1e-12).all()
    assert np.allclose(dec.opened(opened, offsets), opened)


def test_polynomial_residual_is_orthogonal():
    residual = DECOMPOSITIONS.run("polynomial", Z, degree=2)[1]
    y, x = np.mgrid[:24, :20]
    for basis in (np.ones_like(y), x, y, x * x, x * y, y * y):
        assert np.abs((residual * basis).sum(axis=(1, 2))).max() < 1e-5 * np.abs(Z).max() * basis.max() * 480


def test_splines_interpolate():
    for order in (2, 3, 4, 5):
        assert np.allclose(linear.zoom_matrix(9, 1.0, order), np.eye(9))
    cubic = np.arange(9.0) ** 3
    assert np.allclose(linear.not_a_knot_matrix(9, 17) @ cubic, np.linspace(0, 8, 17) ** 3)
    assert np.allclose(UPSAMPLERS.run("regularized", Z)[:, ::2, ::2], Z)


def test_fft_zeropad_keeps_samples():
    assert np.allclose(UPSAMPLERS.run("fft_zeropad", Z[:, :23, :19])[:, ::2, ::2], Z[:, :23, :19])


@pytest.mark.parametrize("wavelet", list(linear.WAVELETS))
def test_wavelets_keep_low_order_surfaces(wavelet):
    inner = slice(24, 40)
    line = np.arange(64.0)
    assert np.allclose((linear.wavelet_trend_matrix(64, wavelet, 1) @ line)[inner], line[inner])


def test_terrain():
    y, x = np.mgrid[:12, :12].astype(float)
    assert np.allclose(TERRAIN.run("slope", x), 45)
    assert np.allclose(TERRAIN.run("aspect", np.zeros((5, 5))), -1)
    assert np.allclose(TERRAIN.run("curvature", x * x + y * y)[3:-3, 3:-3], -4)
    assert (TERRAIN.run("roughness", Z) >= 0).all()
    assert terrain.stats("aspect", TERRAIN.run("aspect", Z)).shape == (3, 6)


def test_texture():
    checker = np.indices((8, 8)).sum(axis=0)[None] % 2
    props = TEXTURE.run("glcm", checker, distances=(1,), angles=(0,), levels=2)[0]
    assert np.allclose(props, [1, 1, 0.5, np.sqrt(0.5), -1, 0.5])
    assert np.isclose(TEXTURE.run("lbp", Z)[:, :6].sum(axis=1) <= 1.0001, True).all()
    assert texture.quantize(np.full((1, 3, 3), 2.0), 64).max() == 0


def test_statistics():
    assert np.allclose(analysis.six_stats(np.full((1, 4, 4), np.nan)), 0)
    assert analysis.rich(Z).shape == (3, 20) and np.isfinite(analysis.rich(np.ones((1, 16, 16)))).all()
    assert abs(analysis.six_stats(np.ones((1, 8, 8)))[0, 3]) < 1e-6
    line = np.zeros((1, 64, 64))
    line[0, :, 32:] = 1
    assert analysis.rich(line)[0, 9] >= 1  # a straight edge is found


def test_spectrum_and_pattern():
    assert spectral.directional(Z).shape == (3, 24)
    y, x = spectral.slice_cells(64, 64, 45)
    assert len(y) == 62 and (y[31:34] - 32).tolist() == [0, 1, 2]
    seed = turing.gray_scott(Z, 0)
    assert seed.min() >= 0 and seed.max() <= 0.5
    with pytest.raises(ValueError):
        turing.gray_scott(np.zeros(4))
