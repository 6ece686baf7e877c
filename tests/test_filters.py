"""Decompositions and upsamplers as column expressions against the same methods on stacks of patches."""

import numpy as np
import pytest

from orogen.functions.registry import DECOMPOSITIONS, UPSAMPLERS
from orogen.operators import embed, filters  # noqa: F401  fills the registries

SMALL = {
    "gaussian": {"sigma": 2}, "morphological": {"size": 2, "operation": "average"}, "tophat": {"size": 2, "mode": "black"}, "gaussian_anisotropic": {"sigma_x": 1, "sigma_y": 2}, "uniform": {"size": 4},
    "dog": {"sigma_low": 1, "sigma_high": 2}, "log": {"sigma": 1.5}, "morphological_square": {"size": 3, "operation": "closing"}, "morphological_diamond": {"radius": 2}, "morphological_gradient": {"size": 2, "shape": "diamond"},
    "tophat_combined": {"size": 2}, "anisotropic_diffusion": {"iterations": 4, "kappa": 0.5}, "guided": {"radius": 2}, "rolling_ball": {"radius": 4}, "polynomial": {"degree": 3},
}


@pytest.fixture(scope="module")
def stack(spark):
    z = np.random.default_rng(9).normal(size=(3, 9, 6)).cumsum(axis=1)
    z[1, 2, 3] = np.nan
    z[2] = 0.25
    table = spark.createDataFrame([(i, [float(v) for v in g.ravel()]) for i, g in enumerate(z)], "patch_id long, data array<double>")
    return z, table


def grid(found, column, shape):
    out = np.full(shape, np.nan)
    for r in found.collect():
        out[r["patch_id"], r["y"], r["x"]] = r[column]
    return out


def test_every_method_is_there():
    assert {*filters.TRENDS, *filters.RESIDUALS} == {*DECOMPOSITIONS} and {*filters.ZOOMS} == {*UPSAMPLERS}


@pytest.mark.parametrize("name", sorted({*filters.TRENDS, *filters.RESIDUALS}))
def test_decompositions(stack, name):
    z, table = stack
    found = filters.decompose(table, name, 9, 6, **SMALL.get(name, {}))
    trend, residual = DECOMPOSITIONS.run(name, z, **SMALL.get(name, {}))
    found.cache()
    assert np.allclose(grid(found, "trend", z.shape), trend, atol=1e-9)
    assert np.allclose(grid(found, "residual", z.shape), residual, atol=1e-9)
    found.unpersist()


@pytest.mark.parametrize("name", sorted(filters.ZOOMS))
def test_upsamplers(stack, name):
    z, table = stack
    out = UPSAMPLERS.run(name, z)
    assert np.allclose(grid(filters.upsample(table, name, 9, 6), "z", out.shape), out, atol=1e-9)


def test_a_bilateral_weight_is_worked_out_once(spark):
    """a weight stood in the total and in the sum of weights, and a neighbour in each of them several times."""
    from orogen.operators import filters

    rows = spark.createDataFrame([(0, [float(i % 7) for i in range(64)])], "patch_id long, data array<double>")
    plan = filters.decompose(rows, "bilateral", 8, 8)._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("EXP(") == 1
