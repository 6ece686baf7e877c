"""Surfaces, statistics and co-occurrence in the patch's row against kernels and plain loops; windows of any size."""

import numpy as np
import pytest

from orogen.functions import analysis, decomposition, spectral, terrain, texture  # noqa: F401  fills the registries
from orogen.functions.registry import DECOMPOSITIONS, TERRAIN, TEXTURE
from orogen.operators import filters, surfaces


@pytest.fixture(scope="module")
def stack(spark):
    z = np.random.default_rng(19).normal(size=(3, 12, 7)).cumsum(axis=1)
    z[2] = 1.5
    table = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in enumerate(z)], "patch_id long, data array<double>")
    return z, table


def reflected(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


@pytest.mark.parametrize(("name", "params"), [("slope", {"cell_size": 2.5}), ("aspect", {}), ("curvature", {}), ("tpi", {"radius": 10}), ("tri", {"window_size": 4}), ("roughness", {"window_size": 9})])
def test_surfaces(stack, name, params):
    z, table = stack
    found = surfaces.surface(table, name, 12, 7, **params)
    expected = TERRAIN.run(name, z, **params)
    rows = {r["patch_id"]: np.array(r["data"]).reshape(12, 7) for r in found.collect()}
    assert all(np.allclose(rows[i], expected[i], atol=1e-7) for i in range(3))
    measured = surfaces.six_stats(found, name == "aspect").collect()
    # A constant patch's roughness is rounding alone, which the entropy of a histogram would tell apart.
    for r in measured[: 2 if name == "roughness" else 3]:
        assert np.allclose(r[1:], terrain.stats(name, rows[r[0]][None])[0], atol=1e-9)


def test_cooccurrence(stack):
    z, table = stack
    expected = TEXTURE.run("glcm", z, levels=64)
    found = {r[0]: r[1:] for r in surfaces.cooccurrence(table, 12, 7).collect()}
    assert all(np.allclose(found[i], expected[i], atol=1e-9) for i in range(3))
    thin = table.selectExpr("patch_id", "slice(data, 1, 6) AS data")
    beyond = {r[0]: r[1:] for r in surfaces.cooccurrence(thin, 2, 3, levels=8).collect()}
    expected = TEXTURE.run("glcm", z.reshape(3, -1)[:, :6].reshape(3, 2, 3), levels=8)
    assert all(np.allclose(beyond[i], expected[i], atol=1e-9) for i in range(3))


def test_plans_stay_in_the_row(stack):
    _, table = stack
    for made in (surfaces.six_stats(surfaces.surface(table, "tri", 12, 7)), surfaces.cooccurrence(table, 12, 7)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Python" not in plan and "Aggregate [" not in plan


def test_windows_of_differences_are_loops(stack):
    """a term of the expression for each cell of the window, 440 deep at radius 10."""
    z, table = stack
    plans = [surfaces.surface(table, "tri", 12, 7, window_size=n)._jdf.queryExecution().optimizedPlan().toString() for n in (3, 21)]
    assert plans[0].count("abs(") == plans[1].count("abs(") == 1
    for size in (1, 21, 30):
        expected = TERRAIN.run("tri", z, window_size=size)
        rows = surfaces.surface(table, "tri", 12, 7, window_size=size).collect()
        assert len(rows) == 3 and all(np.allclose(r["data"], expected[r["patch_id"]].ravel(), atol=1e-9) for r in rows)


@pytest.mark.parametrize("name", ["tpi", "tri", "roughness"])
def test_cells_work_a_surface_out_once(stack, name):
    """a filter on the surface's size ran before the patches were dealt out, and so did the whole surface."""
    _, table = stack
    made = surfaces.surface(table, name, 12, 7)
    found = surfaces.cells(made, 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "Generate" in plan
    rows = {(r["patch_id"], r["y"], r["x"]): r["z"] for r in found.collect()}
    assert rows == {(r["patch_id"], i // 7, i % 7): z for r in made.collect() for i, z in enumerate(r["data"])}


@pytest.mark.parametrize(("name", "params", "offsets"), [("tophat", {}, decomposition.disk(20)), ("morphological_square", {"operation": "closing", "size": 15}, decomposition.square(15))])
def test_wide_footprints(spark, name, params, offsets):
    z = np.random.default_rng(20).normal(size=(30, 25))
    table = spark.createDataFrame([(0, z.ravel().tolist())], "patch_id long, data array<double>")
    rows = filters.decompose(table, name, 30, 25, **params).collect()

    def each(s, pick, sign):
        return np.array([[pick([s[reflected(y + sign * a, 30), reflected(x + sign * b, 25)] for a, b in offsets]) for x in range(25)] for y in range(30)])

    trend = each(each(z, min, 1), max, -1) if name == "tophat" else each(each(z, max, -1), min, 1)
    assert all(abs(r["trend"] - trend[r["y"], r["x"]]) < 1e-9 for r in rows) and len(rows) == 750
    assert np.allclose(DECOMPOSITIONS.run(name, z[None], **params)[0][0], trend)


def test_spectra(stack):
    z, table = stack
    expected = analysis.bands(z)
    found = {r[0]: r[1:] for r in surfaces.band_energy(table, 12, 7).collect()}
    assert all(np.allclose(found[i][:3], expected[i][:3], atol=1e-9) for i in range(3))
    assert all(np.isclose(found[i][3], expected[i][3], rtol=1e-6) for i in range(2))
    expected = spectral.directional(z).reshape(3, 4, 6)
    rows = {(r["patch_id"], r["angle"]): r[2:] for r in surfaces.directional(table, 12, 7).collect()}
    assert len(rows) == 12
    assert all(np.allclose(rows[i, a], expected[i, k], atol=1e-6) for i in range(2) for k, a in enumerate((0.0, 45.0, 90.0, 135.0)))
