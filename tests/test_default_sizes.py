"""Queries at the operators' default sizes against plain loops over cells."""

import math

import numpy as np
import pytest

from orogen.functions import turing
from orogen.plans import catalogue


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("few"))
    # Steps of about the default kappa, so that each diffusion step counts.
    values = np.random.default_rng(3).normal(scale=40, size=(3, 64)).astype(np.float32)
    spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(values)], "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, values.astype(float).reshape(-1, 8, 8)


def diffusion(z):
    for _ in range(10):
        out = z.copy()
        for y in range(8):
            for x in range(8):
                steps = [z[(y + a) % 8, (x + b) % 8] - z[y, x] for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
                out[y, x] += 0.1 * sum(d * math.exp(-((d / 50) ** 2)) for d in steps)
        z = out
    return z


def ball(z):
    span = range(-50, 51)
    bowl = [(a, b, 50 - math.sqrt(max(2500 - a * a - b * b, 0))) for a in span for b in span if a or b]
    fold = lambda v: v % 16 if v % 16 < 8 else 15 - v % 16

    def each(s, pick, sign):
        return np.array([[pick(s[fold(y + sign * a), fold(x + sign * b)] - sign * h for a, b, h in bowl) for x in range(8)] for y in range(8)])

    return each(each(z, min, 1), max, -1)


@pytest.mark.parametrize(("name", "plain"), [("anisotropic_diffusion", diffusion), ("rolling_ball", ball)])
def test_decomposition(spark, few, name, plain):
    path, z = few
    rows = catalogue.QUERIES[f"decomp_{name}_default"](spark, path).collect()
    trend = np.stack([plain(p) for p in z])
    assert len(rows) == z.size
    for r in rows:
        at = r["patch_id"], r["y"], r["x"]
        assert abs(r["trend"] - trend[at]) < 2e-6 and abs(r["residual"] - (z - trend)[at]) < 2e-6


def test_reaction_diffusion(spark, few):
    z = few[1][0]
    v = (z - z.min()) / (z.max() - z.min()) / 2
    u = 1 - v
    for _ in range(50):
        nu, nv = u.copy(), v.copy()
        for y in range(8):
            for x in range(8):
                near = lambda a, y=y, x=x: a[y - 1, x] + a[(y + 1) % 8, x] + a[y, x - 1] + a[y, (x + 1) % 8] - 4 * a[y, x]
                both = u[y, x] * v[y, x] ** 2
                nu[y, x] += 0.16 * near(u) - both + 0.035 * (1 - u[y, x])
                nv[y, x] += 0.08 * near(v) + both - 0.095 * v[y, x]
        u, v = nu, nv
    assert np.allclose(turing.gray_scott(z), v, atol=1e-4)
    default = catalogue.QUERIES["signature_residuals_turing_default"](spark, few[0]).orderBy("patch_id").collect()
    ten = catalogue.QUERIES["signature_residuals_turing"](spark, few[0]).orderBy("patch_id").collect()
    assert len(default) == 3 and all(a["embedding"] != b["embedding"] for a, b in zip(default, ten, strict=True))
