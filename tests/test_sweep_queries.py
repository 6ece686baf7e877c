"""Queries of sweeps and diagnostics against brute force."""

import numpy as np
import pytest

from orogen.functions import analysis
from orogen.operators import embed, evaluate
from orogen.plans import catalogue


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("few"))
    values = np.random.default_rng(5).normal(size=(8, 64)).astype(np.float32)
    spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(values)], "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, values.astype(float).reshape(-1, 8, 8)


def ratio(z, config):
    e = embed.signature(z, config).astype(np.float32).astype(float)
    spread = e.std(axis=0)
    e = (e - e.mean(axis=0)) / np.where(spread == 0, 1, spread)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    pairs = [(i % 2 == j % 2, 1 - e[i] @ e[j]) for i in range(len(e)) for j in range(i)]
    return np.mean([d for same, d in pairs if not same]) / np.mean([d for same, d in pairs if same])


def test_best_variant(spark, few):
    path, z = few
    ratios = {n: ratio(z, evaluate.variant(**c)) for n, c in evaluate.VARIANTS.items()}
    found = catalogue.QUERIES["sweep_variant_best"](spark, path).collect()
    name = max(ratios, key=ratios.get)
    assert [r["variant"] for r in found] == [name] and abs(found[0]["ratio"] - ratios[name]) < 1e-4
    assert abs(found[0]["gain_pct"] - (ratios[name] / ratios["vanilla"] - 1) * 100) < 1e-2


def test_diagnostics_by_tile(spark, few):
    found = {tuple(r) for r in catalogue.QUERIES["diagnostics_by_tile"](spark, few[0]).collect()}
    assert found == {(t, e, 4) for t in (0, 1) for e in ("gaussian/cubic_catmull_rom:A:ValueError", "gaussian/cubic_catmull_rom:B:no_A_to_compare")}


def test_a_sweep_reads_its_patches_once_a_variant(spark):
    """normalisation and separability computed the signatures again, several times each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    values = np.random.default_rng(7).normal(size=(12, 64))
    rows = spark.createDataFrame([(i, i % 3, 8, 8, v.tolist()) for i, v in enumerate(values)], "patch_id long, tile int, h int, w int, data array<double>")
    config = evaluate.variant(decomposition_methods=["gaussian"], upsampling_methods=["bicubic"])
    found = evaluate.with_gain(evaluate.sweep(rows.mapInPandas(counted, rows.schema), {"a": config, "b": config}), "a").collect()
    assert len(found) == 2 and found[0]["ratio"] == found[1]["ratio"]
    assert seen.value == 2 * 12


def test_statistics_of_a_stack_are_those_of_each_grid():
    """lines, entropies and signal to noise of all patches of a stack at once."""
    rng = np.random.default_rng(3)
    z = np.cumsum(rng.normal(size=(7, 9, 9)), axis=2)
    z[1], z[2], z[3] = 5.0, np.eye(9), np.arange(9)[:, None] > 3
    found = analysis.lines(z)
    assert (found == np.concatenate([analysis.lines(g[None]) for g in z])).all() and found[3, 0] > 0 and not found[1].any()
    for row, value in zip(z.reshape(7, -1), analysis.entropy(z.reshape(7, -1)), strict=True):
        p = np.histogram(row, bins=50, density=True)[0] + 1e-10
        assert value == -(p / p.sum() * np.log(p / p.sum())).sum()


def test_signatures_deal_out_rows_of_one_partition(spark):
    """as many partitions as cores, of which one holds all rows, left all work to one task."""
    rows = spark.range(0, 400, 1, 16).select("id").where("id < 25").select("id")
    assert rows.rdd.getNumPartitions() == 16
    sizes = embed.spread(rows).rdd.glom().map(len).collect()
    assert sum(sizes) == 25 and max(sizes) <= 9
