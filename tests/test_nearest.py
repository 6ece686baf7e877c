"""Blocked k-NN against the scan, the cell index against exact neighbours, one-pass parameters against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.operators import blocks, cells, vectors
from orogen.operators.index import Index


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 12)) * 4, 50, axis=0) + rng.normal(size=(3000, 12)) * 0.3
    x[100:140] = x[7]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "patch_id long, embedding array<double>").repartition(5).cache()
    return rows, x


def asked(rows, which):
    return rows.where(which).select(F.col("patch_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("space", blocks.SPACES)
def test_blocks_equal_the_scan(clustered, space):
    rows, _ = clustered
    rows = rows.where("patch_id < 900")
    many = asked(rows, "patch_id % 3 = 0")
    expected = {tuple(r) for r in vectors.knn(rows, many, 7, space, exclude_self=True).collect()}
    found = blocks.knn_batch(rows, many, 7, space, True, block_numbers=1200)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) == 7 * 300


def test_many_queries_stay_off_the_driver(clustered, monkeypatch):
    rows, _ = clustered
    small, many = rows.where("patch_id < 200"), asked(rows, "patch_id < 200")
    expected = {tuple(r) for r in vectors.knn(small, many, 3).collect()}
    assert vectors.fetched(many, 100) is None
    monkeypatch.setattr(vectors, "fetched", lambda queries: None)
    assert {tuple(r) for r in vectors.knn(small, many, 3).collect()} == expected


def test_empty_sides(spark, clustered):
    rows, _ = clustered
    none = rows.limit(0)
    assert vectors.knn(none, asked(rows, "patch_id < 3"), 3).count() == 0
    assert vectors.knn(rows, asked(none, "true"), 3).count() == 0
    assert blocks.knn_batch(none, asked(rows, "patch_id < 3"), 3).count() == 0 and blocks.knn_batch(rows, asked(none, "true"), 3).count() == 0
    assert blocks.knn_batch(rows.where("patch_id < 2"), asked(rows, "patch_id < 3"), 9).count() == 6


@pytest.mark.parametrize("space", blocks.SPACES)
def test_cell_index(spark, clustered, tmp_path, space, monkeypatch):
    rows, _ = clustered
    monkeypatch.setattr(cells, "ROWS_A_FILE", 40)
    patches = rows.select("patch_id", (F.col("patch_id") * 2).alias("twice"))
    index = Index.build(rows, patches, True, space, approximate=True, n_cells=40)
    index.save(str(tmp_path / "index"))
    loaded = Index.load(spark, str(tmp_path / "index"))
    assert loaded.cells.count == 40 and loaded.cells.probes == index.cells.probes < 40
    pairs = lambda df: {(r[0], tuple(r[1])) for r in df.select("patch_id", "embedding").collect()}
    assert pairs(loaded.vectors) == pairs(rows)
    files = [f for f in loaded.vectors.inputFiles()]
    assert len(files) > 60  # full cells have several files
    few = asked(rows, "patch_id % 100 = 0")
    found = loaded.nearest(few, 10)
    exact = Index.build(rows, patches, True, space).nearest(few, 10)
    measured = cells.recall(found, exact).first()
    assert measured["recall"] >= 0.9 and measured["n_queries"] == 30
    # All cells give the exact result, and a query finds the same alone and among others, sent along or in blocks.
    everything = {tuple(r) for r in loaded.nearest(few, 10, probes=40).collect()}
    assert everything == {tuple(r) for r in exact.collect()}
    alone = {tuple(r) for r in loaded.nearest(few.where("query_id = 300"), 10).collect()}
    assert alone == {tuple(r) for r in found.where("query_id = 300").collect()}
    together = {tuple(r) for r in found.collect()}
    monkeypatch.setattr(vectors, "fetched", lambda queries: None)
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", 300)
    assert {tuple(r) for r in loaded.nearest(few, 10).collect()} == together
    assert loaded.query(few.where("query_id = 300"), 2).select("twice").count() == 2


def test_only_probed_cells_are_read(spark, clustered, tmp_path):
    rows, _ = clustered
    Index.build(rows, rows.select("patch_id"), False, "l2", approximate=True, n_cells=30, probes=2).save(str(tmp_path / "i"))
    index = Index.load(spark, str(tmp_path / "i"))
    read = cells.pruned(index.vectors, [3, 4])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    total = index.vectors.count()
    assert 0 < read.count() < total / 3
    assert index.nearest(asked(rows, "patch_id = 5"), 4).count() == 4


def test_parameters_in_one_pass(spark, clustered):
    rows, x = clustered
    table = rows.withColumn("embedding", F.concat("embedding", F.array(F.lit(3.5))))
    x = np.column_stack([x, np.full(len(x), 3.5)])
    for method, shift, spread in (("zscore", x.mean(axis=0), x.std(axis=0)), ("minmax", x.min(axis=0), np.ptp(x, axis=0))):
        found = sorted(map(tuple, vectors.parameters(table, method).collect()))
        assert [r[0] for r in found] == list(range(13))
        assert np.allclose([r[1] for r in found], shift) and np.allclose([r[2] for r in found], np.where(spread == 0, 1, spread))
        plan = vectors.normalize(table, method)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
    assert vectors.parameters(rows.limit(0)).count() == 0


def test_few_blocks_are_met_in_a_pair_for_each_core(spark):
    """F16: one block of vectors met all queries in one task, and every pair's distance was worked out by subtraction."""
    import numpy as np

    from orogen.operators import blocks

    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(3000, 6)), 1) + 1000.0
    x[200:260] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "patch_id long, embedding array<double>")
    slots = []
    own = blocks.nearest
    blocks.nearest = lambda *given: slots.append(given[-1]) or own(*given)
    try:
        found = blocks.knn_batch(rows, rows.withColumnRenamed("patch_id", "query_id"), 7, "l2").collect()
    finally:
        blocks.nearest = own
    assert slots[0] <= max(blocks.STRIP, -(-3000 // (4 * spark.sparkContext.defaultParallelism)))
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["distance"], r["patch_id"]))
    for i in range(0, 3000, 50):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        near = np.lexsort((np.arange(3000), d))[:7]
        assert got[i] == list(zip(d[near].tolist(), near.tolist(), strict=True))


def test_distances_are_worked_out_for_the_nearest_only():
    """F16: exact distances of pairs within a bound of the k-th best, found by a product in single precision."""
    import numpy as np

    from orogen.operators import blocks

    rng = np.random.default_rng(12)
    x = rng.normal(size=(5000, 16))
    squares, off = blocks._filter(x[:40], x)
    real = ((x[:40, None, :] - x[None]) ** 2).sum(axis=2)
    assert (np.abs(squares(0, 40) - real) <= off[:, None]).all()
    top = blocks._bound(real, 10)
    assert (np.sort(real, axis=1)[:, 9] <= top).all() and (real <= top[:, None]).sum() < 40 * 40


def test_vectors_of_one_partition_meet_many_queries_on_all_cores(spark):
    """vectors stayed in the one task that their file had them in."""
    from pyspark.sql import functions as F

    from orogen.operators import vectors

    rows = spark.range(0, 400, 1, 1).select(F.col("id").alias("patch_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("embedding"))
    asked = rows.withColumnRenamed("patch_id", "query_id")
    dealt = lambda q: "RepartitionByExpression" in (p := vectors.knn(rows, q, 3, "l2")._jdf.queryExecution().analyzed().toString()) or "Repartition " in p
    assert dealt(asked.where("query_id < 300")) and not dealt(asked.where("query_id < 5"))
