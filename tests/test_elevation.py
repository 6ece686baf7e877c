"""The block reader against whole files: same patches, only the rows that are asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.sources import dem, elevation


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(8)
    path = tmp_path_factory.mktemp("tiles")
    a = rng.normal(size=(150, 70))
    a[20:60, 10:40] = np.nan
    np.save(path / "a_dem.npy", a)
    np.save(path / "b_dem.npy", rng.integers(0, 900, (64, 33)).astype(np.int16))
    np.save(path / "c_dem.npy", np.asfortranarray(rng.normal(size=(90, 41)).astype(np.float32)))
    gone = np.full((40, 40), np.nan)
    gone[0, :2] = 1.0
    np.save(path / "d_dem.npy", gone)
    np.save(path / "e_dem.npy", np.zeros((3, 5)))
    np.save(path / "other.npy", np.zeros((64, 64)))
    return str(path)


def rows(df, *drop):
    out = {}
    for r in df.collect():
        r = r.asDict()
        out[r["tile_id"], r["row"], r["col"]] = (np.array(r.pop("data"), float), {k: v for k, v in r.items() if k not in drop})
    return out


def same(found, expected):
    assert found.keys() == expected.keys()
    for k, (data, rest) in expected.items():
        assert np.array_equal(found[k][0], data, equal_nan=True) and found[k][1] == rest


@pytest.mark.parametrize(("size", "overlap", "pad", "block"), [(16, 0, True, 1), (16, 5, True, 10**9), (24, 4, False, 40_000), (64, 0, True, 1)])
def test_blocks_equal_whole_files(spark, folder, size, overlap, pad, block):
    whole = dem.patches(dem.files(spark, folder), size, overlap, 0.6, pad)
    parts = elevation.patches(spark, folder, patch_size=size, overlap=overlap, min_valid=0.6, pad_partial=pad, block_bytes=block)
    expected = rows(whole)
    same(rows(parts), expected)
    assert expected and parts.columns == whole.columns


def test_one_patch_reads_its_own_rows(spark, folder, monkeypatch):
    found = elevation.patch(spark, folder, "a", 3, 1, patch_size=16, min_valid=0.0, block_bytes=1)
    assert found.rdd.getNumPartitions() == 1
    expected = {k: v for k, v in rows(dem.patches(dem.files(spark, folder), 16, 0, 0.0), "local_id").items() if k == ("a", 3, 1)}
    same(rows(found), expected)
    reader = elevation.ElevationReader({"path": folder, "patch_size": "16", "overlap": "4", "block_bytes": "1"})
    left = list(reader.pushFilters([elevation.EqualTo(("tile_id",), "a"), elevation.GreaterThan(("row",), 3), elevation.LessThanOrEqual(("row",), 5), elevation.EqualTo(("col",), 1)]))
    assert left == [elevation.EqualTo(("col",), 1)]
    blocks = reader.partitions()
    assert [b.rows for b in blocks] == [(4,), (5,)] and {b.grid.tile_id for b in blocks} == {"a"}
    asked = []
    read = elevation.Grid.rows
    monkeypatch.setattr(elevation.Grid, "rows", lambda self, files, first, stop: asked.append((first, stop)) or read(self, files, first, stop))
    assert sum(b.num_rows for block in blocks for b in reader.read(block)) > 0
    assert asked == [(48, 64), (60, 76)]


def test_filters_on_rows_and_tiles(spark, folder):
    every = rows(dem.patches(dem.files(spark, folder), 16, 0, 0.0))
    some = elevation.patches(spark, folder, F.col("tile_id").isin("a", "c") & F.col("row").isin(1, 2, 5), patch_size=16, min_valid=0.0)
    same(rows(some), {k: v for k, v in every.items() if k[0] in "ac" and k[1] in (1, 2, 5)})
    counted = elevation.read(spark, folder, counts="true", patch_size=16, pad_partial="false")
    totals = {r["tile_id"]: r["n"] for r in counted.groupBy("tile_id").agg(F.sum("n_cells").alias("n")).collect()}
    assert totals == {"a": 150 * 70, "b": 64 * 33, "c": 90 * 41, "d": 1600}


def test_wrong_files(spark, tmp_path):
    np.save(tmp_path / "x_dem.npy", np.zeros((2, 3, 4)))
    with pytest.raises(Exception, match="two axes"):
        elevation.read(spark, str(tmp_path)).count()
    (tmp_path / "none").mkdir()
    assert elevation.patches(spark, str(tmp_path / "none")).count() == 0
