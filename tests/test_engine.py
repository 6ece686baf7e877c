"""Operators over small tables, and the catalogue against its SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen import config
from orogen.api import Service, ServiceError
from orogen.operators import embed, tiling, vectors
from orogen.plans import catalogue
from orogen.sources import fixtures as fx

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["dem_info_nodata", "tile_patches_nodata", "tile_patches_overlap4", "residual_stats6", "slope_stats", "glcm_props", "directional_fft", "decomp_guided", "up_quintic", "knn_normalized", "separability", "point_to_patch", "patch_bbox_wgs84", "heatmap_labels", "tile_info"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    sql = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.ORACLES[name]}) AS q").fetchall()
    assert rows and sorted(map(str, plain(rows))) == sorted(map(str, plain(sql)))


def cells(spark, z):
    return spark.createDataFrame([(y, x, None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(z)], "y long, x long, z double")


def test_tiling_round_trip(spark):
    z = np.arange(90.0).reshape(10, 9)
    raster = cells(spark, z)
    boxes = tiling.tile(raster, 4, 1).orderBy("patch_id").collect()
    assert [b["patch_id"] for b in boxes] == list(range(len(boxes))) == list(range(9))
    own = tiling.patch_cells(raster, 4, 1).join(tiling.tile(raster, 4, 1).select("patch_id", "y_start", "x_start"), "patch_id")
    back = tiling.reconstruct(own.select((F.col("y_start") + F.col("y")).alias("gy"), (F.col("x_start") + F.col("x")).alias("gx"), "z"), tiling.shape_of(raster))
    assert all(abs(r["z"] - z[r["y"], r["x"]]) < 1e-9 for r in back.collect())


def test_rejected_patches_take_no_id(spark):
    z = np.ones((4, 8))
    z[:, :3] = np.nan
    found = tiling.tile(cells(spark, z), 4).collect()
    assert [(r["patch_id"], r["col"]) for r in found] == [(0, 1)]


def test_knn_edges(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "patch_id long, embedding array<double>")
    asked = rows.where("patch_id = 2").select(F.col("patch_id").alias("query_id"), "embedding")
    for space in vectors.SPACES:
        found = vectors.knn(rows, asked, 50, space).orderBy("rank").collect()
        assert len(found) == 5 and found[0]["patch_id"] == 2 and abs(found[0]["distance"]) < 1e-9
        assert [r["distance"] for r in found] == sorted(r["distance"] for r in found)
    assert vectors.knn(rows, asked, 3, "l2", exclude_self=True).where("patch_id = 2").count() == 0
    assert vectors.knn(rows.limit(0), asked, 3).count() == 0 and vectors.knn(rows, asked.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        vectors.knn(rows, asked, 3, "l9")
    flat = vectors.normalize(rows.withColumn("embedding", F.array(F.lit(1.0), F.col("patch_id").cast("double"))), "minmax")
    assert {r["embedding"][0] for r in flat.collect()} == {0.0}


def test_signatures(spark, sf):
    patches = fx.patches(spark, sf).limit(20)
    for name in ("default", "hybrid", "spectral"):
        own = config.preset(name)
        rows = embed.embed(patches, own).collect()
        assert len(rows) == 20 and all(len(r["embedding"]) == own.total_dim() for r in rows)
    with pytest.raises(ValueError):
        embed.embed(patches, config.parse({"space": "l8"}))


def test_failed_slots_become_zeros(spark):
    rows = spark.createDataFrame([(1, 3, 3, [1.0, 2.0, 3.0, 4.0, 9.0, 1.0, 0.0, 2.0, 5.0])], "patch_id long, h int, w int, data array<double>")
    own = config.parse({"decomposition": {"enabled": False}, "residuals": {"enabled": True, "decomposition_methods": ["uniform"], "upsampling_methods": ["cubic_catmull_rom"], "bidirectional": True, "decomposition_params": {"uniform": {"size": 3}}}})
    found = embed.embed(rows, own).first()
    assert set(found["embedding"]) == {0.0} and found["failed"] == ["uniform/cubic_catmull_rom:A:ValueError", "uniform/cubic_catmull_rom:B:no_A_to_compare"]


def test_service_errors(spark, sf):
    service = Service.over(spark, sf)
    for status, call in [
        (404, lambda: service.query_by_id(10**9)), (422, lambda: service.query_by_id(1, 0)), (422, lambda: service.query_by_coords(x=1.0)),
        (404, lambda: service.query_by_coords(x=0.0, y=0.0)), (503, lambda: Service(None).query_by_id(1)), (501, lambda: Service(service.index).query_by_coords(x=0.0, y=0.0)),
    ]:
        with pytest.raises(ServiceError) as error:
            call()
        assert error.value.status == status
    assert service.health() == {"status": "ok", "index_loaded": True, "coords_available": True}
