"""A corpus of more than a hundred rows of tiles."""

from orogen.plans import catalogue
from orogen.sources import fixtures as fx


def corpus(spark, tmp_path):
    ids = [2_500, 24_999, 25_000, 25_025, 2_500_260]
    spark.createDataFrame([(i, 0, [float(i % 7), 1.0]) for i in ids], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_names_of_tiles_are_never_cut(spark, tmp_path):
    """F6 to F11, F13 to F15: R100 became R10, and so another row's tile."""
    found = {r["patch_id"]: r["tile_id"] for r in fx.corpus_patches(spark, corpus(spark, tmp_path)).collect()}
    assert found == {2_500: "R10_C00", 24_999: "R99_C09", 25_000: "R100_C00", 25_025: "R100_C01", 2_500_260: "R10001_C00"}


def test_tiles_are_numbered_by_row_and_column(spark, tmp_path):
    rows = sorted(catalogue.QUERIES["tile_info"](spark, corpus(spark, tmp_path)).collect(), key=lambda r: r["global_id_start"])
    assert [(r["tile_row"], r["tile_col"], r["global_id_start"]) for r in rows] == [(10, 0, 0), (99, 9, 1), (100, 0, 2), (100, 1, 3), (10001, 0, 4)]
