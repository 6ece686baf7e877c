"""Points and clicks reach every row of a raster of more rows than the small tables have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from orogen.plans import catalogue

ROWS = 5_000


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tall"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("vec_id") * 31 % 17 + i).cast("float"))
    spark.range(ROWS).withColumnRenamed("id", "vec_id").withColumn("embedding", cells).write.parquet(f"{path}/embeddings.parquet")
    spark.range(1, 6_001).withColumnRenamed("id", "c_custkey").write.parquet(f"{path}/customer.parquet")
    return path


@pytest.mark.parametrize(("name", "row"), [("patch_at_coords_whole", "y"), ("patch_at_coords_overlap_whole", "y"), ("display_click_to_pixel_whole", "py")])
def test_whole_height(spark, tall, name, row):
    found = catalogue.QUERIES[name](spark, tall)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    con = duckdb.connect()
    for t in ("embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tall}/{t}.parquet/*.parquet'")
    sql = con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]}) AS q").fetchall()
    assert sorted(map(str, rows)) == sorted(map(str, sql))
    asked = {r[columns.index(row)] for r in rows}
    assert max(asked) >= ROWS - 1 and (row == "py" or asked >= set(range(ROWS)))
