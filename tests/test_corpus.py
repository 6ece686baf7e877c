"""Elevation files to an index and back, resumed and streamed builds, sweeps and the command line."""

import json

import numpy as np
import pytest

from orogen import cli, config
from orogen.api import Service
from orogen.operators import build, coords, evaluate
from orogen.operators.index import Index
from orogen.sources import dem
from orogen.sources import fixtures as fx
from orogen.streaming.ingest import ingest

SMALL = config.parse({"decomposition": {"methods": ["gaussian", "polynomial"]}})


@pytest.fixture
def tiles(tmp_path):
    rng = np.random.default_rng(3)
    folder = tmp_path / "tiles"
    folder.mkdir()
    for k in range(3):
        z = rng.normal(size=(40, 32)).cumsum(axis=0)
        z[:4, :4] = np.nan
        np.save(folder / f"R00_C0{k}_dem.npy", z)
    np.save(folder / "R00_C09_dem.npy", np.full((32, 32), np.nan))
    return folder


def test_cut_and_formats():
    z = np.arange(500 * 64, dtype=float).reshape(500, 64)
    own = list(dem.cut(z, 16))
    assert len(own) == 128 and [p["local_id"] for p in own] == list(range(128))
    assert np.isclose(own[-1]["data"][16 * 15], z[496:, 48:].mean())
    assert len(list(dem.cut(z, 16, pad_partial=False))) == 124 and len(list(dem.cut(z, 16, 4))) == 42 * 5
    with pytest.raises(ValueError):
        dem.decode("a.txt", b"")
    with pytest.raises(ImportError):
        dem.decode("a.tif", b"")


def test_build_resume_query(spark, tiles, tmp_path):
    out = str(tmp_path / "corpus")
    assert build.build(spark, str(tiles), out, SMALL, 16, dry_run=True).count() == 4
    first = build.build(spark, str(tiles), out, SMALL, 16, max_tiles=2).orderBy("tile_id").collect()
    assert [(r["tile_id"], r["n_patches"], r["global_id_start"]) for r in first] == [("R00_C00", 6, 0), ("R00_C01", 6, 6)]
    assert {r["tile_id"] for r in build.build(spark, str(tiles), out, SMALL, 16, dry_run=True).collect()} == {"R00_C02", "R00_C09"}
    assert build.build(spark, str(tiles), out, SMALL, 16).count() == 3
    index = Index.load(spark, f"{out}/index")
    assert index.stats().first().asDict() == {"n_patches": 18, "embedding_dim": 12, "space": "cosinesimil", "m": 16, "normalized": True, "is_built": True}
    found = index.query_by_id(7, 5).orderBy("rank").collect()
    assert found[0]["patch_id"] == 7 and found[0]["distance"] < 1e-9 and found[0]["tile_id"] == "R00_C01" and len(found) == 5
    with pytest.raises(ValueError):
        index.query_by_id(99)
    fresh = str(tmp_path / "whole")
    build.build(spark, str(tiles), fresh, SMALL, 16)
    key = lambda i: sorted((r["tile_id"], r["local_id"], tuple(r["embedding"])) for r in i.vectors.join(i.patches, "patch_id").collect())
    assert key(index) == key(Index.load(spark, f"{fresh}/index"))


def test_command_line(spark, tiles, tmp_path, capsys):
    out = str(tmp_path / "corpus")
    (tmp_path / "c.yaml").write_text("decomposition: {methods: [gaussian]}")
    assert cli.main(["build", str(tiles), "--output", out, "--config", str(tmp_path / "c.yaml"), "--patch-size", "16"]) == 0
    assert cli.main(["query", f"{out}/index", "--tile", "R00_C01", "--coords", "17,3", "-k", "3"]) == 0
    assert cli.main(["query", f"{out}/index", "--coords", "9999,0"]) == 1
    assert cli.main(["info", f"{out}/index"]) == 0
    meta = tmp_path / "metadata.json"
    meta.write_text(json.dumps({"processed_tile_ids": ["R00_C00"], "grid_rows": 2, "grid_cols": 2, "tile_size_ft": 1000.0, "resolution_ft": 2.5, "crs": "EPSG:3735", "county_bounds": {"x_min": 1979000.0, "y_min": 738000.0, "x_max": 1981000.0, "y_max": 740000.0}}))
    assert cli.main(["check-coords", str(meta)]) == 0
    assert cli.main(["check-coords", str(meta), "--lat", "10"]) == 1
    assert cli.main(["check-coords", str(tmp_path / "none.json")]) == 2
    near = str(tmp_path / "near")
    assert cli.main(["build", str(tiles), "--output", near, "--config", str(tmp_path / "c.yaml"), "--patch-size", "16", "--approximate", "--cells", "1", "--M", "24"]) == 0
    assert Index.load(spark, f"{near}/index").m == 24
    place = ["--corpus", out, "--metadata", str(meta), "-k", "2"]
    capsys.readouterr()
    for index in (f"{out}/index", f"{near}/index"):
        assert cli.main(["query", index, "--x", "1979010", "--y", "739990", *place]) == 0
        shown = [[c.strip() for c in line.split("|")] for line in capsys.readouterr().out.splitlines() if line.startswith("|")]
        assert dict(zip(shown[0], shown[1], strict=True))["patch_id"] == "0" and "R00_C00" in shown[1]
        assert cli.main(["query", index, "--x", "1", "--y", "2", *place]) == 1
    assert cli.main(["query", f"{out}/index", "--lon", "-82.4590", "--lat", "40.0279"]) == 1
    service = Service.saved(spark, f"{near}/index", near, str(meta))
    assert service.health() == {"status": "ok", "index_loaded": True, "coords_available": True}
    assert service.query_by_coords(x=1979010.0, y=739990.0, k=2).count() == 2


def test_stream_reads_each_file_once(spark, tiles, tmp_path):
    out = str(tmp_path / "stream")
    for expected in (18, 18, 24):
        if expected == 24:
            np.save(tiles / "R01_C00_dem.npy", np.random.default_rng(1).normal(size=(40, 32)))
        ingest(spark, str(tiles), out, SMALL, 16).awaitTermination()
        assert spark.read.parquet(f"{out}/vectors").count() == expected


def test_sweeps(spark, sf):
    patches = fx.patches(spark, sf)
    small = evaluate.sample(patches.where("tile < 3"), 5)
    assert small.count() == 15
    base = evaluate.variant(decomposition_methods=["gaussian"], upsampling_methods=["bicubic"], use_rich_analysis=False, turing_iterations=3)
    found = evaluate.variants(small, base).collect()
    assert [r["variant"] for r in found] == list(evaluate.VARIANTS) and [r["cost"] for r in found] == [1, 2, 1, 2]
    assert evaluate.best(evaluate.iterations(small, base, (0, 2))).count() == 1
    assert evaluate.feed_kill(small, base, (0.03, 0.04), (0.05,), 2).count() == 2


def test_projection_round_trip(spark):
    point = spark.createDataFrame([(1, -82.4590, 40.0279)], "id int, lon double, lat double")
    feet = coords.from_wgs84(point)
    back = coords.to_wgs84(feet.drop("lon", "lat")).first()
    row = feet.first()
    assert abs(row["x"] - 1979981.9945) < 1e-3 and abs(row["y"] - 738619.1554) < 1e-3
    assert abs(back["lon"] + 82.4590) < 1e-9 and abs(back["lat"] - 40.0279) < 1e-9


def test_a_build_that_dies_goes_on(spark, tiles, tmp_path, monkeypatch):
    out, real, calls = str(tmp_path / "corpus"), build.embed, []

    def dies(patches, config, keep):
        calls.append(1)
        if len(calls) == 3:  # two tiles are committed before
            raise KeyboardInterrupt
        return real(patches, config, keep)

    monkeypatch.setattr(build, "embed", dies)
    with pytest.raises(KeyboardInterrupt):
        build.build(spark, str(tiles), out, SMALL, 16, tiles_per_commit=1)
    monkeypatch.setattr(build, "embed", real)
    left = {r["tile_id"] for r in build.build(spark, str(tiles), out, SMALL, 16, dry_run=True).collect()}
    assert left == {"R00_C02", "R00_C09"}
    found = build.build(spark, str(tiles), out, SMALL, 16, tiles_per_commit=1).orderBy("tile_id").collect()
    assert [(r["tile_id"], r["h"], r["w"], r["n_patches"], r["global_id_start"]) for r in found] == [(f"R00_C0{k}", 40, 32, 6, 6 * k) for k in range(3)]
    assert spark.read.parquet(f"{out}/failures").count() == 0


def test_half_written_tiles_are_written_again(spark, tiles, tmp_path):
    """A commit that dies after some of its files, or before its records, leaves tiles that a resumed build does again."""
    import shutil

    out = str(tmp_path / "corpus")
    build.build(spark, str(tiles), out, SMALL, 16, tiles_per_commit=2)
    (store,) = (tmp_path / "corpus" / "checkpoints").iterdir()
    patches = lambda: sorted((r["tile_id"], r["local_id"], tuple(r["embedding"])) for r in spark.read.schema(build.KEPT).parquet(f"{store}/data").collect())
    whole = patches()
    # One commit's records go; of its two tiles one has half of its rows and the other has rows twice.
    kept = spark.read.schema(build.COMMIT).parquet(f"{store}/commits").where("tile_id <> 'R00_C00' and tile_id <> 'R00_C01'")
    kept.write.parquet(f"{store}/some")
    shutil.rmtree(store / "commits")
    (store / "some").rename(store / "commits")
    rows = spark.read.schema(build.KEPT).parquet(f"{store}/data")
    rows.where("tile_id = 'R00_C00' and local_id < 3").drop("tile_id").write.parquet(str(tmp_path / "half"))
    shutil.rmtree(store / "data" / "tile_id=R00_C00")
    (tmp_path / "half").rename(store / "data" / "tile_id=R00_C00")
    for f in list((store / "data" / "tile_id=R00_C01").glob("*.parquet")):
        shutil.copy(f, f.with_name(f"again-{f.name}"))
    assert len(patches()) == len(whole) - 3 + 6
    found = build.build(spark, str(tiles), out, SMALL, 16, tiles_per_commit=2).orderBy("tile_id").collect()
    assert patches() == whole and [r["n_patches"] for r in found] == [6, 6, 6]
    records = {r["tile_id"]: r for r in build.committed(spark, str(store)).collect()}
    assert records["R00_C09"]["n_patches"] == 0 and len(records) == 4
    again = {r["tile_id"]: r["digest"] for r in build.records(spark.read.schema(build.KEPT).parquet(f"{store}/data"), spark.createDataFrame([(t,) for t in records], "tile_id string")).collect()}
    assert again == {t: r["digest"] for t, r in records.items()}


def test_totals_are_those_of_the_rows(spark, tiles, tmp_path, monkeypatch):
    """Records hold what a pass over the saved rows gives, and a commit whose rows were not all written is an error."""
    config_ = config.parse({"residuals": {"enabled": True, "decomposition_methods": ["gaussian"], "upsampling_methods": ["bilinear", "cubic_catmull_rom"], "bidirectional": True}})
    out = str(tmp_path / "corpus")
    described = build.build(spark, str(tiles), out, config_, 3, tiles_per_commit=4).orderBy("tile_id").collect()
    (store,) = (tmp_path / "corpus" / "checkpoints").iterdir()
    saved = [r for r in spark.read.schema(build.KEPT).parquet(f"{store}/data").collect()]
    for r in described:
        own = [s for s in saved if s["tile_id"] == r["tile_id"]]
        assert (r["n_patches"], r["n_failed_patches"], r["n_failed_slots"]) == (len(own), sum(bool(s["failed"]) for s in own), sum(len(s["failed"]) for s in own))
    expected = {}
    for s in saved:
        for entry in set(s["failed"]):
            n, where = expected.setdefault(entry, [0, set()])
            expected[entry] = [n + 1, where | {s["tile_id"]}]
    found = {r["entry"]: (r["n_patches"], r["tiles_with_failures"]) for r in spark.read.parquet(f"{out}/failures").collect()}
    assert found == {e: (n, len(where)) for e, (n, where) in expected.items()} and found
    monkeypatch.setattr(build, "_saved", lambda spark, path: spark.read.schema(build.KEPT).parquet(path).where("local_id > 0"))
    with pytest.raises(OSError, match="read back"):
        build.build(spark, str(tiles), str(tmp_path / "lost"), SMALL, 16)


def test_queries_in_blocks_are_the_same(spark, monkeypatch):
    from orogen.operators import vectors

    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 5)))], "patch_id long, embedding array<double>")
    asked = table.withColumnRenamed("patch_id", "query_id")
    whole = sorted(map(tuple, vectors.knn(table, asked, 4, "l2").collect()))
    monkeypatch.setattr(vectors, "BROADCAST_NUMBERS", 100)
    assert sorted(map(tuple, vectors.knn(table, asked, 4, "l2").collect())) == whole


def test_comparing_signatures_of_tiles(spark, tiles, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("decomposition: {methods: [gaussian]}")
    out = str(tmp_path / "results")
    assert cli.main(["separability", str(tiles), "--config", str(tmp_path / "c.yaml"), "--patch-size", "16", "--patches-per-tile", "4", "--tiles", "R00_C00", "R00_C01", "--output", out]) == 0
    row = spark.read.json(out).first()
    assert row["n_within"] == 12 and row["n_across"] == 16 and row["dim"] == 6
    assert cli.main(["separability", str(tiles), "--patch-size", "16", "--tiles", "none"]) == 1


def test_http(spark):
    import threading
    import urllib.error
    import urllib.request

    from orogen.api import Service
    from orogen.http import server

    service = Service(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "patch_id long, embedding array<double>"))
    with server(service, 0) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{running.server_address[1]}"

        def ask(path, body=None):
            try:
                with urllib.request.urlopen(base + path, None if body is None else json.dumps(body).encode()) as answer:
                    return answer.status, json.load(answer)
            except urllib.error.HTTPError as error:
                return error.code, json.load(error)

        assert ask("/health") == (200, {"status": "ok", "index_loaded": True, "coords_available": False})
        assert ask("/info")[1]["n_patches"] == 8
        status, found = ask("/query/by-id", {"patch_id": 3, "k": 2})
        assert status == 200 and found["results"][0]["patch_id"] == 3 and len(found["results"]) == 2
        assert [ask("/query/by-id", b)[0] for b in ({"patch_id": 99}, {"patch_id": 3, "k": 0}, {}, {"patch_id": "x"}, {"other": 1})] == [404, 422, 422, 422, 422]
        assert ask("/query/by-coords", {"x": 1, "y": 2})[0] == 501 and ask("/nothing")[0] == 404
        running.shutdown()
