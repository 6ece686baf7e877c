"""Command line: build an index, query it, describe or serve it, compare signatures, check coordinates against a corpus."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as cfg
from .api import Service, ServiceError
from .http import server
from .operators import build as corpus
from .operators import coords, evaluate, vectors
from .operators.index import Index
from .sources import dem
from .sources.storage import stored


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orogen", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("build", help="embed elevation tiles and save an index")
    p.add_argument("source")
    p.add_argument("--output", required=True)
    p.add_argument("--config", default="default", help="a YAML file, or the name of a preset")
    p.add_argument("--patch-size", type=int, default=64)
    p.add_argument("--overlap", type=int, default=0)
    p.add_argument("--min-valid", type=float, default=0.8)
    p.add_argument("--pattern", default="*_dem.npy")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--max-tiles", type=int)
    p.add_argument("--space", choices=vectors.SPACES, help="distance, in place of the configuration's")
    p.add_argument("--no-normalize", action="store_true", help="index vectors as they are")
    p.add_argument("--approximate", action="store_true", help="an index by cells, of which a search reads the nearest")
    p.add_argument("--cells", type=int, help="number of cells; the square root of the vectors without")
    p.add_argument("--probes", type=int, help="cells that a search reads; as many as a sample needs without")
    p.add_argument("--M", type=int, default=16, help="kept in the manifest")
    p = commands.add_parser("separability", help="how well signatures tell tiles apart: of one configuration, or of the residual variants")
    p.add_argument("source")
    p.add_argument("--config", help="a YAML file, or the name of a preset; without it the variants are compared")
    p.add_argument("--tiles", nargs="*", help="tile ids; all without")
    p.add_argument("--patches-per-tile", type=int, default=30)
    p.add_argument("--patch-size", type=int, default=64)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--pattern", default="*_dem.npy")
    p.add_argument("--output", help="a folder for the results as JSON lines")
    p = commands.add_parser("serve", help="answer searches of an index over HTTP")
    p.add_argument("index")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--corpus", help="a build's output folder, for searches by coordinates")
    p.add_argument("--metadata", help="the corpus's JSON, for searches by coordinates")
    p = commands.add_parser("query", help="nearest patches of a patch, of the patch at a pixel of a tile, or of that at a place")
    p.add_argument("index")
    p.add_argument("--lon", type=float)
    p.add_argument("--lat", type=float)
    p.add_argument("--x", type=float, help="projected feet")
    p.add_argument("--y", type=float, help="projected feet")
    p.add_argument("--corpus", help="a build's output folder, for --lon and --lat or --x and --y")
    p.add_argument("--metadata", help="the corpus's JSON, for the same")
    p.add_argument("--id", type=int)
    p.add_argument("--tile")
    p.add_argument("--coords", help="y,x in pixels")
    p.add_argument("-k", type=int, default=10)
    p = commands.add_parser("info", help="size, width and value range of an index")
    p.add_argument("index")
    p = commands.add_parser("check-coords", help="exit 0 if a point is inside the corpus, 1 if not")
    p.add_argument("metadata")
    p.add_argument("--lat", type=float, default=40.0279)
    p.add_argument("--lon", type=float, default=-82.4590)
    p.add_argument("--corpus", help="a build's output folder, to say whether the tile is indexed")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("orogen").getOrCreate()
    return {"build": _build, "query": _query, "info": _info, "check-coords": _check, "separability": _separability, "serve": _serve}[args.command](spark, args)


def _build(spark: SparkSession, args) -> int:
    config = cfg.resolve(args.config)
    config.space = args.space or config.space
    config.normalize = config.normalize and not args.no_normalize
    if wrong := cfg.validate(config):
        print("\n".join(wrong), file=sys.stderr)
        return 1
    try:
        found = corpus.build(spark, args.source, args.output, config, args.patch_size, args.overlap, args.min_valid, not args.no_resume, args.dry_run, args.max_tiles, args.pattern, index={"approximate": args.approximate, "n_cells": args.cells, "probes": args.probes, "m": args.M})
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    found.orderBy("tile_id").show(50, truncate=False)
    return 0


def _query(spark: SparkSession, args) -> int:
    if args.lon is not None or args.x is not None:
        return _query_place(spark, args)
    index = Index.load(spark, args.index)
    asked = args.id
    if asked is None and args.coords:
        y, x = map(int, args.coords.split(","))
        own = index.patches if args.tile is None else index.patches.where(F.col("tile_id") == args.tile)
        inside = own.where((F.col("y_start") <= y) & (F.col("y_start") + F.col("patch_size") > y) & (F.col("x_start") <= x) & (F.col("x_start") + F.col("patch_size") > x))
        asked = inside.agg(F.min("patch_id")).first()[0]
    if asked is None:
        print("no such patch; give --id, or --coords inside a tile", file=sys.stderr)
        return 1
    try:
        index.query_by_id(asked, args.k).orderBy("rank").show(args.k, truncate=False)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


def _query_place(spark: SparkSession, args) -> int:
    if not (args.corpus and args.metadata):
        print("a place needs --corpus and --metadata", file=sys.stderr)
        return 1
    try:
        found = Service.saved(spark, args.index, args.corpus, args.metadata).query_by_coords(args.lon, args.lat, args.x, args.y, k=args.k)
    except ServiceError as error:
        print(error, file=sys.stderr)
        return 1
    found.orderBy("rank").show(args.k, truncate=False)
    return 0


def _info(spark: SparkSession, args) -> int:
    index = Index.load(spark, args.index)
    index.stats().show(truncate=False)
    index.summary().show(truncate=False)
    spans = [f(c).alias(f"{n}_{c}") for c in ("row", "col") if c in index.patches.columns for n, f in (("min", F.min), ("max", F.max))]
    if spans:
        index.patches.agg(*spans).show()
    return 0


def _check(spark: SparkSession, args) -> int:
    try:
        meta = dem.corpus_metadata(spark, args.metadata)
    except Exception as error:  # a missing or unreadable file has an exit status of its own
        print(error, file=sys.stderr)
        return 2
    point = coords.from_wgs84(spark.createDataFrame([(args.lon, args.lat)], "lon double, lat double")).crossJoin(meta)
    row = point.select("x", "y", "tile_size_ft", coords.inside(F.col("x"), F.col("y")).alias("inside"), (F.col("x") - F.col("x_min")).alias("from_west"), (F.col("y_max") - F.col("y")).alias("from_north")).first()
    found = row.asDict()
    if args.corpus and row["inside"]:
        tile = f"R{int(found['from_north'] // found['tile_size_ft']):02d}_C{int(found['from_west'] // found['tile_size_ft']):02d}"
        known = spark.read.parquet(f"{args.corpus}/tiles").where(F.col("tile_id") == tile).first()
        found |= {"tile_id": tile, "indexed": known is not None, "n_patches": known["n_patches"] if known else 0}
    print(found)
    return 0 if row["inside"] else 1


def _separability(spark: SparkSession, args) -> int:
    own = dem.patches(dem.files(spark, args.source, args.pattern), args.patch_size)
    if args.tiles:
        own = own.where(F.col("tile_id").isin(args.tiles))
    numbered = own.withColumns({"tile": F.col("tile_id"), "patch_id": F.xxhash64("tile_id", "local_id")})
    # A sample of a stated size, which every variant scores anew.
    sample = stored(evaluate.sample(numbered.select("patch_id", "tile", "h", "w", "data"), args.patches_per_tile, args.seed))
    if sample.isEmpty():
        print("no patches under these tiles", file=sys.stderr)
        return 1
    found = evaluate.score(sample, cfg.resolve(args.config)).withColumn("variant", F.lit(args.config)) if args.config else evaluate.variants(sample)
    found = stored(found)
    found.orderBy(F.desc("ratio")).show(truncate=False)
    if args.output:
        evaluate.save(found, args.output)
    return 0


def _serve(spark: SparkSession, args) -> int:
    service = Service.saved(spark, args.index, args.corpus, args.metadata)
    with server(service, args.port) as running:
        print(f"http://127.0.0.1:{running.server_address[1]}", flush=True)
        running.serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
