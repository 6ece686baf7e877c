"""Incremental corpus build: embed tile by tile into a partitioned table, resume by anti-join, then number and index."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SignatureConfig
from ..sources import dem, elevation
from .embed import embed
from .index import Index


def config_key(config: SignatureConfig, patch_size: int, overlap: int, min_valid: float) -> str:
    """Checkpoints of another configuration are never mixed in: their folder has another name."""
    return hashlib.sha256(json.dumps([config.to_dict(), patch_size, overlap, min_valid], sort_keys=True, default=str).encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


#: Rows of a tile as they are saved.
KEPT = "tile_id string, local_id long, row int, col int, y_start int, x_start int, tile_h int, tile_w int, embedding array<float>, failed array<string>"
#: What is known of a committed tile. ``entries`` counts its patches by entry of ``failed``, ``digest`` is the sum of
#: 64-bit hashes of its rows.
COMMIT = "tile_id string, tile_h int, tile_w int, n_patches long, n_failed_patches long, n_failed_slots long, entries map<string,long>, digest decimal(38,0)"


def _drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remaining(listed: DataFrame, done: DataFrame | None) -> DataFrame:
    """Tiles of the list without a commit record."""
    return listed if done is None else listed.join(done.select("tile_id").distinct(), "tile_id", "left_anti")


def records(saved: DataFrame, listed: DataFrame) -> DataFrame:
    """The commit records of ``listed`` tiles from their saved rows, in one pass; a tile without patches has one too."""
    digest = F.xxhash64("local_id", "y_start", "x_start", "embedding", "failed").cast("decimal(38,0)")
    shape = [F.first(c).alias(c) for c in ("tile_h", "tile_w")]
    slots = F.size("failed").cast("long")
    totals = saved.groupBy("tile_id").agg(
        *shape, F.count("*").alias("n_patches"), F.sum((slots > 0).cast("long")).alias("n_failed_patches"), F.sum(slots).alias("n_failed_slots"), F.sum(digest).alias("digest")
    )
    each = saved.select("tile_id", F.explode(F.array_distinct("failed")).alias("entry")).groupBy("tile_id", "entry").agg(F.count("*").alias("n"))
    entries = each.groupBy("tile_id").agg(F.map_from_entries(F.collect_list(F.struct("entry", "n"))).alias("entries"))
    joined = listed.join(totals, "tile_id", "left").join(entries, "tile_id", "left")
    zero = {"n_patches": 0, "n_failed_patches": 0, "n_failed_slots": 0}
    return joined.fillna(zero).withColumn("entries", F.coalesce("entries", F.expr("cast(map() as map<string,bigint>)"))).select(*[c.split()[0] for c in COMMIT.split(", ")])


def commit(spark: SparkSession, rows: DataFrame, listed: DataFrame, store: str) -> None:
    """Write the rows of the ``listed`` tiles, then a record for each.

    What an earlier try left of these tiles goes first, so half-written tiles never mix with whole ones (partitions
    without rows too). Totals observed in the writing pass are held against what was read back for the records; only
    then records are written, in one file, and only tiles with a record count as done.
    """
    saved = f"{store}/data"
    for r in listed.select("tile_id").collect():  # the tiles of one commit
        _drop(spark, f"{saved}/tile_id={r['tile_id']}")
    seen = Observation("written")
    observed = rows.observe(seen, F.count(F.lit(1)).alias("patches"), F.coalesce(F.sum(F.size("failed")), F.lit(0)).alias("slots"))
    observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_id").parquet(saved)
    made = records(_saved(spark, saved).join(F.broadcast(listed.select("tile_id")), "tile_id", "left_semi"), listed).coalesce(1).cache()
    found = made.agg(F.coalesce(F.sum("n_patches"), F.lit(0)).alias("patches"), F.coalesce(F.sum("n_failed_slots"), F.lit(0)).alias("slots")).first()
    if found.asDict() != seen.get:
        raise OSError(f"{saved}: {found.asDict()} were read back, {seen.get} were written")
    made.write.mode("append").parquet(f"{store}/commits")
    made.unpersist()


def _saved(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed and other tiles; the folder is there once a tile with patches was written."""
    return spark.read.schema(KEPT).parquet(path) if _exists(spark, path) else spark.createDataFrame([], KEPT)


def committed(spark: SparkSession, store: str) -> DataFrame | None:
    """The commit records, or None where there are none. A commit that was written twice counts once."""
    path = f"{store}/commits"
    return spark.read.schema(COMMIT).parquet(path).dropDuplicates(["tile_id"]) if _exists(spark, path) else None


def build(
    spark: SparkSession, source: str, out: str, config: SignatureConfig, patch_size: int = 64, overlap: int = 0, min_valid: float = 0.8, resume: bool = True,
    dry_run: bool = False, max_tiles: int | None = None, pattern: str = "*_dem.npy", tiles_per_commit: int | None = None, index: dict | None = None,
) -> DataFrame:
    """Embed the tiles under ``source`` that have no commit record yet and save an index of all to ``out/index``.

    Returns (and saves to ``out/tiles``) one row per tile with its shape, patches, first global id and patches with
    failures, and saves the counts of all failures to ``out/failures``; a dry run only lists the tiles that would be
    worked on. Each ``tiles_per_commit`` tiles (one per core) are a commit, so a build that dies goes on after the last
    of these. ``.npy`` grids are read in blocks of rows, other files whole by the task that cuts them. Counts come from
    the commit records, so a resumed build counts all and the vectors are read once for them. ``index`` holds options of
    ``Index.build`` (an approximate index, its cells and breadth).
    """
    listed = elevation.listed(spark, source, pattern)
    if max_tiles is not None:
        listed = listed.orderBy("tile_id").limit(max_tiles)
    store = f"{out}/checkpoints/{config_key(config, patch_size, overlap, min_valid)}"
    done = committed(spark, store) if resume else None
    todo = remaining(listed, done)
    if dry_run:
        return todo.select("tile_id")
    if done is None and _exists(spark, store):
        _drop(spark, store)
    # One id and path per tile comes to the driver; a tile is tens of megabytes.
    tiles_left = todo.orderBy("tile_id").select("tile_id", "path").collect()
    size = tiles_per_commit or spark.sparkContext.defaultParallelism
    keep = tuple(c.split()[0] for c in KEPT.split(", "))[:-2]
    for lo in range(0, len(tiles_left), size):
        group = tiles_left[lo : lo + size]
        if all(r["path"].endswith(".npy") for r in group):
            own = F.col("tile_id").isin([r["tile_id"] for r in group])
            cut = elevation.patches(spark, source, own, pattern=pattern, patch_size=patch_size, overlap=overlap, min_valid=min_valid)
        else:
            cut = dem.patches(spark.read.format("binaryFile").load([r["path"] for r in group]), patch_size, overlap, min_valid)
        commit(spark, embed(cut, config, keep), spark.createDataFrame([(r["tile_id"],) for r in group], "tile_id string"), store)
    known = committed(spark, store)
    if known is None:
        raise ValueError(f"no tiles under {source}")
    known = known.join(listed.select("tile_id"), "tile_id", "left_semi")
    described = tiles(known)
    described.write.mode("overwrite").parquet(f"{out}/tiles")
    described = spark.read.parquet(f"{out}/tiles")
    failures(known).write.mode("overwrite").parquet(f"{out}/failures")
    saved = number(_saved(spark, f"{store}/data"), described)
    meta = saved.drop("embedding", "failed", "tile_h", "tile_w").withColumn("patch_size", F.lit(patch_size))
    Index.build(saved, meta, config.normalize, config.space, config.to_dict(), **(index or {})).save(f"{out}/index")
    return described


def number(saved: DataFrame, described: DataFrame) -> DataFrame:
    """Rows of committed tiles with a dense global ``patch_id`` by tile, then by id within it, which is dense itself."""
    starts = described.select("tile_id", F.col("global_id_start").alias("start"))
    return saved.join(starts, "tile_id").withColumn("patch_id", (F.col("start") + F.col("local_id")).cast("long")).drop("start")


def tiles(known: DataFrame, order: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """One row per committed tile: shape (where known), patches, first global id, and patches and slots that failed. Ids
    follow the columns ``order``, which tell tiles apart.

    The window runs over the tiles, one number each.
    """
    start = F.sum("n_patches").over(Window.orderBy(*order)) - F.col("n_patches")
    return known.select("tile_id", "tile_h", "tile_w", "n_patches", start.alias("global_id_start"), "n_failed_patches", "n_failed_slots").where("n_patches > 0").select(
        "tile_id", F.col("tile_h").alias("h"), F.col("tile_w").alias("w"), "n_patches", "global_id_start", "n_failed_patches", "n_failed_slots"
    )


def failures(known: DataFrame) -> DataFrame:
    """How many patches, and of how many tiles, each entry of ``failed`` concerns, over the whole build."""
    entries = known.select("tile_id", F.explode("entries").alias("entry", "n"))
    return entries.groupBy("entry").agg(F.sum("n").alias("n_patches"), F.count("*").alias("tiles_with_failures"))
