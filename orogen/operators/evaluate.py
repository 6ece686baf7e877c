"""Separability sweeps: how well signature variants tell tiles apart."""

from __future__ import annotations

import copy
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SignatureConfig, preset
from ..sources.storage import stored
from . import vectors
from .embed import embed


def sample(patches: DataFrame, per_tile: int = 30, seed: int = 0) -> DataFrame:
    """``per_tile`` patches of each tile (all, if fewer) in the order of a seeded hash of the id."""
    order = Window.partitionBy("tile").orderBy(F.xxhash64(F.lit(seed), "patch_id"), "patch_id")
    return patches.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_tile).drop("nth")


def variant(base: SignatureConfig | None = None, **changes) -> SignatureConfig:
    config = copy.deepcopy(base or preset("residuals"))
    for key, value in changes.items():
        setattr(config.residuals, key, value)
    return config


#: Fixed: the variants that are compared.
VARIANTS = {"vanilla": {}, "bidirectional": {"bidirectional": True}, "turing": {"turing": True}, "bidir+turing": {"bidirectional": True, "turing": True}}


def score(patches: DataFrame, config: SignatureConfig) -> DataFrame:
    """Separability of z-scored signatures of ``patches`` (patch_id, tile, h, w, data), and their width.

    Signatures carry their tile along and are kept, as normalisation and separability each read them again.
    """
    kept = stored(embed(patches, config, ("patch_id", "tile")).select(F.col("tile").alias("tile_group"), "embedding"))
    embedded = kept.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return vectors.separability(vectors.normalize(embedded)).withColumn("dim", F.lit(config.total_dim()))


def compare(named: dict[str, DataFrame]) -> DataFrame:
    """Separability of each of several named sets of vectors (patch_id, tile_group, embedding), a row each."""
    return reduce(DataFrame.unionByName, [vectors.separability(v).withColumn("variant", F.lit(n)) for n, v in named.items()])


def with_gain(found: DataFrame, plain: str) -> DataFrame:
    """``found`` with the gain in per cent of each variant's ratio over that of ``plain``."""
    base = found.where(F.col("variant") == plain).select(F.col("ratio").alias("base"))
    return found.crossJoin(F.broadcast(base)).withColumn("gain_pct", (F.col("ratio") / F.col("base") - 1) * 100).drop("base")


def sweep(patches: DataFrame, configs: dict[str, SignatureConfig]) -> DataFrame:
    """One row per named configuration, over one sample of patches; rows are kept, as gains and costs read them again."""
    return reduce(DataFrame.unionByName, [stored(score(patches, c).withColumn("variant", F.lit(n))) for n, c in configs.items()])


def variants(patches: DataFrame, base: SignatureConfig | None = None) -> DataFrame:
    found = sweep(patches, {n: variant(base, **c) for n, c in VARIANTS.items()})
    plain = found.where("variant = 'vanilla'").select(F.col("dim").alias("base_dim"))
    return with_gain(found, "vanilla").crossJoin(F.broadcast(plain)).withColumn("cost", F.col("dim") / F.col("base_dim")).drop("base_dim")


def iterations(patches: DataFrame, base: SignatureConfig | None = None, steps=(0, 50, 100, 200, 500)) -> DataFrame:
    return sweep(patches, {str(n): variant(base, turing=True, turing_iterations=n) for n in steps})


def feed_kill(patches: DataFrame, base: SignatureConfig | None = None, feeds=(0.018, 0.030, 0.040, 0.062), kills=(0.050, 0.055, 0.060, 0.065), steps: int = 50) -> DataFrame:
    """Ratio for each feed (rows) and kill (columns)."""
    cells = {f"{f}/{k}": variant(base, turing=True, turing_iterations=steps, turing_params={"feed": f, "kill": k}) for f in feeds for k in kills}
    part = F.split("variant", "/")
    return sweep(patches, cells).select(part[0].alias("feed"), part[1].alias("kill"), "ratio").groupBy("feed").pivot("kill", [str(k) for k in kills]).agg(F.first("ratio"))


def best(found: DataFrame) -> DataFrame:
    """The variant of the largest ratio, the first by name of equals."""
    return found.orderBy(F.desc("ratio"), "variant").limit(1)


def save(found: DataFrame, path: str) -> None:
    """Results of a sweep as JSON lines; a sweep has a row per variant, so one file."""
    found.coalesce(1).write.mode("overwrite").json(path)
