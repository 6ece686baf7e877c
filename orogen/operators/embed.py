"""Signatures: every kernel of a configuration in one pass over patches ``patch_id, h, w, data``.

Python is entered once per batch of patches, whatever the number of kernels; patches of one size are one stack, and a
decomposition is computed once for all upsamplers that follow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SignatureConfig, validate
from ..functions import analysis, decomposition, spectral, terrain, texture, turing, upsampling  # noqa: F401  fills the registries
from ..functions.linear import zoom
from ..functions.registry import DECOMPOSITIONS, TERRAIN, TEXTURE, UPSAMPLERS, Registry, fill

_BATCH = 256


def stack_of(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and ``(n, h, w)`` stacks of equal-sized patches; missing cells are not-a-number."""
    for (h, w), at in frame.groupby(["h", "w"]).indices.items():
        for lo in range(0, len(at), _BATCH):
            own = at[lo : lo + _BATCH]
            yield own, np.stack([np.asarray(frame["data"].iloc[i], float).reshape(h, w) for i in own])


def _try(run, n: int, width: int, note, entry: str) -> np.ndarray:
    """Result of ``run``, or zeros and an entry for each patch of the stack where it fails."""
    try:
        return run()
    except Exception as error:  # a kernel's failure is data here: zeros and a diagnostic
        note(entry.format(type(error).__name__))
        return np.zeros((n, width))


def residuals(z: np.ndarray, r, note) -> np.ndarray:
    """Per decomposition and upsampler: statistics of the residual after a round trip down and up (A) and, if both
    ways, of what a further trip up and down takes from that (B)."""
    width = 20 if r.use_rich_analysis else 6
    slots = 1 + r.bidirectional
    crop = lambda a: a[:, : z.shape[1], : z.shape[2]]

    def measure(a: np.ndarray) -> np.ndarray:
        if r.turing:
            a = np.asarray(turing.gray_scott(a, r.turing_iterations, **r.turing_params), float)
        out = analysis.rich(a, r.include_linear, r.include_frequency) if r.use_rich_analysis else analysis.six_stats(a)
        return np.where(np.isfinite(out), out, 0.0)

    out = []
    for d in r.decomposition_methods:
        try:
            residual = DECOMPOSITIONS.run(d, z, **r.decomposition_params.get(d, {}))[1]
        except Exception:  # as in _try, for all upsamplers at once
            for u in r.upsampling_methods:
                note(f"{d}/{u}:decomp_error")
                out.append(np.zeros((len(z), width * slots)))
            continue
        for u in r.upsampling_methods:
            up = lambda a, u=u: UPSAMPLERS.run(u, a, **({"scale": r.up_scale} | r.upsampling_params.get(u, {})))
            trip: dict[str, np.ndarray] = {}

            def first(up=up, trip=trip, residual=residual):
                trip["a"] = crop(up(zoom(residual, r.down_factor, r.down_order)))
                return measure(trip["a"])

            out.append(_try(first, len(z), width, note, f"{d}/{u}:A:{{}}"))
            if r.bidirectional and "a" not in trip:
                note(f"{d}/{u}:B:no_A_to_compare")
                out.append(np.zeros((len(z), width)))
            elif r.bidirectional:
                back = lambda up=up, trip=trip, residual=residual: measure(trip["a"] - crop(zoom(up(residual), r.down_factor, r.down_order)))
                out.append(_try(back, len(z), width, note, f"{d}/{u}:B:{{}}"))
    return np.concatenate(out, axis=1)


def signature(z: np.ndarray, config: SignatureConfig, note=lambda entry: None) -> np.ndarray:
    """``(n, dim)`` signatures of a stack: decomposition, terrain, texture, residuals and spectrum, in this order."""
    z, n, out = fill(z), len(z), []
    c = config.decomposition
    if c.enabled:
        out += [_try(lambda m=m: analysis.six_stats(DECOMPOSITIONS.named(m).func(z, **(c.params.get(m) or DECOMPOSITIONS.named(m).default_params))[1]), n, 6, note, f"{m}:{{}}") for m in c.methods]
    c = config.geomorphometric
    if c.enabled:
        out += [_try(lambda m=m, c=c: terrain.stats(m, TERRAIN.run(m, z, **c.params.get(m, {}))), n, 6, note, f"{m}:{{}}") for m in c.features]
    c = config.texture
    if c.enabled:
        out += [_try(lambda m=m, c=c: TEXTURE.run(m, z, **c.params.get(m, {})), n, 10 if m == "lbp" else 6, note, f"{m}:{{}}") for m in c.features]
    if config.residuals.enabled:
        out.append(residuals(z, config.residuals, note))
    if config.directional_fft.enabled:
        out.append(spectral.directional(z, config.directional_fft.angles, config.directional_fft.stats))
    return np.concatenate(out, axis=1)


def spread(patches: DataFrame) -> DataFrame:
    """Kernels are bound by the processor, so patches are dealt out evenly, in three tasks a core or more.

    The number of partitions tells nothing of where the rows are: a file of one row group is read by one task, however many
    parts it is cut into.
    """
    if patches.isStreaming:
        return patches
    return patches.repartition(max(3 * patches.sparkSession.sparkContext.defaultParallelism, patches.rdd.getNumPartitions()))


def embed(patches: DataFrame, config: SignatureConfig, keep: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """The columns ``keep`` of each patch with its ``embedding`` and ``failed`` (entries of slots that became zeros)."""
    if wrong := validate(config):
        raise ValueError("; ".join(wrong))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, z in stack_of(frame):
                failed: list[str] = []
                values = signature(z, config, failed.append).astype(np.float32)
                yield frame[list(keep)].iloc[at].assign(embedding=list(values), failed=[failed] * len(at))

    kept = patches.select(*keep)
    schema = kept.withColumns({"embedding": F.expr("cast(array() as array<float>)"), "failed": F.expr("cast(array() as array<string>)")}).schema
    return spread(patches.select(*keep, *[c for c in ("h", "w", "data") if c not in keep])).mapInPandas(run, schema)


def statistics(patches: DataFrame, measure) -> DataFrame:
    """``patch_id, values``: what ``measure`` gives for each patch of a stack, in double precision."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, z in stack_of(frame):
                yield pd.DataFrame({"patch_id": frame["patch_id"].iloc[at].to_numpy(), "values": list(np.asarray(measure(fill(z)), float).reshape(len(at), -1))})

    return spread(patches.select("patch_id", "h", "w", "data")).mapInPandas(run, "patch_id long, values array<double>")


def diagnostics(embedded: DataFrame) -> DataFrame:
    """How many patches each entry of ``failed`` concerns."""
    return embedded.select("patch_id", F.explode("failed").alias("entry")).groupBy("entry").agg(F.countDistinct("patch_id").alias("n_patches"))


def grids(patches: DataFrame, registry: Registry, name: str, **params) -> DataFrame:
    """Kernel output cells ``patch_id, y, x`` and ``trend, residual`` (decompositions) or ``z`` (others)."""
    pair = registry is DECOMPOSITIONS
    names = ["trend", "residual"] if pair else ["z"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, z in stack_of(frame):
                out = registry.run(name, z, **params)
                out = out if pair else (out,)
                yield pd.DataFrame({"patch_id": frame["patch_id"].iloc[at].to_numpy(), "width": out[0].shape[2]} | {c: list(o.reshape(len(at), -1)) for c, o in zip(names, out, strict=True)})

    schema = "patch_id long, width int, " + ", ".join(f"{c} array<double>" for c in names)
    made = spread(patches.select("patch_id", "h", "w", "data")).mapInPandas(run, schema)
    cells = made.select("patch_id", "width", F.posexplode(F.arrays_zip(*names)).alias("i", "c"))
    return cells.select("patch_id", F.floor(F.col("i") / F.col("width")).cast("long").alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), *[F.col(f"c.{c}") for c in names])
