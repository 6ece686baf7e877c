"""Signature configurations: planning-time values that decide which kernels run and how wide a signature is."""

from __future__ import annotations

import copy
import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .functions import analysis, decomposition, spectral, terrain, texture, upsampling  # noqa: F401  fills the registries
from .functions.registry import CORE, DECOMPOSITIONS, TERRAIN, TEXTURE, UPSAMPLERS

SPACES = ("cosinesimil", "l2", "l1")


@dataclass
class Decomposition:
    enabled: bool = True
    methods: list[str] = field(default_factory=lambda: list(CORE))
    params: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class Geomorphometric:
    enabled: bool = False
    features: list[str] = field(default_factory=lambda: ["slope", "aspect", "curvature", "tpi", "tri", "roughness"])
    params: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class Texture:
    enabled: bool = False
    features: list[str] = field(default_factory=lambda: ["glcm", "lbp"])
    params: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class Residuals:
    enabled: bool = False
    decomposition_methods: list[str] = field(default_factory=lambda: ["gaussian", "bilateral", "wavelet_dwt", "morphological"])
    upsampling_methods: list[str] = field(default_factory=lambda: ["bicubic", "lanczos", "bspline", "fft_zeropad"])
    decomposition_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    upsampling_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    use_rich_analysis: bool = True
    include_linear: bool = True
    include_frequency: bool = True
    bidirectional: bool = False
    down_factor: float = 0.5
    up_scale: int = 2
    down_order: int = 1
    turing: bool = False
    turing_iterations: int = 50
    turing_params: dict[str, float] = field(default_factory=dict)


@dataclass
class DirectionalFft:
    enabled: bool = False
    angles: list[float] = field(default_factory=lambda: [0.0, 45.0, 90.0, 135.0])
    stats: list[str] = field(default_factory=lambda: list(spectral.STATS))


@dataclass
class SignatureConfig:
    decomposition: Decomposition = field(default_factory=Decomposition)
    geomorphometric: Geomorphometric = field(default_factory=Geomorphometric)
    texture: Texture = field(default_factory=Texture)
    residuals: Residuals = field(default_factory=Residuals)
    directional_fft: DirectionalFft = field(default_factory=DirectionalFft)
    normalize: bool = True
    space: str = "cosinesimil"

    def enabled_types(self) -> list[str]:
        return [f.name for f in dataclasses.fields(self) if getattr(getattr(self, f.name), "enabled", False)]

    def labels(self) -> list[str]:
        """A label per dimension, those of residuals included."""
        from .functions.analysis import RICH, SIX

        out: list[str] = []
        if self.decomposition.enabled:
            out += [f"decomp_{m}_{s}" for m in self.decomposition.methods for s in SIX]
        if self.geomorphometric.enabled:
            out += [f"{m}_{s}" for m in self.geomorphometric.features for s in SIX]
        if self.texture.enabled:
            out += [f"{m}_{s}" for m in self.texture.features for s in texture.NAMES[m]]
        if self.residuals.enabled:
            r = self.residuals
            stats = RICH if r.use_rich_analysis else SIX
            out += [f"{d}_{u}_{slot}_{s}" for d in r.decomposition_methods for u in r.upsampling_methods for slot in ("A", "B")[: 1 + r.bidirectional] for s in stats]
        if self.directional_fft.enabled:
            out += spectral.labels(self.directional_fft.angles, self.directional_fft.stats)
        return out

    def total_dim(self) -> int:
        return len(self.labels())

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)


def parse(raw: dict[str, Any]) -> SignatureConfig:
    """Configuration from nested mappings; unknown keys are ignored."""
    config = SignatureConfig()
    for section in dataclasses.fields(config):
        value = raw.get(section.name)
        part = getattr(config, section.name)
        if dataclasses.is_dataclass(part):
            names = {f.name for f in dataclasses.fields(part)}
            for key, item in (value or {}).items():
                if key in names:
                    setattr(part, key, item)
        elif value is not None:
            setattr(config, section.name, value)
    return config


def load(path: str) -> SignatureConfig:
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    return parse(yaml.safe_load(Path(path).read_text()) or {})


def validate(config: SignatureConfig) -> list[str]:
    """What is wrong with a configuration, as messages; none if it can run."""
    found: list[str] = []
    if not config.enabled_types():
        found.append("no signature type is enabled")

    def known(names, registry, what):
        found.extend(f"unknown {what} {n!r}" for n in names if n not in registry)

    if config.decomposition.enabled:
        known(config.decomposition.methods, CORE, "decomposition")
    if config.geomorphometric.enabled:
        known(config.geomorphometric.features, TERRAIN, "terrain feature")
    if config.texture.enabled:
        known(config.texture.features, TEXTURE, "texture feature")
    r = config.residuals
    if r.enabled:
        known(r.decomposition_methods, DECOMPOSITIONS, "decomposition")
        known(r.upsampling_methods, UPSAMPLERS, "upsampler")
        if abs(r.down_factor * r.up_scale - 1) > 1e-6:
            found.append("down_factor times up_scale must be 1")
        if not 0 <= r.down_order <= 5:
            found.append("down_order must be from 0 to 5")
        if r.turing and r.turing_iterations < 0:
            found.append("turing_iterations must not be negative")
    if config.directional_fft.enabled:
        known(config.directional_fft.stats, spectral.STATS, "spectral statistic")
        found.extend(f"angle {a!r} is not a number" for a in config.directional_fft.angles if isinstance(a, bool) or not isinstance(a, int | float))
    if config.space not in SPACES:
        found.append(f"unknown space {config.space!r}")
    return found


def _only(*types: str, **sections) -> SignatureConfig:
    config = SignatureConfig()
    for f in dataclasses.fields(config):
        part = getattr(config, f.name)
        if dataclasses.is_dataclass(part):
            part.enabled = f.name in types
            for key, value in sections.get(f.name, {}).items():
                setattr(part, key, value)
    return config


#: Fixed: the shipped presets, of 36, 36, 16, 88, 24, 320, 960, 48 and 60 dimensions.
PRESETS: dict[str, SignatureConfig] = {
    "default": _only("decomposition"),
    "classic": _only("geomorphometric"),
    "texture": _only("texture"),
    "hybrid": _only("decomposition", "geomorphometric", "texture"),
    "minimal": _only("decomposition", "geomorphometric", decomposition={"methods": ["gaussian", "morphological"]}, geomorphometric={"features": ["slope", "curvature"]}),
    "residuals": _only("residuals"),
    "residuals_extended": _only(
        "residuals",
        residuals={
            "decomposition_methods": ["gaussian", "bilateral", "wavelet_dwt", "morphological", "tophat", "polynomial", "dog", "guided"],
            "upsampling_methods": ["bicubic", "lanczos", "bspline", "fft_zeropad", "sinc_hamming", "cubic_mitchell"],
        },
    ),
    "spectral": _only("directional_fft", directional_fft={"angles": [0.0, 22.5, 45.0, 67.5, 90.0, 112.5, 135.0, 157.5]}),
    "spectral_hybrid": _only("decomposition", "directional_fft"),
}


def preset(name: str) -> SignatureConfig:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return copy.deepcopy(PRESETS[name])


def resolve(name: str) -> SignatureConfig:
    """A configuration by path if there is such a file, else by the name of a preset."""
    return load(name) if Path(name).exists() else preset(name)
