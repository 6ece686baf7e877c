import pytest

from orogen import config


def test_preset_widths():
    widths = {n: config.preset(n).total_dim() for n in config.PRESETS}
    assert widths == {"default": 36, "classic": 36, "texture": 16, "hybrid": 88, "minimal": 24, "residuals": 320, "residuals_extended": 960, "spectral": 48, "spectral_hybrid": 60}
    both = config.preset("residuals")
    both.residuals.bidirectional = True
    assert both.total_dim() == 640


def test_presets_are_copies_and_valid():
    config.preset("default").decomposition.methods.clear()
    assert all(config.validate(config.preset(n)) == [] for n in config.PRESETS)
    with pytest.raises(ValueError, match="spectral"):
        config.preset("nothing")


def test_yaml(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("decomposition: {enabled: false, odd: 1}\nresiduals: {enabled: true, bidirectional: true, down_factor: 0.4}\nspace: l7\nother: 2\n")
    found = config.resolve(str(path))
    assert found.enabled_types() == ["residuals"] and found.residuals.bidirectional
    assert len(config.validate(found)) == 2
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))
    assert len(config.validate(config.parse({"decomposition": {"enabled": False}}))) == 1


def test_labels_name_every_dimension():
    assert config.preset("texture").labels()[:6] == [f"glcm_{p}" for p in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")]
    assert config.preset("texture").labels()[6:8] == ["lbp_bin0", "lbp_bin1"] and config.preset("default").labels()[0].startswith("decomp_")
