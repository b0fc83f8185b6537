import pytest

from tramline.config import FEATURE_WEIGHTS, PRESET_WEIGHTS, Config


def test_overrides_keep_other_families():
    weights = Config.preset().weights()
    assert Config.preset().remove_back_edges and not Config().remove_back_edges
    assert weights["has-form"] == PRESET_WEIGHTS["has-form"] and weights["lemma-conditional-follow"] == FEATURE_WEIGHTS["lemma-conditional-follow"] == 4.0


def test_json_and_validation():
    assert Config.from_json('{"enable-anchors": true, "threshold-missing": 0.3}') == Config(enable_anchors=True, threshold_missing=0.3)
    for bad in ({"feature_weight_overrides": {"no-such": 1.0}}, {"closing_gateway_mode": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(TypeError):
        Config.from_json('{"nothing": 1}')
    assert Config().but(enable_cutoff=True).enable_cutoff
