"""Settings of an alignment run; every operator takes what it needs explicitly."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

#: Default weights of the feature families.
FEATURE_WEIGHTS = {
    "has-form": 2.0,
    "has-lemma": 8.0,
    "has-action": 5.0,
    "agent-head": 10.0,
    "patient-head": 10.0,
    "in-agent": 2.0,
    "in-patient": 2.0,
    "has-synset": 1.0,
    "has-parent-synset": 0.3,
    "lemma-conditional-pred": 4.0,
    "lemma-conditional-follow": 4.0,
    "has-discourse-marker": 10.0,
}
#: Weights of the command-line preset; families not named keep their defaults.
PRESET_WEIGHTS = {
    "has-lemma": 0.01226,
    "has-parent-synset": 0.03927,
    "in-agent": 0.19403,
    "agent-head": 0.03089,
    "has-form": 0.82536,
    "patient-head": 0.37729,
    "in-patient": 0.84569,
    "has-discourse-marker": 0.83401,
    "has-synset": 0.5691,
    "has-action": 0.95106,
}
#: Its thresholds.
PRESET_THRESHOLDS = {"threshold_missing": 0.1, "max_constrained_threshold": 0.99}
#: Parts of speech that carry no content.
STOP_POS = ("punctuation", "preposition", "determiner", "modal", "conjunction", "particle")
#: The weight of a term without tf or idf, and the similarity of everything with the dummy sentence.
MISSING_WEIGHT = 0.001
DUMMY_SIMILARITY = 0.001
DUMMY_SENTENCE = -1


@dataclass(frozen=True)
class Config:
    enable_tf_idf: bool = True
    enable_anchors: bool = False
    enable_cutoff: bool = False
    enable_wrong_order_cutoff: bool = False
    disable_restrictions: bool = False
    remove_back_edges: bool = False
    closing_gateway_mode: str = "as_written"  # or "intended"
    null_synset_matches: bool = True
    model_read_strict: bool = True
    similarity_function: str = "weighted-fake-jaccard"
    missing_predictor_type: str = "p-rel-S"
    threshold_missing: float = 0.2
    max_constrained_threshold: float = 0.95
    hypernym_chain_length: int = 3
    hypernym_multiplier: float = 0.5
    feature_weight_overrides: dict[str, float] = field(default_factory=dict)
    feature_explain_overrides: dict[str, str] = field(default_factory=dict)

    def weights(self) -> dict[str, float]:
        """Overrides replace a family's weight; families that are not overridden keep their defaults."""
        return {**FEATURE_WEIGHTS, **self.feature_weight_overrides}

    def but(self, **changes) -> Config:
        return replace(self, **changes)

    @classmethod
    def preset(cls) -> Config:
        return cls(enable_anchors=True, enable_cutoff=True, enable_wrong_order_cutoff=True, remove_back_edges=True, feature_weight_overrides=dict(PRESET_WEIGHTS), **PRESET_THRESHOLDS)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Settings by name; hyphens count as underscores, an unknown name is an error."""
        return cls(**{k.replace("-", "_").rstrip("?"): v for k, v in json.loads(text).items()})

    def __post_init__(self) -> None:
        unknown = set(self.feature_weight_overrides) - set(FEATURE_WEIGHTS)
        if unknown:
            raise ValueError(f"no such feature families: {sorted(unknown)}")
        if self.closing_gateway_mode not in ("as_written", "intended"):
            raise ValueError("closing_gateway_mode is as_written or intended")
