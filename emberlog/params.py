"""Analysis parameters (immutable) and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Union


@dataclass(frozen=True)
class Params:
    eps: float = 0.5
    min_samples: int = 10
    density: str = "given"  # or "derived": eps and min_samples from the distances to the k-th neighbour
    burst_threshold: int = 20
    window_minutes: int = 5
    tree_max_depth: int = 8
    tree_min_leaf: int = 5
    test_size: float = 0.2
    seed: int = 42
    detection_source: str = "live"  # or "reference": use the input's own cluster column
    contamination: Union[str, float] = "auto"
    min_support: float = 0.05
    min_confidence: float = 0.7
    trees: int = 300
    subsample: int = 256

    @property
    def window_label(self) -> str:
        return f"{self.window_minutes}min"

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULTS = Params()
