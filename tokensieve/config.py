"""Options of a compression run."""

from __future__ import annotations

import os
from dataclasses import dataclass

RATIO_VARIABLE = "TOKENSIEVE_RETENTION_RATIO"


@dataclass(frozen=True)
class CompressionConfig:
    """Checked when made. Thresholds are cosines; query_chunk bounds the rows of an attention matrix held at once."""

    retention_ratio: float = 0.1
    alpha: float = 0.7
    temporal_threshold: float = 0.8
    segment_threshold: float = 0.9
    min_segments: int = 4
    query_chunk: int = 128

    def __post_init__(self) -> None:
        limits = {
            "retention_ratio": 0 < self.retention_ratio <= 1,
            "alpha": 0 <= self.alpha <= 1,
            "temporal_threshold": -1 <= self.temporal_threshold <= 1,
            "segment_threshold": -1 <= self.segment_threshold <= 1,
            "min_segments": self.min_segments >= 1,
            "query_chunk": self.query_chunk >= 1,
        }
        for name, fine in limits.items():
            if not fine:
                raise ValueError(f"{name} is out of range: {getattr(self, name)}")


def ratio_from_environment(environment: dict[str, str] | None = None) -> float:
    """The retention ratio that the environment names, 0.1 unless it does; in (0, 1]."""
    raw = (os.environ if environment is None else environment).get(RATIO_VARIABLE, "0.1")
    return CompressionConfig(retention_ratio=float(raw)).retention_ratio


def check_pruning_rate(ratio: float, pruning_rate: float) -> None:
    """A service's pruning rate has to be one less the retention ratio."""
    if abs(pruning_rate - (1.0 - ratio)) > 1e-6:
        raise ValueError(f"pruning rate {pruning_rate} doesn't fit retention ratio {ratio}")
