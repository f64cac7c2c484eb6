"""Frozen settings of the flow and policy operators (durations in microseconds)."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


@dataclass(frozen=True)
class FlowConfig:
    """Flow timeouts.

    ``chunk_rows`` bounds the rows one Python call of the active-timeout pass holds.
    """

    idle_us: int = 5 * SECOND
    active_us: int = 15 * SECOND
    activity_us: int = 1 * SECOND
    active_rule: str = "inclusive"
    chunk_rows: int = 1_000_000

    def __post_init__(self):
        if self.active_rule not in ("inclusive", "exclusive"):
            raise ValueError("active_rule must be 'inclusive' or 'exclusive'")


@dataclass(frozen=True)
class PolicyConfig:
    """Thresholds of the verdict cascade."""

    confidence_threshold: float = 0.75
    probe_window_us: int = 30 * SECOND
    min_probes: int = 5
    dedup_window_us: int = 60 * SECOND
    infrastructure_max_packets: int = 100
    dos_min_packets: int = 20
    dos_min_rate: float = 50.0
    dos_min_syn_ratio: float = 0.70
