"""Domain constants and detector settings."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the domain.
METRIC_SUFFIXES = ("latency-50", "latency-90", "diskio", "workload", "socket", "error", "cpu", "mem")
DETECTABLE_SIGNALS = ("cpu", "latency-50", "latency-90", "socket", "error", "mem", "diskio", "workload")
INCIDENT_SIGNALS = {"cpu_saturation": ("cpu",), "db_latency": ("latency-50", "latency-90"), "network_failure": ("socket", "error")}
FAULT_TO_INCIDENT = {"cpu": "cpu_saturation", "delay": "db_latency", "loss": "network_failure", "socket": "network_failure"}
SYSTEM_NAMES = {"OB": "Online Boutique", "SS": "Sock Shop", "TT": "Train Ticket"}
METHODS = ("z_score", "threshold")


@dataclass(frozen=True)
class DetectorConfig:
    """Settings of a detection run; invalid ones raise ValueError."""

    method: str = "z_score"
    z_threshold: float = 3.0
    threshold_quantile: float = 0.95
    min_baseline_samples: int = 10
    min_value: float | None = None

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unsupported detection method: {self.method}")
        if not self.z_threshold > 0:
            raise ValueError("z_threshold must be positive")
        if not 0 < self.threshold_quantile <= 1:
            raise ValueError("threshold_quantile must be in (0, 1]")
        if self.min_baseline_samples < 2:
            raise ValueError("min_baseline_samples must be 2 or more")


def create_detector(method: str = "z_score", **options) -> DetectorConfig:
    return DetectorConfig(method=method, **options)
