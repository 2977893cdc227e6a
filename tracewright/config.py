"""Thresholds of detectors and checks (fixed values), as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR = 3_600_000_000
DAY = 24 * HOUR


@dataclass(frozen=True)
class Thresholds:
    round_trip_days: int = 30
    round_trip_ratio: float = 0.70
    round_trip_amount: int = 5000
    fan_in_senders: int = 4
    fan_in_hours: int = 72
    fan_in_total: int = 20000
    fan_out_receivers: int = 4
    fan_out_hours: int = 48
    fan_out_total: int = 20000
    critical_peers: int = 8
    smurf_low: int = 35000
    smurf_high: int = 50000
    smurf_txns: int = 3
    smurf_days: int = 14
    smurf_destinations: int = 2
    odd_from: int = 0
    odd_to: int = 5
    odd_txns: int = 3
    layer_hops: int = 3
    layer_max_hops: int = 8
    layer_amount: int = 10000
    layer_hours: int = 72
    trail_hops: int = 8
    trail_ratio: float = 0.80
    burst_minutes: int = 30
    burst_txns: int = 3
    balance_tolerance: float = 1.0
    iqr_factor: float = 3.0
    iqr_rows: int = 10
    iqr_values: int = 4
    beneficiary_z: float = 2.5
    beneficiary_new: float = 0.5
    #: Weights of a risk score's flags; they add up to 1.
    weights: dict = field(
        default_factory=lambda: {
            "round_trip": 0.20,
            "layering": 0.20,
            "fan_in": 0.10,
            "fan_out": 0.10,
            "smurfing": 0.15,
            "odd_hour": 0.08,
            "velocity": 0.07,
            "high_value": 0.05,
            "balance_breach": 0.05,
        }
    )


DEFAULT = Thresholds()
