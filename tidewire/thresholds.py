"""Analysis thresholds: defaults, and validation of overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Thresholds:
    gap_interactive_s: float = 30.0
    gap_tcp_s: float = 2.5
    gap_dns_s: float = 5.0
    gap_icmp_s: float = 2.0
    gap_other_s: float = 1.0
    handshake_total_s: float = 0.3
    handshake_synack_s: float = 0.1
    rtt_warning_s: float = 0.1
    rtt_critical_s: float = 0.5
    retrans_low: int = 10
    retrans_critical: int = 100
    low_window: int = 8192
    idle_s: float = 30.0
    zombie_s: float = 60.0
    asymmetry_ratio: float = 0.3
    burst_interval_us: int = 100_000
    burst_factor: int = 3
    burst_min_packets: int = 50
    burst_merge_us: int = 200_000
    slot_us: int = 60_000_000
    session_gap_s: float = 60.0
    dns_warning_s: float = 0.1
    dns_critical_s: float = 1.0
    dns_timeout_s: float = 5.0

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0:
                raise ValueError(f"{f.name} must be a non-negative number, not {v!r}")

    def override(self, **values: float) -> Thresholds:
        return replace(self, **values)
