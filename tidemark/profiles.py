"""Constants of the evaluation. A profile is one fixed set of them."""

from __future__ import annotations

from dataclasses import dataclass

PROTOCOL_VERSION = CONSTANTS_VERSION = "0.6.0"

#: Seconds of a stability window, and the tolerances of the gates and of timestamps ahead of now.
WINDOW_SECONDS, GATE_TOLERANCE, FUTURE_SECONDS = 86_400, 1e-12, 5
#: Non-empty windows of a domain that make its baseline, and how many make it an established one.
BASELINE_WINDOWS, ESTABLISHED_WINDOWS = 7, 3
#: Weight lost to clusters above which a bucket counts as collapsed.
COLLAPSE_LOSS = 0.30


@dataclass(frozen=True)
class Profile:
    name: str
    min_n_eff: float
    min_weight: float
    confidence_rate: float = 0.22
    half_life: float = 1_209_600.0
    max_age: float = 7_776_000.0
    domain_cap: float = 0.30
    similarity: float = 0.92
    burst_multiplier: float = 4.0
    early_multiplier: float = 2.0
    max_z: float = 6.0
    display_confidence: float = 0.15


BASE = Profile("BASE", min_n_eff=3.0, min_weight=1.0)
HARDENED = Profile("HARDENED", min_n_eff=3.5, min_weight=1.5, max_z=4.5, display_confidence=0.25)
PROFILES = {p.name: p for p in (BASE, HARDENED)}


def get_profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {sorted(PROFILES)}")
    return PROFILES[name]
