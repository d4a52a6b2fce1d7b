"""Settings of a worker from its environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from tidemark.profiles import BASE, get_profile


@dataclass(frozen=True)
class Config:
    queue: str = "queue"
    profile: str = BASE.name
    poll_seconds: int = 5
    suffix_rules: str = ""


def load(env: Mapping[str, str] | None = None) -> Config:
    """TIDEMARK_QUEUE, TIDEMARK_PROFILE, TIDEMARK_POLL_SECONDS, TIDEMARK_SUFFIX_RULES; a number that is none counts as unset."""
    env = os.environ if env is None else env
    seconds = env.get("TIDEMARK_POLL_SECONDS", "").strip()
    return Config(
        queue=env.get("TIDEMARK_QUEUE", "").strip() or Config.queue,
        profile=get_profile(env.get("TIDEMARK_PROFILE", "").strip() or Config.profile).name,
        poll_seconds=int(seconds) if seconds.isdecimal() and int(seconds) else Config.poll_seconds,
        suffix_rules=env.get("TIDEMARK_SUFFIX_RULES", "").strip(),
    )
