"""Settings, each with a default; ``from_env`` reads those that are set."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    top_k: int = 15
    probe_top_k: int = 50
    fused_top_k: int = 150
    #: Probes and rewritten queries that are searched; 0 is all.
    most_probes: int = 0
    least_rows: int = 5
    least_frequency: int = 2
    most_terms: int = 30
    least_terms: int = 2
    most_evidence: int = 50
    threshold: float = 0.35
    #: Keep the older routing, where a list asked in order is a list.
    strict: bool = False

    @classmethod
    def from_env(cls, prefix: str = "LODESTAR_", env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        read = {"int": int, "float": float, "bool": lambda v: v.strip().lower() == "true"}
        return cls(**{f.name: read[str(f.type)](env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env})
