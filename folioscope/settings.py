"""Typed settings with environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    top_k: int = 4
    top_k_full: int = 12
    distance_threshold: float = 0.45
    fetch_factor: int = 3
    rrf_k: int = 60
    boilerplate_share: float = 0.35
    chunk_tokens: int = 450
    chunk_hard_tokens: int = 560
    recall_gate: float = 0.80
    source: str = "gemini"
    enrichment: bool = True

    @classmethod
    def load(cls, env: dict[str, str] | None = None, prefix: str = "FOLIOSCOPE_") -> Settings:
        """Quotes around a value are dropped; 1, true, yes and on are true."""
        env = dict(os.environ) if env is None else env
        out = {}
        for f in fields(cls):
            if (raw := env.get(prefix + f.name.upper())) is not None:
                value = raw.strip().strip("\"'")
                kind = type(f.default)
                out[f.name] = value.lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
        return cls(**out)
