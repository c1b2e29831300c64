"""Settings of a run: defaults, files (JSON, or YAML where a parser is installed) and overrides."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values of the published configuration."""

    knn: int = 32
    hidden_dim: int = 32
    latent_dim: int = 16
    batch_size: int = 64
    learning_rate: float = 5e-5
    epochs: int = 50
    alpha: float = 0.3
    pt_lower: float = 200.0
    pt_upper: float = 1e10
    max_events: int | None = None
    seed: int = 42

    def override(self, **values) -> Settings:
        """Settings with the values that aren't None; an unknown name is an error."""
        known = {f.name for f in fields(self)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **{k: v for k, v in values.items() if v is not None})


def load(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML parser; use JSON") from e
        values = yaml.safe_load(text) or {}
    else:
        values = json.loads(text)
    return Settings().override(**values)
