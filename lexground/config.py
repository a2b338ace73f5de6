"""Parameters, from defaults or a YAML file; environment access."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    max_chunk_size: int = 512
    embedding_dimensions: int = 64
    embedding_max_words: int = 512
    top_k: int = 5
    graph_depth: int = 1
    supported_threshold: float = 0.65
    uncertain_threshold: float = 0.40
    store_path: str = "index"
    most_hits: int = 10

    def __post_init__(self):
        if not 1 <= self.top_k <= self.most_hits:
            raise ValueError(f"top_k is {self.top_k}, not from 1 to {self.most_hits}")


def load_config(path: str) -> Config:
    """Known keys of a YAML file, one level of sections allowed."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    flat = {k: v for k, v in raw.items() if not isinstance(v, dict)}
    for section in raw.values():
        if isinstance(section, dict):
            flat |= section
    return Config(**{f.name: flat[f.name] for f in fields(Config) if f.name in flat})


def get_env(key: str, default: str | None = None) -> str:
    found = os.environ.get(key, default)
    if found is None:
        raise EnvironmentError(f"environment variable {key} is not set")
    return found


def ensure_dirs(*paths: str) -> None:
    for p in paths:
        Path(p).mkdir(parents=True, exist_ok=True)
