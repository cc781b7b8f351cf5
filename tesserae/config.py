"""Settings: defaults, overridden by a TOML file, overridden by the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    root: str = "."
    limit: int = 5
    min_score: float = 0.0
    fts_weight: float = 1.0
    vec_weight: float = 1.0
    tag_weight: float = 0.8
    rrf_k: int = 60
    candidates: int = 30
    normalize: bool = True
    chunk_bytes: int = 6144
    embedding_model: str = "hashing"
    cache_dir: str = ""


def _typed(kind: str, value):
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](value)


def load(path: str | None = None, environ: dict[str, str] | None = None, **given) -> Config:
    """Unknown keys are ignored; what the caller gives comes last."""
    found: dict = {}
    if path:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        found.update(data.get("tesserae", data))
    env = os.environ if environ is None else environ
    for f in fields(Config):
        if (value := env.get(f"TESSERAE_{f.name.upper()}")) is not None:
            found[f.name] = value
    found.update({k: v for k, v in given.items() if v is not None})
    return replace(Config(), **{f.name: _typed(f.type, found[f.name]) for f in fields(Config) if f.name in found})
