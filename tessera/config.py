"""Settings that alter results. Values marked fixed must agree with the engine whose results these plans reproduce."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

PREFIX = "TESSERA_"
DATA_DIR = ".tessera"


@dataclass(frozen=True)
class Settings:
    # fixed values
    chunk_size: int = 1000
    chunk_overlap: int = 200
    max_file_size_bytes: int = 1_048_576
    ingestion_timeout_hours: float = 24
    default_n_results: int = 10
    max_n_results: int = 20
    hybrid_search_enabled: bool = True
    hybrid_semantic_weight: float = 0.7
    hybrid_bm25_weight: float = 0.3
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    skip_directories: tuple[str, ...] = (
        "node_modules", "__pycache__", "venv", ".venv", "dist", "build", ".git", ".idea", ".vscode", "target", ".gradle",
    )
    # our own
    embedding_provider: str = "hash"
    embedding_dim: int = 384
    ingest_batch: int = 2000  # files that are indexed and committed at once
    extra_skip: tuple[str, ...] = field(default=(DATA_DIR,))

    @property
    def pruned(self) -> tuple[str, ...]:
        return (*self.skip_directories, *self.extra_skip)

    def clamp(self, n: int | None) -> int:
        """Results asked for: 0 or None mean the default, more than the maximum is cut, negatives are refused."""
        if n is not None and n < 0:
            raise ValueError("n_results must not be negative")
        return min(n or self.default_n_results, self.max_n_results)


def from_env(env: Mapping[str, str] | None = None, legacy: tuple[str, ...] = ()) -> Settings:
    """Settings from TESSERA_* variables; a legacy prefix fills in what the current one leaves unset."""
    env = os.environ if env is None else env
    out = Settings()
    for f in fields(Settings):
        raw = next((env[p + f.name.upper()] for p in (PREFIX, *legacy) if p + f.name.upper() in env), None)
        if raw is None:
            continue
        now = getattr(out, f.name)
        if isinstance(now, bool):
            value = raw.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(now, tuple):
            value = tuple(x for x in raw.split(",") if x)
        else:
            value = type(now)(raw)
        out = replace(out, **{f.name: value})
    return out
