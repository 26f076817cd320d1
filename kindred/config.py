"""One configuration for batch and service use."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class BlockingConfig:
    tfidf_top_k: int = 10
    tfidf_min_similarity: float = 0.25
    ngram_range: tuple[int, int] = (2, 4)
    rare_min_freq: int = 2
    rare_max_freq: int = 25
    address_block_cap: int = 50
    rare_block_cap: int = 30
    address_keys: int = 4


@dataclass(frozen=True)
class ModelConfig:
    """Gradient-boosted trees; ``kind`` is one of the presets of ``model.PRESETS``."""

    kind: str = "lightgbm"
    seed: int = 42


@dataclass(frozen=True)
class Config:
    blocking: BlockingConfig = field(default_factory=BlockingConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    val_split_ratio: float = 0.20
    random_seed: int = 42
    #: The grid of decision thresholds.
    threshold_grid: tuple[float, ...] = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
    default_threshold: float = 0.65


DEFAULT = Config()


def dataset_root(official: str, fallback: str = "data") -> str:
    """The official folder if it exists, else the fallback."""
    return official if Path(official).is_dir() else fallback
