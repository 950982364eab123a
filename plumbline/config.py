"""Index and storage settings, with the ranges that are allowed."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import ConfigurationError
from .functions.metrics import metric_name


def _within(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ConfigurationError(f"{name} must be between {low} and {high}, not {value}")


@dataclass(frozen=True)
class IndexConfig:
    metric: str = "cosine"
    kind = "flat"

    def __post_init__(self):
        object.__setattr__(self, "metric", metric_name(self.metric))
        self.check()

    def check(self) -> None:
        pass


@dataclass(frozen=True)
class FlatConfig(IndexConfig):
    pass


@dataclass(frozen=True)
class GraphConfig(IndexConfig):
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    kind = "hnsw"

    def check(self) -> None:
        _within("m", self.m, 2, 100)
        _within("ef_construction", self.ef_construction, 10, 1000)
        _within("ef_search", self.ef_search, 10, 1000)
        if self.ef_search > self.ef_construction:
            raise ConfigurationError("ef_search must not exceed ef_construction")


@dataclass(frozen=True)
class IvfConfig(IndexConfig):
    num_clusters: int = 100
    num_probes: int = 10
    max_iterations: int = 100
    threshold: float = 0.001
    seed: int = 42
    kind = "ivf"

    def check(self) -> None:
        _within("num_clusters", self.num_clusters, 1, 10_000)
        _within("num_probes", self.num_probes, 1, self.num_clusters)
        _within("max_iterations", self.max_iterations, 1, 1000)
        _within("threshold", self.threshold, 0, 1)


@dataclass(frozen=True)
class LshConfig(IndexConfig):
    num_tables: int = 5
    num_bits: int = 8
    bucket_width: float = 4.0
    seed: int = 42
    kind = "lsh"

    def check(self) -> None:
        _within("num_tables", self.num_tables, 1, 50)
        _within("num_bits", self.num_bits, 1, 32)
        _within("bucket_width", self.bucket_width, 0.1, 100)


@dataclass(frozen=True)
class ForestConfig(IndexConfig):
    num_trees: int = 10
    max_leaf_size: int = 10
    search_k: int = -1
    seed: int = 42
    kind = "annoy"

    def check(self) -> None:
        _within("num_trees", self.num_trees, 1, 1000)
        _within("max_leaf_size", self.max_leaf_size, 1, 1000)
        if self.search_k != -1 and self.search_k < 1:
            raise ConfigurationError("search_k must be -1 or at least 1")


PRESETS: dict[str, IndexConfig] = {
    "small": FlatConfig(),
    "medium": GraphConfig(),
    "balanced": GraphConfig(),
    "fast": GraphConfig(m=8, ef_construction=100, ef_search=20),
    "accurate": GraphConfig(m=32, ef_construction=400, ef_search=100),
}
_KINDS = {c.kind: c for c in (FlatConfig, GraphConfig, IvfConfig, LshConfig, ForestConfig)}


def index_config(kind: str, **options) -> IndexConfig:
    """A configuration by its kind (flat, hnsw, ivf, lsh, annoy) or a preset's name."""
    kind = kind.lower()
    if kind in PRESETS and not options:
        return PRESETS[kind]
    if kind not in _KINDS:
        raise ConfigurationError(f"unknown index {kind!r}; there are {', '.join([*_KINDS, *PRESETS])}")
    try:
        return _KINDS[kind](**options)
    except TypeError as e:
        raise ConfigurationError(str(e)) from e


@dataclass(frozen=True)
class StorageConfig:
    """``memory``: cached snapshot; ``disk``: Parquet; ``hybrid``: Parquet with a cached reading."""

    mode: str = "disk"
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("memory", "disk", "hybrid"):
            raise ConfigurationError(f"unknown storage mode: {self.mode}")
        if self.mode != "memory" and not self.path:
            raise ConfigurationError(f"{self.mode} storage needs a path")
