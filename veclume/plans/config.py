"""Options of indexes, ingest and storage."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CollectionConfig:
    dim: int = 384
    max_documents: int = 10_000
    index: str = "ann"


@dataclass(frozen=True)
class AnnConfig:
    """Degree and search width of the graph; for cells, ``probe_cells`` turns the width into cells to probe."""

    m: int = 32
    m0: int = 64
    ef_construction: int = 100
    ef_search: int = 100
    use_heuristic: bool = True
    extend_candidates: bool = False
    keep_pruned: bool = True
    seed: int = 42
    on_duplicate: str = "append"

    @property
    def level_factor(self) -> float:
        return 1.0 / math.log(self.m)

    def with_(self, **changes) -> AnnConfig:
        return replace(self, **changes)

    def probe_cells(self, cells: int, k: int) -> int:
        """More width never probes fewer cells; a width of all cells probes all."""
        return max(1, min(cells, max(self.ef_search, k)))


@dataclass(frozen=True)
class QuantizedConfig:
    ef_search: int = 50
    store_original: bool = False
    rerank_candidates: int = 0
    distance_cache: bool = True

    def beam(self, k: int) -> int:
        """Candidates kept before ranking; never fewer than asked for."""
        return max(self.rerank_candidates, self.ef_search, k) if self.rerank_candidates else max(self.ef_search, k)

    def with_reranking(self, candidates: int) -> QuantizedConfig:
        return replace(self, store_original=True, rerank_candidates=candidates)


@dataclass(frozen=True)
class BatchConfig:
    batch_size: int = 1000
    total: int | None = None
    validate: bool = True
    continue_on_error: bool = False

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError("a batch holds a document at least")


@dataclass(frozen=True)
class PaginationConfig:
    page_size: int = 10
    oversample: float = 2.0

    def __post_init__(self):
        if self.page_size < 1:
            raise ValueError("a page holds a result at least")

    def candidates(self, page: int) -> int:
        """How many results to ask an approximate index for, to fill pages up to this one after filters."""
        return math.ceil((page + 1) * self.page_size * self.oversample)


@dataclass(frozen=True)
class LogConfig:
    checkpoint_ops: int = 10_000
    max_log_bytes: int = 100 << 20
    compression: str = "gzip"
    keep_checkpoints: int = 2
