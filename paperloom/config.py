"""Settings of the engine; none are Spark settings."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    limit_per_source: int = 20
    max_limit_per_source: int = 100
    alpha: float = 0.6
    rrf_k: int = 60
    evidence_k: float = 3.0
    snippet_words: int = 25
    keyword_words: int = 2
    title_similarity: float = 0.94
    length_ratio: float = 0.8
    block_prefix: int = 12
    hashing_dim: int = 256
    min_papers: int = 8
    max_clusters: int = 6
    min_cluster: int = 3
    min_silhouette: float = 0.02
    dominance: float = 0.8
    cluster_terms: int = 4
    min_overlap: float = 0.45
    min_support: float = 0.5
    support_window: int = 3
    support_min_words: int = 4
    max_sentences: int = 4
    summary_sentences: int = 3
    summary_attempts: int = 2
    summary_concurrency: int = 5
    prompt_version: int = 2
    backfill_batch: int = 50
    backfill_min_chars: int = 120
    cache_ttl: int = 3600
    embedding_cache: int = 8192
    relevant_grade: int = 2
    ks: tuple[int, ...] = (5, 10, 20)
    export_cap: int = 500
    apa_listed: int = 20
    apa_head: int = 19
    vancouver_listed: int = 6
    history: int = 25
    http_timeout: float = 35.0
    source_budget: float = 30.0
    http_retries: int = 2
    tool: str = "paperloom"

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be between 0 and 1")
        if self.evidence_k < 0:
            raise ValueError("evidence_k must not be negative")

    def fingerprint(self) -> str:
        """A digest of every setting, so that no cached result outlives a change of one."""
        return hashlib.sha1(repr(sorted(asdict(self).items())).encode()).hexdigest()[:16]


DEFAULTS = Settings()
