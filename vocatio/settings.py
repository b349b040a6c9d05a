"""Settings of ingest and normalization, without secrets. Defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Seconds are those between requests to a live site, for whoever fetches the pages."""

    request_timeout_s: float = 30
    long_sleep_s: tuple[float, float] = (120, 300)
    sleep_per_retry_s: float = 300
    jitter_s: tuple[float, float] = (1, 4)
    max_retries: int = 1
    max_start: int = 1000
    page_step: int = 10
    batch_size: int = 3
    value_threshold: float = 0.90
    key_threshold: float = 0.94
    resolver_interval_s: float = 5
    resolver_max_tokens: int = 8192
    skills_per_posting: int = 10
    skills_per_industry: int = 20
    domains: tuple[str, ...] = ("title", "location", "seniority")
    methods: tuple[str, ...] = ("map", "fuzzy", "llm")

    def next_sleep(self, retry: int, u: float) -> float:
        """Seconds to wait before a retry; u is uniform in [0, 1)."""
        lo, hi = self.long_sleep_s
        return lo + u * (hi - lo) + self.sleep_per_retry_s * retry


DEFAULT = Settings()
