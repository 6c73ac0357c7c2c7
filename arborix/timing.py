"""Times of the stages of a run."""

from __future__ import annotations

import os
import sys
import time
from contextlib import contextmanager

# The stages, in the order in which they are shown.
STAGES = (
    "head_hash",
    "source_scan",
    "state_read",
    "freshness_git",
    "query_cache_read",
    "graph_read",
    "graph_rebuild",
    "merge_graphs",
    "derived_index_build",
    "rg_run",
    "match_enrichment",
    "output",
    "total",
)


class Timings:
    """Seconds per stage, added up; nothing is kept or shown unless enabled (``ARBORIX_TIMINGS=1``)."""

    def __init__(self, enabled: bool | None = None):
        self.enabled = os.environ.get("ARBORIX_TIMINGS") == "1" if enabled is None else enabled
        self.began = time.monotonic()
        self.seconds: dict[str, float] = {}

    def add(self, stage: str, seconds: float) -> None:
        if self.enabled:
            self.seconds[stage] = self.seconds.get(stage, 0.0) + seconds

    @contextmanager
    def measure(self, stage: str):
        """Time a block, also one that raises."""
        t = time.monotonic()
        try:
            yield
        finally:
            self.add(stage, time.monotonic() - t)

    def line(self, label: str) -> str:
        """All stages in their order, those that never ran with 0."""
        all_ = self.seconds | {"total": time.monotonic() - self.began}
        return f"timings ({label}): " + " ".join(f"{s}={all_.get(s, 0.0):.3f}s" for s in STAGES)

    def show(self, label: str) -> None:
        if self.enabled:
            print(self.line(label), file=sys.stderr)
