"""What a run cost: seconds per stage, peak memory, matrix statistics."""

from __future__ import annotations

import contextlib
import platform
import resource
import sys
import time
from collections.abc import Iterator

from ..sinks.writers import append_jsonl


class Tracker:
    def __init__(self) -> None:
        self.stages: dict[str, float] = {}
        self.matrices: list[dict] = []
        self.models: list[dict] = []
        self.notes: dict[str, object] = {}
        self._start = time.perf_counter()

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + time.perf_counter() - start

    def report(self) -> dict:
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if sys.platform == "darwin" else 1024)
        return {
            "stages": self.stages, "total_seconds": time.perf_counter() - self._start, "driver_peak_bytes": peak, "matrices": self.matrices, "models": self.models,
            "notes": self.notes, "runtime": {"python": platform.python_version(), "machine": platform.machine()},
        }

    def write(self, path: str) -> None:
        append_jsonl(self.report(), path)
