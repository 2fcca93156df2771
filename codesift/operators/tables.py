"""A set of named tables that are built once, on demand, from any thread."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from codesift.session import keep

# Independent rule jobs are submitted side by side; Spark schedules their tasks.
PARALLEL_JOBS = 6


class TableSet:
    label = "t"

    def __init__(self) -> None:
        self._made: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.RLock] = {}
        self._guard = threading.Lock()

    def _once(self, name: str, make: Callable[[], DataFrame], kept: bool = False, key: str | None = "file_id") -> DataFrame:
        with self._guard:
            lock = self._locks.setdefault(name, threading.RLock())
        with lock:
            if name not in self._made:
                table = make()
                self._made[name] = keep(table, key=key, label=f"{self.label}_{name}") if kept else table
            return self._made[name]

    def all_of(self, makers: dict[str, Callable[[], DataFrame]]) -> list[DataFrame]:
        """Build several kept tables; each is one small job instead of a branch of
        one huge plan, whose adaptive re-planning would dominate."""
        if len(makers) == 1:
            return [self._once(name, make, kept=True) for name, make in makers.items()]
        with ThreadPoolExecutor(PARALLEL_JOBS) as pool:
            jobs = [pool.submit(self._once, name, make, True) for name, make in makers.items()]
            return [job.result() for job in jobs]

    def beside(self, *makers: Callable[[], object]) -> list:
        """Calls that build independent tables, side by side; what they share is built once."""
        with ThreadPoolExecutor(len(makers)) as pool:
            return [job.result() for job in [pool.submit(make) for make in makers]]
