"""Timing of queries: elapsed time from start to the last graph, result counts, batches, lap times."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Timing:
    name: str
    seconds: float
    results: int


@dataclass
class Report:
    """Timings of a batch.  The middle average leaves out the best and the worst."""

    timings: list[Timing] = field(default_factory=list)

    @property
    def total(self) -> float:
        return sum(t.seconds for t in self.timings)

    @property
    def average(self) -> float:
        return self.total / len(self.timings) if self.timings else 0.0

    @property
    def middle_average(self) -> float:
        inner = sorted(t.seconds for t in self.timings)[1:-1]
        return sum(inner) / len(inner) if inner else self.average

    def text(self) -> str:
        rows = [f"{t.name}\t{t.seconds:.6f}\t{t.results}" for t in self.timings]
        return "\n".join([*rows, f"total\t{self.total:.6f}", f"average\t{self.average:.6f}", f"middle average\t{self.middle_average:.6f}"])


def run_batch(tasks: dict[str, Callable[[], int]], repeats: int = 1) -> Report:
    """Run tasks, each returning its number of results, in order."""
    report = Report()
    for name, task in tasks.items():
        for _ in range(repeats):
            began = time.perf_counter()
            results = task()
            report.timings.append(Timing(name, time.perf_counter() - began, results))
    return report


class StopWatch:
    """Lap times since the start and since the lap before."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.laps = clock, []
        self.began = clock()

    def lap(self, note: str) -> tuple[str, float, float]:
        now = self.clock()
        before = self.laps[-1][1] if self.laps else 0.0
        self.laps.append((note, now - self.began, now - self.began - before))
        return self.laps[-1]

    def report(self) -> list[tuple[str, float, float]]:
        return list(self.laps)
