"""Wall-clock timing of actions."""

from __future__ import annotations

import time
from collections.abc import Callable


class Timer:
    """start, stop, next and total, in seconds."""

    def __init__(self):
        self.total, self._began = 0.0, None

    def start(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def stop(self) -> float:
        took = time.perf_counter() - self._began if self._began is not None else 0.0
        self.total, self._began = self.total + took, None
        return took

    def next(self) -> float:
        took = self.stop()
        self.start()
        return took


def timed(action: Callable[[], object], rounds: int = 3, warm_up: bool = True) -> list[float]:
    """Seconds of each of ``rounds`` runs, after one that isn't counted."""
    if warm_up:
        action()
    took = []
    for _ in range(rounds):
        timer = Timer().start()
        action()
        took.append(timer.stop())
    return took
