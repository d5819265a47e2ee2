"""Progress of long fits: a line at most once a minute."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

_log = logging.getLogger("softlattice")


class Ticker:
    """Counts evaluations; logs their number and rate when a minute has gone by since the last line."""

    def __init__(self, name: str, every: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.name, self.every, self.clock = name, every, clock
        self.count, self.start = 0, clock()
        self.last = self.start

    def tick(self) -> bool:
        """Counts one; whether a line was logged."""
        self.count, now = self.count + 1, self.clock()
        if now - self.last < self.every:
            return False
        self.last = now
        _log.info("%s: %d evaluations, %.3f a second", self.name, self.count, self.count / max(now - self.start, 1e-9))
        return True


class Ticking:
    """A function to maximise that ticks at each evaluation."""

    def __init__(self, f, name: str):
        self.f, self.dims, self.ticker = f, f.dims, Ticker(name)

    def __call__(self, x, grad: bool = True, hess: bool = True):
        self.ticker.tick()
        return self.f(x, grad, hess)
