"""Retries and a circuit breaker for calls that leave the cluster (Spark retries its own tasks), and counters of what happens."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Callable
from typing import Any


def retry(call: Callable[[], Any], attempts: int = 3, first: float = 0.1, factor: float = 2.0, most: float = 5.0, retryable: Callable[[Exception], bool] = lambda _: True, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's value; errors that are retryable are tried again after growing pauses, the last one is raised."""
    pause = first
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception as x:
            if not left or not retryable(x):
                raise
            sleep(min(pause, most))
            pause *= factor
    raise ValueError("attempts must be positive")


class CircuitOpen(Exception):
    pass


class CircuitBreaker:
    """Opens after ``failures`` errors in a row, lets one call through after ``pause`` seconds, closes when it succeeds."""

    def __init__(self, failures: int = 5, pause: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.failures, self.pause, self.clock = failures, pause, clock
        self.count, self.opened, self.lock = 0, None, threading.Lock()

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half-open" if self.clock() - self.opened >= self.pause else "open"

    def call(self, f: Callable[[], Any]) -> Any:
        with self.lock:
            if self.state == "open":
                raise CircuitOpen("the circuit is open")
            if self.state == "half-open":
                self.opened = self.clock()  # others wait for this call
        try:
            value = f()
        except Exception:
            with self.lock:
                self.count += 1
                if self.count >= self.failures:
                    self.opened = self.clock()
            raise
        with self.lock:
            self.count, self.opened = 0, None
        return value


class Metrics:
    """Counters and histograms with labels, as Prometheus text."""

    BOUNDS = (0.01, 0.1, 1.0, 10.0, 60.0, 600.0)

    def __init__(self) -> None:
        self.counters: dict[tuple, float] = defaultdict(float)
        self.histograms: dict[tuple, list[float]] = {}
        self.lock = threading.Lock()

    def count(self, name: str, n: float = 1, **labels: str) -> None:
        with self.lock:
            self.counters[name, tuple(sorted(labels.items()))] += n

    def observe(self, name: str, value: float, **labels: str) -> None:
        """A histogram holds a count for each bound, then the count and the sum of all values."""
        with self.lock:
            own = self.histograms.setdefault((name, tuple(sorted(labels.items()))), [0.0] * (len(self.BOUNDS) + 2))
            for k, bound in enumerate(self.BOUNDS):
                own[k] += value <= bound
            own[-2] += 1
            own[-1] += value

    def text(self) -> str:
        def line(name: str, labels: tuple, value: float, **more: object) -> str:
            pairs = ",".join(f'{k}="{v}"' for k, v in (*labels, *more.items()))
            return f"{name}{{{pairs}}} {value:g}" if pairs else f"{name} {value:g}"

        out = [line(n, labels, v) for (n, labels), v in sorted(self.counters.items())]
        for (n, labels), own in sorted(self.histograms.items()):
            out += [line(f"{n}_bucket", labels, v, le=b) for b, v in zip((*self.BOUNDS, "+Inf"), own[:-1], strict=True)]
            out += [line(f"{n}_count", labels, own[-2]), line(f"{n}_sum", labels, own[-1])]
        return "\n".join(out) + "\n"
