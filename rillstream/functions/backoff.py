"""Random exponential back-off for work on the driver."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Backoff:
    """Attempt a sleeps a random whole number of min_s, from 0 to below 2^(a+1) * scale of them; after max_attempts
    retries it gives up. at_least_min makes the shortest sleep min_s."""

    min_s: float = 0.1
    max_s: float = float("inf")
    scale: float = 1.0
    max_attempts: int = 100
    start_attempt: int = 0
    at_least_min: bool = False
    rng: random.Random = field(default_factory=random.Random, compare=False)

    def with_min(self, seconds: float) -> Backoff:
        return replace(self, min_s=seconds)

    def with_scale(self, scale: float) -> Backoff:
        return replace(self, scale=scale)

    def with_max_attempts(self, n: int) -> Backoff:
        return replace(self, max_attempts=n)

    def with_start_attempt(self, n: int) -> Backoff:
        return replace(self, start_attempt=n)

    def delay(self, attempt: int) -> float:
        steps = int(self.rng.random() * 2.0 ** (attempt + 1) * self.scale)
        return min(self.max_s, max(int(self.at_least_min), steps) * self.min_s)

    def retry(self, work: Callable, on: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
        for attempt in range(self.start_attempt, self.max_attempts + 1):
            try:
                return work()
            except on:
                if attempt == self.max_attempts:
                    raise
                sleep(self.delay(attempt))
        raise ValueError("no attempt is left")
