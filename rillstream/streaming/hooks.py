"""Hooks around the micro-batches of a stream, and streams that end by themselves."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Hook = Callable[[DataFrame, int], None]


def batch_writer(write: Hook, before: Hook | None = None, after: Hook | None = None) -> Hook:
    """For foreachBatch: before may wait (rate limits) or raise (quotas), which stops the stream with nothing written."""

    def run(batch: DataFrame, number: int) -> None:
        if before:
            before(batch, number)
        write(batch, number)
        if after:
            after(batch, number)

    return run


def stop_when_idle(query: StreamingQuery, max_idle_s: float, poll_s: float = 0.2, clock: Callable[[], float] = time.monotonic) -> None:
    """Waits until the stream has read nothing for max_idle_s or more, then stops it."""
    seen, since = -1, clock()
    while query.isActive:
        done = sum(p.numInputRows > 0 for p in query.recentProgress)
        if done != seen:
            seen, since = done, clock()
        elif clock() - since >= max_idle_s and not query.status["isTriggerActive"]:
            query.stop()
            return
        time.sleep(poll_s)


class HookedStream:
    """A running stream with work to do before and after it is closed; it can be closed once."""

    def __init__(self, query: StreamingQuery):
        self.query, self.before, self.after, self.closed = query, [], [], False

    def before_close(self, *hooks: Callable[[], None]) -> HookedStream:
        self.before += hooks
        return self

    def after_close(self, *hooks: Callable[[BaseException | None], None]) -> HookedStream:
        """Each is told what went wrong in the stream or while it was closed, None if nothing did."""
        self.after += hooks
        return self

    def close(self) -> None:
        if self.closed:
            raise RuntimeError("the stream is closed already")
        for hook in self.before:
            hook()
        error: BaseException | None = None
        try:
            self.query.processAllAvailable()
            self.query.stop()
        except Exception as e:
            error = e
        self.closed = True
        for hook in self.after:
            hook(error)
        if error is not None:
            raise error
