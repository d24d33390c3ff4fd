"""Keeping the source queries alive, and telling how they are."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Seconds of the first pause, the longest pause, and restarts in a row after which a query is dead.
BACKOFF, LONGEST, RESTARTS = 2.0, 60.0, 5


@dataclass
class Watched:
    start: Callable[[], StreamingQuery]
    interval: float
    query: StreamingQuery | None = None
    failures: int = 0
    next_try: float = 0.0
    last_batch: float = 0.0
    rows: int = 0
    warnings: list[str] = field(default_factory=list)


class Supervisor:
    """Restarts queries that failed, each pause twice the last; one that keeps failing is left dead and shown so."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.watched = clock, {}

    def add(self, name: str, start: Callable[[], StreamingQuery], interval: float = 30.0) -> None:
        self.watched[name] = Watched(start, interval)

    def poll(self) -> None:
        """Start what isn't running and may be; call it again and again."""
        now = self.clock()
        for w in self.watched.values():
            if w.query is not None and not w.query.isActive:
                error = w.query.exception()
                w.query = None
                if error is not None:
                    self._failed(w, str(error).splitlines()[0][:200])
            if w.query is None and w.failures < RESTARTS and now >= w.next_try:
                try:
                    w.query = w.start()
                except Exception as e:  # a source that can't start is a failure like any other
                    self._failed(w, str(e).splitlines()[0][:200])

    def _failed(self, w: Watched, why: str) -> None:
        w.failures += 1
        w.warnings = [*w.warnings[-9:], why]
        w.next_try = self.clock() + min(LONGEST, BACKOFF * 2 ** (w.failures - 1))

    def progressed(self, name: str, rows: int) -> None:
        """A batch ended well: failures are forgotten."""
        w = self.watched[name]
        w.failures, w.last_batch, w.rows = 0, self.clock(), w.rows + rows

    def health(self) -> list[dict]:
        """Of each query: dead, waiting, stale (nothing for three intervals), degraded (warnings) or ok."""
        now, out = self.clock(), []
        for name, w in self.watched.items():
            if w.failures >= RESTARTS:
                state = "dead"
            elif w.query is None:
                state = "waiting"
            elif w.last_batch and now - w.last_batch > 3 * w.interval:
                state = "stale"
            else:
                state = "degraded" if w.warnings else "ok"
            out.append({"source": name, "state": state, "rows": w.rows, "failures": w.failures, "warnings": list(w.warnings)})
        return out

    def stop(self) -> None:
        for w in self.watched.values():
            if w.query is not None:
                w.query.stop()


class Progress(StreamingQueryListener):
    """Tells a supervisor of the batches of the queries that it started; add it with spark.streams.addListener."""

    def __init__(self, supervisor: Supervisor):
        self.supervisor = supervisor

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name in self.supervisor.watched:
            self.supervisor.progressed(event.progress.name, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
