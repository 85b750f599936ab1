"""Throughput of streams, gathered from their progress events."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Throughput(StreamingQueryListener):
    """Rows, micro-batches and seconds of every stream of a session by its run; `each` is called every so many rows."""

    def __init__(self, every: int = 0, each=None):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self.ended: set[str] = set()
        self._every, self._each = every, each

    def onQueryStarted(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        self.rows[run], self.batches[run], self.seconds[run] = 0, 0, 0.0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        run, before = str(p.runId), self.rows.get(str(p.runId), 0)
        self.rows[run] = before + p.numInputRows
        self.batches[run] = self.batches.get(run, 0) + 1
        self.seconds[run] = self.seconds.get(run, 0.0) + p.batchDuration / 1000
        if self._each and self._every and self.rows[run] // self._every > before // self._every:
            self._each(run, self.rows[run])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))

    def rate(self, run: str) -> float | None:
        """Rows a second; None before anything was read."""
        return self.rows[run] / self.seconds[run] if self.seconds.get(run) else None


def watched(spark: SparkSession, every: int = 0, each=None) -> Throughput:
    listener = Throughput(every, each)
    spark.streams.addListener(listener)
    return listener
