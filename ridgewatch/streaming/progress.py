"""Progress of running queries, for callers that show it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class ProgressCallback(StreamingQueryListener):
    """Calls back with the query's name, its rows so far and its rows a second after each micro-batch."""

    def __init__(self, callback: Callable[[str, int, float], None]) -> None:
        self.callback, self.rows = callback, {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.callback(p.name or str(p.id), self.rows[str(p.id)], p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.pop(str(event.id), None)
