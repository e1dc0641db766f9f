"""Progress of running checks, told at most once in a while."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener

INTERVAL_S = 0.15


class ProgressStatus(StreamingQueryListener):
    """Tells `say` how many rows a stream has taken in, and when it ended or failed. Add it with spark.streams.addListener."""

    def __init__(self, say: Callable[[str], None], interval: float = INTERVAL_S):
        self.say, self.interval = say, interval
        self._rows: dict[str, int] = {}
        self._told = 0.0

    def onQueryStarted(self, event) -> None:
        self._rows[str(event.runId)] = 0
        self.say("started")

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self._rows[run] = self._rows.get(run, 0) + event.progress.numInputRows
        if time.monotonic() - self._told >= self.interval:
            self._told = time.monotonic()
            self.say(f"{self._rows[run]} rows checked")

    def onQueryTerminated(self, event) -> None:
        rows = self._rows.pop(str(event.runId), 0)
        self.say(f"failed after {rows} rows" if event.exception else f"done after {rows} rows")
