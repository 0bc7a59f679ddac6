"""How far a job is, in rows and in time of the series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Name of the measures that a stream reports.
MEASURES = "seen"


def _measures(time: str) -> list:
    return [F.count(F.lit(1)).alias("n_rows"), F.max(time).alias("latest")]


def observed(rows: DataFrame, time: str = "t") -> tuple[DataFrame, Observation]:
    """The rows, and their number and latest time once an action has run on them; no pass of its own."""
    seen = Observation()
    return rows.observe(seen, *_measures(time)), seen


def reporting(stream: DataFrame, time: str = "t") -> DataFrame:
    """A stream whose batches report to a ``Progress`` listener."""
    return stream.observe(MEASURES, *_measures(time))


class Progress(StreamingQueryListener):
    """Calls ``tell(batch, n_rows, latest)`` after each micro-batch."""

    def __init__(self, tell: Callable[[int, int, float | None], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(MEASURES)
        if row is not None:
            self.tell(event.progress.batchId, row["n_rows"], row["latest"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
