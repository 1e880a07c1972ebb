"""Rows that a stream left out because they came after the watermark, counted beside its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Counts late rows of all queries that run while it is added: `rows` maps (query, batch, operator) to a count above 0.

    Stateful operators drop rows older than the watermark before any function sees them; their progress says how many.
    """

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int, str], int] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for k, operator in enumerate(p.stateOperators):
            if operator.numRowsDroppedByWatermark:
                self.rows[p.name or str(p.id), p.batchId, f"{k}:{operator.operatorName}"] = operator.numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def total(self, query: str) -> int:
        return sum(n for (name, _, _), n in self.rows.items() if name == query)

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch, operator, rows)."""
        return spark.createDataFrame([(*k, n) for k, n in self.rows.items()], "query string, batch long, operator string, rows long")
