"""A dashboard over a stream: each micro-batch is added to a table, and the next dashboard sees the whole table.

A dashboard never changes: new rows mean a new dashboard, to which selections are carried over as text. Batches are
written under their number, so that a batch that runs again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from facetloom.operators.dashboard import Dashboard, DashboardBuilder, State
from facetloom.sources.serialization import from_json, to_json


class Refreshed:
    """``declare`` turns the rows so far into a builder; ``folder`` is one that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, declare: Callable[[DataFrame], DashboardBuilder]):
        self.spark, self.folder, self.declare = spark, folder.rstrip("/"), declare
        self.dashboard: Dashboard | None = None
        self.selections = "{}"

    def _add(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        rows = self.spark.read.schema(batch.schema).option("basePath", self.folder).parquet(f"{self.folder}/batch=*").drop("batch")
        before, self.dashboard = self.dashboard, self.declare(rows).build()
        if before is not None:
            before.close()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """``trigger`` as of ``DataStreamWriter.trigger``; without one, batches follow each other."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self._add)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def select(self, selections) -> None:
        self.selections = to_json(selections, self.dashboard)

    def state(self) -> State:
        """The state of the rows so far; selections that no longer mean anything are left out."""
        return self.dashboard.calculate(from_json(self.dashboard, self.selections))
