"""How far a streaming load has come, from what its writes have observed; no written row is read for it."""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

PROGRESS_SCHEMA = (
    "seq int, run string, query string, micro_batch long, phase string, files long, bytes long, total_rows long, rows_inserted long, rows_skipped long, percent double"
)
COUNTED = ("total_rows", "rows_inserted", "rows_skipped")


class LoadProgress(StreamingQueryListener):
    """Appends a row when a stream starts, after each micro-batch, and when it ends (complete or failed).

    Counts are sums since the stream was started. ``percent`` is the share of the bytes that lay there at the start; without
    any it is 100. Rows are kept as Parquet files under ``path``; a restart appends to them under a run of its own.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.run, self.seq, self.expected = uuid.uuid4().hex, 0, 0
        self.done = dict.fromkeys(("files", "bytes", *COUNTED), 0)
        self.batches: dict[int, dict[str, int]] = {}
        self.ended = threading.Event()

    def follow(self, directory: str) -> None:
        """Listen from now on, and see how much there is to load: the listing alone tells."""
        lying = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory).select("length")
        self.expected = lying.groupBy().sum("length").first()[0] or 0
        self.spark.streams.addListener(self)

    def loaded(self, number: int, files: int, size: int, counts: dict[str, int]) -> None:
        """What a micro-batch has written; a batch that was committed before has no counts."""
        self.batches[number] = {"files": files, "bytes": size, **{c: counts.get(c, 0) for c in COUNTED}}

    def _append(self, batch: int, phase: str) -> None:
        percent = min(100.0, self.done["bytes"] * 100.0 / self.expected) if self.expected else 100.0
        row = (self.seq, self.run, self.name, batch, phase, *(self.done[c] for c in ("files", "bytes", *COUNTED)), percent)
        self.seq += 1
        self.spark.createDataFrame([row], PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(self.path, "progress"))

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        if event.name == self.name:
            self.id = event.runId
            self._append(-1, "starting")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        number = event.progress.batchId
        if event.progress.name == self.name and number in self.batches:
            for column, n in self.batches.pop(number).items():
                self.done[column] += n
            self._append(number, "inserting")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        if event.runId == getattr(self, "id", None):
            self._append(-1, "failed" if event.exception else "complete")
            self.ended.set()

    def finished(self, seconds: float = 60) -> bool:
        """Waits until the end of the stream has been noted, and stops listening."""
        noted = self.ended.wait(seconds)
        self.spark.streams.removeListener(self)
        return noted

    def rows(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS_SCHEMA).parquet(os.path.join(self.path, "progress")).orderBy("run", "seq")
