"""Queries of this subpackage by name."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from csvharbor.workload.base import Query, table  # noqa: F401

QUERIES: dict[str, Query] = {}
#: Of what goes to a Python worker at once. Rows are texts, and Spark's own limits, 10,000 rows or 64 MB, let the buffers of both
#: sides grow to several times a batch, in memory beside the heap.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_SIZE = "4m"


def reached(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets Python workers find this package where it is not installed, whatever folder the session was started in, and sends
    them small batches, unless the session has a limit of its own."""

    @functools.wraps(run)
    def call(spark: SparkSession, *rest) -> DataFrame:
        root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            known["PYTHONPATH"] = os.pathsep.join([*paths, root])
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, BATCH_SIZE)
        return run(spark, *rest)

    return call


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        run = reached(run)
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register
