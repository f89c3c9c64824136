"""Continuous loading of a drop directory, one batch per micro-batch."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from csvharbor.operators.joins import distinct_keys, lookup_join
from csvharbor.plans.ingest import LoadResult, load
from csvharbor.sources.store import Store
from csvharbor.specs import TableSpec
from csvharbor.streaming.progress import LoadProgress
from csvharbor.streaming.unique import KeyGate

MAX_FILES_PER_TRIGGER = 1_000
PATH_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
PROGRESS_SCHEMA = "query string, micro_batch bigint, phase string, files bigint, rows_inserted bigint, rows_skipped bigint, total_rows bigint, percent double"


def arriving_files(
    spark: SparkSession, directory: str, archive: str | None = None, max_files: int = MAX_FILES_PER_TRIGGER, max_bytes: int | None = None
) -> DataFrame:
    """Paths and sizes of new files; their content is left unread. With ``archive``, handled files move there.

    A file moves when a later micro-batch commits, so the newest batch's files stay until then. With ``max_bytes``, a
    micro-batch takes files up to that size together, however many; a larger file comes alone.
    """
    reader = spark.readStream.format("binaryFile").schema(PATH_SCHEMA)
    reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader.option("maxFilesPerTrigger", max_files)
    reader = reader.option("pathGlobFilter", "*.csv")
    if archive:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)
    return reader.load(directory).select("path", "length")


def start_load(
    store: Store,
    spec: TableSpec,
    directory: str,
    checkpoint: str,
    as_of: Callable[[], dt.datetime],
    archive: str | None = None,
    max_files: int = MAX_FILES_PER_TRIGGER,
    on_batch: Callable[[int, LoadResult], None] | None = None,
    unique_within: dt.timedelta | None = None,
    max_bytes: int | None = None,
    progress_log: LoadProgress | None = None,
    **options,
) -> StreamingQuery:
    """Load whatever has arrived, then stop.

    With ``unique_within``, rows whose key another row of this stream had less than that time before become failed rows; the
    keys are remembered beside the checkpoint, see ``KeyGate``.

    The batch id comes from the checkpoint and the files of the micro-batch: a retry, which has the same files, loads
    nothing twice, and files of another folder or stream never meet an id that is taken.
    """

    gate = KeyGate(store.spark, f"{checkpoint}-keys", spec, unique_within) if unique_within else None

    def load_batch(paths: DataFrame, number: int) -> None:
        # At most max_files short paths; the files themselves are read by the executors.
        given = paths.distinct().collect()
        names = [r.path for r in given]
        if names:
            identity = hashlib.sha256("\n".join([checkpoint, *sorted(names)]).encode()).hexdigest()[:32]
            result = load(store, spec, names, f"stream-{identity}", as_of(), admit=gate.admit if gate else None, **options)
            if progress_log:
                progress_log.loaded(number, len(names), sum(r.length for r in given), result.counts)
            if on_batch:
                on_batch(number, result)

    files = arriving_files(store.spark, directory, archive, max_files, max_bytes)
    if progress_log:
        progress_log.follow(directory)
    return (
        files.writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .queryName(f"load_{spec.key}")
        .start()
    )


def progress(store: Store, query: StreamingQuery, spec: TableSpec, expected_files: int) -> DataFrame:
    """Per finished micro-batch: files, rows inserted and skipped so far, and the share of files done."""
    loads = store.uploads().filter((F.col("name") == spec.key) & F.col("file_name").isNotNull())
    done = loads.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("rows_inserted"), F.lit(0)).alias("rows_inserted"),
        F.coalesce(F.sum("rows_skipped"), F.lit(0)).alias("rows_skipped"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
    )
    last = json.loads(query.lastProgress.json) if query.lastProgress else {}
    failed = query.exception() is not None
    phase = "failed" if failed else "inserting" if query.isActive else "complete"
    return done.select(
        F.lit(query.name).alias("query"),
        F.lit(last.get("batchId", -1)).cast("long").alias("micro_batch"),
        F.lit(phase).alias("phase"),
        "files",
        "rows_inserted",
        "rows_skipped",
        "total_rows",
        F.least(F.lit(100.0), F.col("files") * 100.0 / max(expected_files, 1)).alias("percent"),
    )


def unseen(incoming: DataFrame, table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, without keys the table has: for use inside ``foreachBatch``. Rows without a key pass."""
    payload = F.struct(*[c for c in incoming.columns if c not in keys])
    keyed = incoming.dropna(subset=keys).groupBy(*keys).agg(F.min_by(payload, F.struct(*order)).alias("r"))
    first = keyed.select(*keys, "r.*").select(incoming.columns)
    fresh = lookup_join(first, distinct_keys(table, keys), keys, "left_anti").select(incoming.columns)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return fresh.unionByName(incoming.filter(missing))
