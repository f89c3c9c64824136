"""The retention job over the stored audit log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvharbor.operators import audit
from csvharbor.operators.filters import older_than
from csvharbor.sources.store import Store

STEP_ROWS = 1_000_000


@dataclass(frozen=True)
class StepResult:
    step: str
    rows: int
    error: str | None = None


def archive(store: Store, batch: str, as_of: dt.datetime, days: int = audit.ARCHIVE_AFTER_DAYS, before: dt.date | None = None) -> int:
    """Move entries past retention, or those of them before a day, to the archive; only batches that hold such entries are rewritten."""
    log = store.current("audit_log")
    is_old = older_than(log, "created_at", as_of, days=days)
    if before is not None:
        is_old = is_old & (F.col("created_at") < F.lit(before.isoformat()).cast("timestamp"))
    touched = log.filter(is_old).select("batch").distinct()
    moving = audit.to_archive(store.log("audit_log").filter(is_old), store.log("audit_log_archive"), as_of, days)
    store.write("audit_log_archive", batch, moving)
    count = store.spark.read.parquet(store.path("audit_log_archive", f"batch={batch}", "gen=0")).count()
    kept: Callable[[DataFrame], DataFrame] = lambda df: df.filter(~F.coalesce(is_old, F.lit(False)))
    store.rewrite("audit_log", kept, touched, committed=[("audit_log_archive", batch, 0)])
    return count


def archive_steps(
    store: Store, batch: str, as_of: dt.datetime, days: int = audit.ARCHIVE_AFTER_DAYS, step_rows: int = STEP_ROWS, most_steps: int | None = None
) -> int:
    """The same move in steps of whole days, oldest first, of about ``step_rows`` entries; gives the number of entries moved.

    A step's move and its removal from the log are one commit. What a stopped run has moved stays moved, and the next run,
    whatever its name, goes on with what is left; ``most_steps`` stops by itself.
    """
    log = store.log("audit_log")
    old = log.filter(older_than(log, "created_at", as_of, days=days))
    per_day = old.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")).orderBy("day").collect()  # a row per day
    ends, held = [], 0
    for row in per_day:
        held += row.n
        if held >= step_rows or row is per_day[-1]:
            ends.append(row.day + dt.timedelta(days=1))
            held = 0
    taken = {r.batch for r in store.commits().filter((F.col("table_key") == "audit_log_archive") & F.col("batch").startswith(batch)).collect()}
    moved, number = 0, 0
    for end in ends[:most_steps]:
        while f"{batch}-{number:05d}" in taken:
            number += 1
        moved += archive(store, f"{batch}-{number:05d}", as_of, days, end)
        number += 1
    return moved


def moves(store: Store) -> DataFrame:
    """Finished moves: name, entries, and the times between which they lie."""
    archived = store.current("audit_log_archive").groupBy(F.col("batch").alias("move"))
    return archived.agg(F.count("*").alias("entries"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def purge(store: Store, as_of: dt.datetime, years: int = audit.PURGE_AFTER_YEARS) -> int:
    """Drop archived entries past their years."""
    log = store.current("audit_log_archive")
    gone = log.filter(older_than(log, "created_at", as_of, years=years))
    count = gone.count()
    if count:
        store.rewrite("audit_log_archive", lambda df: audit.after_purge(df, as_of, years), gone.select("batch").distinct())
    return count


def run(
    store: Store, batch: str, as_of: dt.datetime, days: int = audit.ARCHIVE_AFTER_DAYS, years: int = audit.PURGE_AFTER_YEARS, step_rows: int | None = None
) -> list[StepResult]:
    """Archive (in steps, if ``step_rows`` is given), then purge; a failure of one step does not keep the other from running."""
    move = (lambda: archive_steps(store, batch, as_of, days, step_rows)) if step_rows else (lambda: archive(store, batch, as_of, days))
    results = []
    for step, job in (("archive", move), ("purge", lambda: purge(store, as_of, years))):
        try:
            results.append(StepResult(step, job()))
        except Exception as failure:  # noqa: BLE001 - reported to the caller
            results.append(StepResult(step, 0, str(failure)))
    return results
