"""Changes to stored tables: the touched batches are rewritten and the audit entries appear with them, or neither does.

``batch`` names the change. A change whose name is committed already is left as it is, so a retry changes nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.operators import audit, changes
from csvharbor.operators.joins import distinct_keys, lookup_join
from csvharbor.session import cut
from csvharbor.sources.store import Store
from csvharbor.specs import TableSpec

Rows = Callable[[DataFrame], DataFrame]


def _at(as_of: dt.datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def _publish(store: Store, table: str, change: Rows, touched: DataFrame, entries: DataFrame, batch: str, failed: bool = False) -> None:
    store.write("audit_log", batch, entries)
    store.rewrite(table, change, touched, committed=[("audit_log", batch, 0)], failed=failed)
    store.settle(table)


def _done(store: Store, batch: str) -> bool:
    return store.is_committed("audit_log", batch)


def _rows_near(store: Store, keys: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of the batches that hold any of the keys, if the store knows them; else all rows."""
    return store.placed_rows(spec.key, store.batches_of(spec.key, keys))


def _batches_of(rows: DataFrame, keys: DataFrame, spec: TableSpec) -> DataFrame:
    return lookup_join(rows, cut(distinct_keys(keys, spec.key_columns)), spec.key_columns, "left_semi").select("batch").distinct()


def delete(store: Store, spec: TableSpec, keys: DataFrame, batch: str, as_of: dt.datetime) -> None:
    """Rows of the given keys leave the table; every one is kept in the audit log."""
    if _done(store, batch):
        return
    rows = _rows_near(store, keys, spec)
    entries = audit.delete_entries(changes.delete_rows(rows, keys, spec).changes, _at(as_of))
    _publish(store, spec.key, lambda df: changes.delete_rows(df, keys, spec).rows, _batches_of(rows, keys, spec), entries, batch)


def edit(store: Store, spec: TableSpec, edits: DataFrame, batch: str, as_of: dt.datetime, order: str | None = None) -> DataFrame:
    """Cell edits; gives back the rejected ones. Edits are checked against the whole table before a part of it is rewritten."""
    allowed, rejected = (cut(x) for x in changes.check_edits(store.keys(spec.key), edits, spec, as_of.year, order))
    if not _done(store, batch):
        rows = _rows_near(store, allowed, spec)
        per_key = changes.gathered(allowed, spec)
        applied = lambda df: changes.apply_edits(df, allowed, rejected, spec, as_of.year, per_key)
        apply: Rows = lambda df: applied(df).rows
        entries = audit.edit_entries(applied(rows).changes, _at(as_of))
        _publish(store, spec.key, apply, _batches_of(rows, allowed, spec), entries, batch)
    return rejected


def bulk_edit(store: Store, spec: TableSpec, keys: DataFrame, column: str, value: str, batch: str, as_of: dt.datetime) -> None:
    """One value for a column of many rows; an entry per changed cell and one for the whole."""
    if _done(store, batch):
        return
    rows = _rows_near(store, keys, spec)
    made = changes.bulk_edit(rows, keys, column, value, spec, as_of.year)
    entries = audit.edit_entries(made.changes, _at(as_of)).unionByName(audit.bulk_edit_entries(made.summary, _at(as_of)))
    again: Rows = lambda df: changes.bulk_edit(df, keys, column, value, spec, as_of.year).rows
    _publish(store, spec.key, again, _batches_of(rows, keys, spec), entries, batch)


def reset(store: Store, specs: list[TableSpec], batch: str, as_of: dt.datetime) -> None:
    """Empties tables, one change each, with an entry that tells how many rows there were."""
    for spec in specs:
        name = f"{batch}-{spec.key}"
        if _done(store, name):
            continue
        rows = store.placed_rows(spec.key)
        entries = audit.reset_entries(changes.reset_table(rows, spec.key).changes, _at(as_of))
        _publish(store, spec.key, lambda df: df.limit(0), rows.select("batch").distinct(), entries, name)


def delete_failed(store: Store, spec: TableSpec, uploads: DataFrame, batch: str, as_of: dt.datetime) -> None:
    """Rejected rows of the given uploads (``id``) are dropped; accepted rows stay."""
    if _done(store, batch):
        return
    placed = store.placed_failed(spec.key)
    wanted = cut(uploads.select(F.col("id").alias("upload_id")).distinct())
    touched = lookup_join(placed, wanted, ["upload_id"], "left_semi").select("batch").distinct()
    none = audit.entries(placed.select(F.lit("").alias("action"), _at(as_of).alias("created_at")).limit(0))
    _publish(store, spec.key, lambda df: changes.without_uploads(df, uploads), touched, none, batch, failed=True)
