"""The append-only audit log: entries, queries, archive and purge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from csvharbor.functions import cells, messages
from csvharbor.operators.filters import equal_if_given, in_time_range, older_than
from csvharbor.operators.views import slice_rows

DEFAULT_LIMIT = 50
EXPORT_LIMIT = 100_000
ARCHIVE_AFTER_DAYS = 90
PURGE_AFTER_YEARS = 7

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField(name, {"rows_affected": T.IntegerType(), "created_at": T.TimestampType()}.get(name, T.StringType()))
        for name in (
            "id", "action", "severity", "table_key", "user_id", "user_email", "user_name", "ip_address", "user_agent",
            "row_key", "column_name", "old_value", "new_value", "row_data", "rows_affected", "upload_id", "batch_id",
            "related_audit_id", "reason", "created_at",
        )
    ]
)
ARCHIVE_SCHEMA = T.StructType([*AUDIT_SCHEMA.fields, T.StructField("archived_at", T.TimestampType())])
_AS_GIVEN = {"id", "action", "severity", "table_key", "row_data", "created_at"}
_UUIDS = {"upload_id", "batch_id", "related_audit_id"}


def entries(df: DataFrame) -> DataFrame:
    """Rows with any audit columns to full entries: severity from the action, blanks and zero counts to NULL."""
    given = set(df.columns)

    def value(field: T.StructField) -> Column:
        name = field.name
        if name == "id":
            return F.col("id") if name in given else F.uuid()
        if name == "severity":
            return messages.severity(F.col("action"))
        if name not in given:
            return F.lit(None).cast(field.dataType)
        c = F.col(name).cast(field.dataType)
        if name in _AS_GIVEN:
            return c
        if name == "rows_affected":
            return cells.zero_to_null(c)
        if name == "ip_address":
            return cells.ip_host(c)
        return cells.to_uuid(c) if name in _UUIDS else cells.to_text(c)

    return df.select(*[value(f).alias(f.name) for f in AUDIT_SCHEMA.fields])


def _entry(df: DataFrame, action: str, created_at: Column, **columns: Column) -> DataFrame:
    """Changes to entries of one action; who did it is taken from the changes where they say so."""
    who = [c for c in ("table_key", "user_id", "user_email", "user_name", "ip_address", "user_agent") if c in df.columns]
    named = {"action": F.lit(action), "created_at": created_at, **columns}
    return entries(df.select(*[c for c in who if c not in named], *[c.alias(n) for n, c in named.items()]))


def upload_entries(uploads: DataFrame, at: Column) -> DataFrame:
    text = F.format_string("Uploaded %s: %d inserted, %d skipped", "file_name", "rows_inserted", "rows_skipped")
    return _entry(uploads, "upload", at, upload_id=F.col("id"), rows_affected=F.col("rows_inserted"), reason=text)


def edit_entries(edits: DataFrame, at: Column) -> DataFrame:
    kept = {c: F.col(c) for c in ("row_key", "column_name", "old_value", "new_value")}
    return _entry(edits, "cell_edit", at, rows_affected=F.lit(1), **kept)


def bulk_edit_entries(summary: DataFrame, at: Column) -> DataFrame:
    text = F.format_string("Bulk edited %d rows", "rows_affected")
    kept = {c: F.col(c) for c in ("column_name", "new_value", "rows_affected")}
    return _entry(summary.filter("rows_affected > 0"), "bulk_edit", at, reason=text, **kept)


def delete_entries(deleted: DataFrame, at: Column) -> DataFrame:
    return _entry(deleted, "row_delete", at, row_key=F.col("row_key"), row_data=F.col("row_data"), rows_affected=F.lit(1))


def rollback_entries(uploads: DataFrame, at: Column) -> DataFrame:
    return _entry(uploads, "upload_rollback", at, upload_id=F.col("id"), rows_affected=F.col("rows_deleted"))


def reset_entries(counts: DataFrame, at: Column) -> DataFrame:
    return _entry(counts, "table_reset", at, rows_affected=F.col("n"))


def template_entries(templates: DataFrame, change: str, at: Column) -> DataFrame:
    """``change`` is create, update or delete."""
    verb = {"create": "Created", "update": "Updated", "delete": "Deleted"}[change]
    return _entry(templates, f"template_{change}", at, reason=F.concat(F.lit(f"{verb} template: "), F.col("name")))


def from_legacy(history: DataFrame) -> DataFrame:
    """Old cell history as entries; columns the old log lacked are NULL."""
    action = F.col("action")
    renamed = history.withColumns({"action": messages.legacy_action(action), "rows_affected": F.lit(1)})
    return entries(renamed)


@dataclass(frozen=True)
class AuditFilter:
    as_of: dt.datetime
    action: str = ""
    table_key: str = ""
    severity: str = ""
    start: dt.datetime | None = None
    end: dt.datetime | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        given = {"action": self.action, "table_key": self.table_key, "severity": self.severity}
        return in_time_range(equal_if_given(log, given), "created_at", self.as_of, self.start, self.end)


def newest_first() -> list[Column]:
    return [F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def page(log: DataFrame, which: AuditFilter, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    return slice_rows(which.apply(log), newest_first(), offset, limit if limit > 0 else DEFAULT_LIMIT)


def count(log: DataFrame, which: AuditFilter) -> DataFrame:
    """Matching entries and all entries, in one row; each side reads only the columns it needs."""
    matching = which.apply(log).select(F.lit(1).alias("hit"), F.lit(0).alias("any"))
    everything = log.select(F.lit(0).alias("hit"), F.lit(1).alias("any"))
    return matching.unionAll(everything).agg(F.sum("hit").alias("matching"), F.sum("any").alias("total"))


# Export heading and the audit column under it.
EXPORT_COLUMNS = (
    ("ID", "id"), ("Timestamp", "created_at"), ("Action", "action"), ("Severity", "severity"), ("Table", "table_key"),
    ("User Email", "user_email"), ("User Name", "user_name"), ("IP Address", "ip_address"), ("Row Key", "row_key"),
    ("Column", "column_name"), ("Old Value", "old_value"), ("New Value", "new_value"), ("Rows Affected", "rows_affected"),
    ("Upload ID", "upload_id"), ("Reason", "reason"),
)


def _export_text(name: str, time_format: str) -> Column:
    if name == "created_at":
        return F.date_format(name, time_format)
    return F.coalesce(F.col(name).cast("string"), F.lit("0" if name == "rows_affected" else ""))


def newest(log: DataFrame, limit: int) -> DataFrame:
    """The newest entries. Hourly counts first give the hour that the last of them lies in, so that the sort
    sees little more than the entries asked for; entries without a time come first."""
    hours = log.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("n"))
    kind, reached, since = log.schema["created_at"].dataType, 0, None
    for row in hours.select(F.col("hour").cast("string").alias("hour"), "n").orderBy(F.col("hour").desc_nulls_first()).toLocalIterator():
        reached, since = reached + row.n, row.hour
        if reached >= limit:
            break
    recent = F.col("created_at").isNull()
    if since is not None:
        recent = recent | (F.col("created_at") >= F.lit(since).cast(kind))
    return log.filter(recent).orderBy(*newest_first()).limit(limit)


def export_rows(log: DataFrame, which: AuditFilter, limit: int | None = None) -> DataFrame:
    """The CSV layout with the time second, newest first; ``limit`` gives the capped variant."""
    matching = which.apply(log)
    ordered = newest(matching, limit) if limit else matching.orderBy(*newest_first())
    return ordered.select(*[_export_text(c, "yyyy-MM-dd HH:mm:ss").alias(h) for h, c in EXPORT_COLUMNS])


def export_rows_time_last(log: DataFrame, which: AuditFilter, limit: int = EXPORT_LIMIT) -> DataFrame:
    """The capped layout with an RFC 3339 time as the last column."""
    ordered = newest(which.apply(log), limit)
    columns = [_export_text(c, "").alias(h) for h, c in EXPORT_COLUMNS if c != "created_at"]
    return ordered.select(*columns, _export_text("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("Created At"))


def hot_part(log: DataFrame, as_of: dt.datetime, days: int = ARCHIVE_AFTER_DAYS) -> DataFrame:
    return log.filter(~F.coalesce(older_than(log, "created_at", as_of, days=days), F.lit(False)))


def to_archive(log: DataFrame, archive: DataFrame | None, as_of: dt.datetime, days: int = ARCHIVE_AFTER_DAYS) -> DataFrame:
    """Entries past retention, stamped, without those an interrupted run already moved.

    Only the archive's entries of the same period are looked at, not the whole archive.
    """
    old = log.filter(older_than(log, "created_at", as_of, days=days))
    if archive is not None:
        first = old.agg(F.min("created_at").cast("string")).first()[0]
        if first is not None:
            oldest = F.lit(first).cast(log.schema["created_at"].dataType)
            moved = archive.filter(F.col("created_at") >= oldest).select("id")
            old = old.join(moved, "id", "left_anti").select(log.columns)
    return old.withColumn("archived_at", F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))


def after_purge(archive: DataFrame, as_of: dt.datetime, years: int = PURGE_AFTER_YEARS) -> DataFrame:
    return archive.filter(~F.coalesce(older_than(archive, "created_at", as_of, years=years), F.lit(False)))


def unexpired(df: DataFrame, as_of: dt.datetime, column: str = "expires_at") -> DataFrame:
    """Rows whose expiry has not passed."""
    return df.filter(~F.coalesce(older_than(df, column, as_of), F.lit(False)))


def counts_by(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    return log.groupBy(*columns).agg(F.count("*").alias("n"))
