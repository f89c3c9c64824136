"""The load job: files to typed rows, rejected rows, load records and audit entries."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from csvharbor.functions.cells import bound, clean_record, convert, normalized, trim_record
from csvharbor.operators import audit, validate
from csvharbor.operators.joins import lookup_join
from csvharbor.session import cut
from csvharbor.sources import records
from csvharbor.sources.headers import header_positions
from csvharbor.sources.store import Store
from csvharbor.specs import TableSpec

MAX_FILES_BROADCAST = 500_000


def upload_id(batch: str, file: Column) -> Column:
    """The same file in the same batch always gets the same id, so a retried job repeats its ids."""
    digest = F.md5(F.concat(F.lit(batch + "/"), file))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


@dataclass(frozen=True)
class Incoming:
    """``rows``: file, line_number, tokens, cells, texts, parse_error. ``headers``: one row per usable file.

    ``rejected``: file and error for files without a usable header.
    """

    spec: TableSpec
    rows: DataFrame
    headers: DataFrame
    rejected: DataFrame

    def cells(self) -> dict[str, Column]:
        """Cleaned cell per field: NULL where the file or record has none."""
        return {f.name: F.get("cells", F.lit(i)) for i, f in enumerate(self.spec.fields)}

    def texts(self) -> dict[str, Column]:
        """The same without outer white space, ready for conversion."""
        return {f.name: F.get("texts", F.lit(i)) for i, f in enumerate(self.spec.fields)}


def incoming(
    spark: SparkSession,
    spec: TableSpec,
    paths: str | Sequence[str],
    mapping: Mapping[str, int] | None = None,
    strict_quotes: bool = False,
    replacement: str = "�",
    **options: str,
) -> Incoming:
    found = records.scan(spark, paths, None if mapping else spec.names, replacement, **options)
    located = cut(header_positions(found.headers, spec, mapping))
    wanted = ", ".join(spec.names)
    rejected = found.files.join(located, "file", "left_anti")
    rejected = rejected.select("file", F.lit(f"header not found (expected: {wanted})").alias("error"))
    plain = F.replace("file", F.lit(":///"), F.lit(":/"))  # a listing and a read may write the empty host differently
    given = records.given_files(spark, paths, **options).withColumn("plain", plain)
    given = given.join(found.files.select(plain.alias("plain")), "plain", "left_anti")
    rejected = rejected.unionByName(given.select("file", F.lit("empty file").alias("error")))
    data = lookup_join(found.records, located.select("file", "header_no", "positions"), ["file"], rows=MAX_FILES_BROADCAST)
    data = data.filter(F.col("record_no") > F.col("header_no"))
    raw = F.col("raw")
    rows = data.select(
        "file",
        F.col("record_no").alias("line_number"),
        records.tokenize(raw).alias("tokens"),
        "raw",
        "positions",
        (records.strict_error(raw) if strict_quotes else F.lit(None).cast("string")).alias("parse_error"),
    )
    picked = bound(F.col("tokens"), lambda tokens: F.transform("positions", lambda p: F.get(tokens, p)))
    rows = rows.withColumn("cells", clean_record(raw, picked)).withColumn("texts", trim_record(raw, F.col("cells")))
    rows = rows.drop("raw", "positions")
    return Incoming(spec, rows, located, rejected)


def typed_columns(cells: Mapping[str, Column], spec: TableSpec, as_of_year: int, trimmed: bool = False) -> list[Column]:
    """Cleaned cells to the table's stored columns; an absent cell reads as blank."""
    return [convert(normalized(cells[f.name], f), f, as_of_year, trimmed).alias(f.column) for f in spec.fields]


def with_typed(data: Incoming, as_of_year: int) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the struct ``row`` of typed values, and those values by field."""
    rows = data.rows.withColumn("row", F.struct(*typed_columns(data.texts(), data.spec, as_of_year, trimmed=True)))
    return rows, {f.name: F.col("row").getField(f.column) for f in data.spec.fields}


def judged(data: Incoming, batch: str, as_of_year: int, strict: bool = False, keep: bool = False) -> DataFrame:
    """Every record with its outcome (accepted, failed, blank), the reason, and the typed columns.

    Failed records have their cells as ``row_data``; with ``keep``, all have them.
    """
    spec, cells = data.spec, data.cells()
    rows, typed = with_typed(data, as_of_year)
    reason = F.coalesce(
        F.concat(F.lit("CSV parse error: "), F.col("parse_error")),
        validate.width_reason(F.col("tokens"), len(spec.fields)),
        validate.first_reason(cells, spec.fields, as_of_year, strict, typed),
    )
    rows = rows.withColumn("blank", records.blank_record(F.col("tokens")))
    rows = rows.withColumn("reason", F.when(~F.col("blank"), reason))
    outcome = F.when(F.col("blank"), "blank").when(F.col("reason").isNotNull(), "failed").otherwise("accepted")
    return rows.select(
        upload_id(batch, F.col("file")).alias("upload_id"),
        "line_number",
        "reason",
        (F.col("tokens") if keep else F.when(F.col("reason").isNotNull(), F.col("tokens"))).alias("row_data"),
        "row.*",
        outcome.alias("outcome"),
    )


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Total, inserted and skipped records per upload; blank records count in the total only."""
    return rows.groupBy("upload_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("outcome") == "accepted").alias("rows_inserted"),
        F.count_if(F.col("outcome") == "failed").alias("rows_skipped"),
    )


@dataclass(frozen=True)
class LoadResult:
    """``counts``: total_rows, rows_inserted, rows_skipped, as the write saw them; empty if nothing was written."""

    uploads: DataFrame
    rejected_files: DataFrame
    counts: dict[str, int]


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows that count themselves by outcome while they are written."""
    seen = Observation("load")
    of = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return rows.observe(seen, F.count("*").alias("total_rows"), of("accepted").alias("rows_inserted"), of("failed").alias("rows_skipped")), seen


def load(
    store: Store,
    spec: TableSpec,
    paths: str | Sequence[str],
    batch: str,
    as_of: dt.datetime,
    mapping: Mapping[str, int] | None = None,
    strict: bool = False,
    strict_quotes: bool = False,
    replacement: str = "�",
    admit: Callable[[str, DataFrame, dt.datetime], DataFrame] | None = None,
    **options: str,
) -> LoadResult:
    """Load files as one batch. A batch that is already committed is left as it is.

    The records are written once, split by outcome; counts come from what was written, and one commit
    makes rows, load records and audit entries visible together. ``admit`` may turn accepted records into
    failed ones first, by what other loads have brought.
    """
    spark = store.spark
    began = time.monotonic()
    data = incoming(spark, spec, paths, mapping, strict_quotes, replacement, **options)
    totals: dict[str, int] = {}
    if not store.is_committed(spec.key, batch):
        rows = judged(data, batch, as_of.year, strict, keep=admit is not None)
        if admit:
            rows = admit(batch, cut(rows), as_of)
            rows = rows.withColumn("row_data", F.when(F.col("reason").isNotNull(), F.col("row_data")))
        rows, seen = observed(rows)
        store.write(spec.key, batch, rows, partition_by=["outcome"])
        totals = seen.get
        counts = outcome_counts(store.staged(spec.key, batch))
        at = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        files = data.headers.select(upload_id(batch, F.col("file")).alias("upload_id"), "file", F.col("header").alias("csv_headers"))
        zero = F.lit(0)
        uploads = files.join(counts, "upload_id", "left").select(
            F.col("upload_id").alias("id"),
            F.lit(spec.key).alias("name"),
            F.lit("upload").alias("action"),
            F.element_at(F.split("file", "/"), -1).alias("file_name"),
            *[F.coalesce(c, zero).cast("long").alias(c) for c in ("total_rows", "rows_inserted", "rows_skipped")],
            F.lit(int((time.monotonic() - began) * 1000)).cast("long").alias("duration_ms"),
            F.lit("active").alias("status"),
            "csv_headers",
            at.alias("uploaded_at"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
            F.lit(0).cast("long").alias("seq"),
        )
        name = f"{spec.key}-{batch}"
        store.write("uploads", name, uploads)
        written = uploads.withColumn("table_key", F.col("name"))
        store.write("audit_log", name, audit.upload_entries(written, at))
        store.commit([(spec.key, batch, 0), ("uploads", name, 0), ("audit_log", name, 0)])
    store.settle(spec.key)
    mine = data.headers.select(upload_id(batch, F.col("file")).alias("id"))
    return LoadResult(store.uploads().join(mine, "id", "left_semi"), data.rejected, totals)


def rollback(store: Store, ids: DataFrame, batch: str, as_of: dt.datetime) -> DataFrame:
    """Undo loads by a state change: their rows vanish from every read, no data file is rewritten."""
    at = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    asked = ids.distinct().join(store.uploads(), "id", "left")
    reason = F.when(F.col("name").isNull(), "upload not found").when(F.col("status") == "rolled_back", "upload already rolled back")
    asked = cut(asked.withColumn("reason", reason))
    # What is there now: rows that were deleted since the load are not deleted again.
    wanted = asked.select(F.col("id").alias("upload_id"))
    stored = [lookup_join(store.rows(t.key).select("upload_id"), wanted, ["upload_id"], "left_semi") for t in store.registry.all()]
    counts = reduce(DataFrame.unionByName, stored).groupBy(F.col("upload_id").alias("id")).agg(F.count("*").alias("rows_deleted"))
    asked = cut(asked.join(counts, "id", "left").withColumn("rows_deleted", F.when(F.col("name").isNotNull(), F.coalesce("rows_deleted", F.lit(0)))))
    undone = asked.filter("reason is null").withColumn("status", F.lit("rolled_back")).withColumn("seq", F.col("seq") + 1)
    entries = undone.select("id", F.col("name").alias("table_key"), "rows_deleted")
    store.write("uploads", batch, undone.drop("reason", "rows_deleted"))
    store.write("audit_log", batch, audit.rollback_entries(entries, at))
    store.commit([("uploads", batch, 0), ("audit_log", batch, 0)])
    return asked.select("id", F.col("name").alias("table_key"), "rows_deleted", "reason")
