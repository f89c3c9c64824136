"""Changes to a table as pure transforms: delete, edit, bulk edit, rollback, reset.

Requests are DataFrames too (keys, edits, upload ids), so one call serves any number of them. Each
transform gives the new rows and what happened; publishing is the store's work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.functions.cells import convert
from csvharbor.functions.formats import display_key, export_value, key_value, row_json, split_key
from csvharbor.operators.joins import colliding_edits, distinct_keys, existing_keys, lookup_join
from csvharbor.operators.validate import cell_error
from csvharbor.session import cut
from csvharbor.specs import TableSpec


def key_text(spec: TableSpec) -> Column:
    return display_key([key_value(F.col(f"`{k}`"), spec.field(n).type) for n, k in zip(spec.unique_key, spec.key_columns, strict=True)])


def parse_keys(requests: DataFrame, spec: TableSpec, table: DataFrame, column: str = "row_key") -> DataFrame:
    """Key texts to typed key columns; texts with the wrong number of parts are left out."""
    n = len(spec.key_columns)
    pieces = split_key(F.col(column), n) if n > 1 else F.array(F.col(column))
    kinds = [table.schema[k].dataType for k in spec.key_columns]
    typed = [F.get(pieces, F.lit(i)).try_cast(t).alias(k) for i, (k, t) in enumerate(zip(spec.key_columns, kinds, strict=True))]
    others = [c for c in requests.columns if c != column]
    return requests.filter(pieces.isNotNull()).select(*typed, *others).dropna(subset=spec.key_columns)


def rows_of_keys(table: DataFrame, keys: DataFrame, spec: TableSpec) -> DataFrame:
    """Stored rows of the requested keys: any number of point lookups in one scan."""
    wanted = cut(distinct_keys(keys, spec.key_columns))
    return lookup_join(table, wanted, spec.key_columns, "left_semi").select(table.columns)


@dataclass(frozen=True)
class Change:
    rows: DataFrame
    changes: DataFrame


def delete_rows(table: DataFrame, keys: DataFrame, spec: TableSpec) -> Change:
    """Rows without the keys, and every deleted row as key text and JSON."""
    wanted = cut(distinct_keys(keys, spec.key_columns))
    kept = lookup_join(table, wanted, spec.key_columns, "left_anti")
    gone = lookup_join(table, wanted, spec.key_columns, "left_semi")
    shown = gone.select(F.lit(spec.key).alias("table_key"), key_text(spec).alias("row_key"), row_json(spec.fields).alias("row_data"))
    return Change(kept.select(table.columns), shown)


@dataclass(frozen=True)
class EditOutcome:
    rows: DataFrame
    changes: DataFrame
    rejected: DataFrame


def _one_of(cases: list[tuple[Column, Column]]) -> Column:
    picked = F.lit(None).cast("string")
    for condition, value in cases:
        picked = F.when(condition, value).otherwise(picked)
    return picked


def check_edits(table: DataFrame, edits: DataFrame, spec: TableSpec, as_of_year: int, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edits (key columns, ``column``, ``value``) that may be applied, and the others with status and reason.

    Of several edits to one cell, however its column is spelled, the last by ``order`` counts (without it, or if they tie,
    the greatest value) and the others are reported as superseded. The same edit given twice is one edit.
    """
    keys = spec.key_columns
    target = F.lower("column")
    known = [(target == f.name.lower(), F.lit(f.column)) for f in spec.fields]
    error = _one_of([(target == f.name.lower(), cell_error(F.col("value"), f, as_of_year, editing=True)) for f in spec.fields])
    rank = F.struct(F.col(order) if order else F.lit(0).alias("_at"), "value", "column")
    named = cut(edits.select(*keys, "column", "value", _one_of(known).alias("stored"), rank.alias("_rank")).distinct())
    cell = [*keys, F.coalesce("stored", "column").alias("_cell")]
    last = cut(named.groupBy(*cell).agg(F.max("_rank").alias("_last")))
    edits = last.select(*keys, F.col("_last.column").alias("column"), F.col("_last.value").alias("value"))
    earlier = lookup_join(named.select("*", cell[-1]), last, [*keys, "_cell"]).filter(F.col("_rank") != F.col("_last"))
    earlier = earlier.select(*keys, "column", "value", F.lit("superseded").alias("status"), F.lit("replaced by a later edit of the same cell").alias("reason"))
    reason = F.coalesce(F.when(F.col("stored").isNull(), F.concat(F.lit("column not found: "), F.col("column"))), error)
    checked = cut(edits.withColumn("stored", _one_of(known)).withColumn("reason", reason))  # every value is judged once
    invalid = checked.filter("reason is not null").withColumn("status", F.lit("invalid"))
    valid = checked.filter("reason is null")

    moves = F.col("stored").isin(*keys) & (F.col("value") != "")
    old, new = [f"_old_{k}" for k in keys], [f"_new_{k}" for k in keys]
    moving = valid.filter(moves)
    for name, k, o, n in zip(spec.unique_key, keys, old, new, strict=True):
        typed = convert(F.col("value"), spec.field(name), as_of_year).cast(table.schema[k].dataType)
        moving = moving.withColumn(o, F.col(k)).withColumn(n, F.when(F.col("stored") == k, typed).otherwise(F.col(k)))
    moving = cut(moving)
    # Two edits in one request must not claim the same new key either: the first old key gets it.
    first = cut(moving.groupBy(*new).agg(F.min(F.struct(*old)).alias("_winner")))
    contested = lookup_join(moving, first, new).filter(F.struct(*old) != F.col("_winner")).select(valid.columns)
    clash = cut(colliding_edits(moving, table, old, new, keys).select(valid.columns).unionByName(contested).distinct())
    allowed = lookup_join(valid, clash.select(*keys, "column"), [*keys, "column"], "left_anti")
    clash = clash.withColumn("status", F.lit("duplicate_key")).withColumn("reason", F.lit("key already exists"))
    return allowed, invalid.unionByName(clash).select(*keys, "column", "value", "status", "reason").unionByName(earlier)


def update_cells(table: DataFrame, edits: DataFrame, spec: TableSpec, as_of_year: int, order: str | None = None) -> EditOutcome:
    """Rows with the edits applied (blank text becomes NULL), the old and new values, and the rejected edits."""
    allowed, rejected = check_edits(table, edits, spec, as_of_year, order)
    return apply_edits(table, allowed, rejected, spec, as_of_year)


def gathered(allowed: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per key, with at most as many edits as the table has columns."""
    return cut(allowed.groupBy(*spec.key_columns).agg(F.map_from_entries(F.collect_list(F.struct("stored", "value"))).alias("_edits")))


def apply_edits(table: DataFrame, allowed: DataFrame, rejected: DataFrame, spec: TableSpec, as_of_year: int, per_key: DataFrame | None = None) -> EditOutcome:
    """Edits that ``check_edits`` has let through, applied to the table or to a part of it; ``per_key`` as by ``gathered``."""
    keys = spec.key_columns
    per_key = gathered(allowed, spec) if per_key is None else per_key
    joined = lookup_join(table, per_key, keys, "left")
    given = {f.column: F.try_element_at("_edits", F.lit(f.column)) for f in spec.fields}

    def edited(field) -> Column:
        text = given[field.column]
        typed = convert(text, field, as_of_year).cast(table.schema[field.column].dataType)
        return F.when(text.isNotNull(), typed).otherwise(F.col(f"`{field.column}`")).alias(field.column)

    fields = {f.column: f for f in spec.fields}
    rows = joined.select(*[edited(fields[c]) if c in fields else F.col(f"`{c}`") for c in table.columns])
    touched = [
        F.when(
            given[f.column].isNotNull(),
            F.struct(
                F.lit(f.name).alias("column_name"),
                export_value(F.col(f"`{f.column}`"), f.type).alias("old_value"),
                given[f.column].alias("new_value"),
            ),
        )
        for f in spec.fields
    ]
    changes = (
        joined.filter(F.col("_edits").isNotNull())
        .select(F.lit(spec.key).alias("table_key"), key_text(spec).alias("row_key"), F.inline_outer(F.array_compact(F.array(*touched))))
        .filter(F.col("column_name").isNotNull())
    )
    return EditOutcome(rows, changes, rejected)


@dataclass(frozen=True)
class BulkOutcome:
    rows: DataFrame
    changes: DataFrame
    summary: DataFrame
    unmatched: DataFrame


def bulk_edit(table: DataFrame, keys: DataFrame, column: str, value: str, spec: TableSpec, as_of_year: int) -> BulkOutcome:
    """One value for one column of many rows. Rows that already have it count as updated but are no change."""
    field = spec.field(column)
    if field is None:
        raise ValueError(f"column not found: {column}")
    if field.column in spec.key_columns:
        raise ValueError(f"cannot bulk edit unique key column: {column}")
    text = F.lit(value)
    error = table.sparkSession.range(1).select(cell_error(text, field, as_of_year).alias("e")).first().e
    if error:
        raise ValueError(f"invalid value: {error}")
    kind = table.schema[field.column].dataType
    wanted = cut(distinct_keys(keys, spec.key_columns))
    hit = lookup_join(table, wanted.withColumn("_hit", F.lit(True)), spec.key_columns, "left")
    old = F.col(f"`{field.column}`")
    typed = convert(text, field, as_of_year).cast(kind)
    rows = hit.withColumn(field.column, F.when(F.col("_hit"), typed).otherwise(old)).select(table.columns)
    changes = hit.filter(F.col("_hit") & ~old.eqNullSafe(typed)).select(
        F.lit(spec.key).alias("table_key"),
        key_text(spec).alias("row_key"),
        F.lit(field.name).alias("column_name"),
        export_value(old, field.type).alias("old_value"),
        text.alias("new_value"),
    )
    summary = hit.filter("_hit").agg(F.count("*").cast("int").alias("rows_affected")).select(
        F.lit(spec.key).alias("table_key"), F.lit(field.name).alias("column_name"), text.alias("new_value"), "rows_affected"
    )
    unmatched = wanted.join(existing_keys(wanted, table, spec.key_columns), spec.key_columns, "left_anti")
    return BulkOutcome(rows, changes, summary, unmatched)


def rollback_preview(rows: DataFrame, uploads: DataFrame, ids: DataFrame) -> DataFrame:
    """Per requested upload: table, rows to delete, whether it can be rolled back, and why not."""
    wanted = ids.select(F.col("id").alias("upload_id")).distinct()
    counts = lookup_join(rows, cut(wanted), ["upload_id"], "left_semi").groupBy("upload_id").agg(F.count("*").alias("rows_to_delete"))
    asked = ids.distinct().join(uploads.select("id", F.col("name").alias("table_key"), "status"), "id", "left")
    asked = asked.join(counts.withColumnRenamed("upload_id", "id"), "id", "left")
    reason = F.when(F.col("table_key").isNull(), "upload not found").when(F.col("status") == "rolled_back", "upload already rolled back")
    return asked.select("id", "table_key", F.coalesce("rows_to_delete", F.lit(0)).alias("rows_to_delete"), reason.alias("reason")).withColumn(
        "can_rollback", F.col("reason").isNull()
    )


@dataclass(frozen=True)
class Rollback:
    rows: DataFrame
    uploads: DataFrame
    results: DataFrame


def rollback_uploads(rows: DataFrame, uploads: DataFrame, ids: DataFrame) -> Rollback:
    """Rows without those of the active requested uploads, the uploads marked, and a result per request."""
    results = cut(rollback_preview(rows, uploads, ids))
    done = results.filter("can_rollback").select(F.col("id").alias("upload_id"))
    kept = lookup_join(rows, done, ["upload_id"], "left_anti").select(rows.columns)
    marks = done.select(F.col("upload_id").alias("id"), F.lit(True).alias("_done"))
    marked = lookup_join(uploads, marks, ["id"], "left")
    marked = marked.withColumn("status", F.when(F.col("_done"), "rolled_back").otherwise(F.col("status"))).select(uploads.columns)
    return Rollback(kept, marked, results.withColumnRenamed("rows_to_delete", "rows_deleted"))


def reset_table(table: DataFrame, key: str) -> Change:
    """No rows, and how many there were."""
    counts = table.agg(F.count("*").alias("n")).select(F.lit(key).alias("table_key"), "n")
    return Change(table.limit(0), counts)


def reset_tables(tables: dict[str, DataFrame]) -> dict[str, Change]:
    return {key: reset_table(df, key) for key, df in tables.items()}


def without_uploads(failed: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed rows without those of the given uploads."""
    return lookup_join(failed, ids.select(F.col("id").alias("upload_id")).distinct(), ["upload_id"], "left_anti").select(failed.columns)


def detach_uploads(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that outlive their upload record: kept, with the upload id cleared."""
    gone = ids.select(F.col("id").alias("upload_id")).distinct().withColumn("_gone", F.lit(True))
    marked = lookup_join(df, gone, ["upload_id"], "left")
    return marked.withColumn("upload_id", F.when(F.col("_gone"), F.lit(None).cast("string")).otherwise(F.col("upload_id"))).select(df.columns)
