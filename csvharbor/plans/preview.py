"""The preview job: what a load would do to the table, without doing it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.functions.formats import preview_value, record_key, value_map
from csvharbor.operators import validate
from csvharbor.operators.joins import distinct_keys, duplicate_keys, duplicate_lines, existing_keys, lookup_join
from csvharbor.plans.ingest import Incoming, with_typed
from csvharbor.session import cut
from csvharbor.sources.keys import row_digest
from csvharbor.sources.records import blank_record
from csvharbor.specs import TableSpec

# Rows shown per list.
SAMPLES = {"new": 10, "update": 10, "error": 20, "duplicate": 10}


def key_of(cells: Mapping[str, Column], spec: TableSpec) -> Column:
    return record_key([cells[k] for k in spec.unique_key])


def classify(keyed: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``status`` per row: error if it has errors, update if its whole key exists, else new."""
    present = cut(existing_keys(keyed, existing, keys).withColumn("_hit", F.lit(True)))
    marked = lookup_join(keyed, present, keys, "left")
    status = F.when(F.size("errors") > 0, "error").when(F.col("_hit"), "update").otherwise("new")
    return marked.withColumn("status", status).drop("_hit")


def summary(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in all, new, update and error, and repeated keys beyond their first row: counts per key first."""
    good = F.col("status").isin("new", "update")
    per_key = classified.groupBy(*keys, "status").agg(F.count("*").alias("n"))
    keyed = good
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    extra = F.when(keyed, F.col("n") - 1).otherwise(0)

    def rows(*statuses: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status").isin(*statuses), F.col("n"))), F.lit(0))

    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        rows("new").alias("new_rows"),
        rows("update").alias("update_rows"),
        rows("error").alias("error_rows"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("duplicate_in_file"),
    )


def key_names(spec: TableSpec) -> list[str]:
    """Names for key columns beside a table's own columns, whatever those are called."""
    return [f"_key{i}" for i in range(len(spec.key_columns))]


def keyed_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A table's rows as key columns and one struct ``row``."""
    keys = [F.col(f"`{k}`").alias(n) for n, k in zip(key_names(spec), spec.key_columns, strict=True)]
    return df.select(*keys, F.struct(*[F.col(f"`{f.column}`") for f in spec.fields]).alias("row"))


def current_rows(updates: DataFrame, existing: DataFrame, spec: TableSpec) -> DataFrame:
    """One stored row per updated key; keys are not unique in the table, the least row stands for its key."""
    keys = key_names(spec)
    mine = lookup_join(keyed_rows(existing, spec), cut(distinct_keys(updates, keys)), keys, "left_semi")
    return mine.groupBy(*keys).agg(F.min("row").alias("current"))


def unchanged(updates: DataFrame, digests: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Update rows whose key stands once in the table with the same digest, with no changes, and the other update rows.

    ``digests`` has the stored keys under the table's names with ``digest``; no stored row is read.
    """
    keys = key_names(spec)
    named = digests.select(*[F.col(f"`{k}`").alias(n) for n, k in zip(keys, spec.key_columns, strict=True)], "digest")
    wanted = cut(updates.select(*keys).distinct())
    stored = lookup_join(named, wanted, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"), F.min("digest").alias("_digest"))
    marked = cut(lookup_join(updates, cut(stored), keys, "left"))
    same = (F.col("_n") == 1) & (F.col("_digest") == row_digest(spec, F.col("row")))
    told = marked.filter(same).withColumn("current", F.col("row")).withColumn("changed", F.array().cast("array<string>"))
    rest = marked.filter(~F.coalesce(same, F.lit(False)))
    return told.drop("_n", "_digest"), rest.drop("_n", "_digest")


def diffs(
    updates: DataFrame, existing: DataFrame | Callable[[DataFrame], DataFrame], spec: TableSpec, compare: str = "typed", digests: DataFrame | None = None
) -> DataFrame:
    """Changed columns of every update row (key columns, ``row`` with the typed values, ``values`` with the texts).

    ``typed`` compares values; ``text`` compares the cleaned incoming text with the stored value as shown. With ``digests``,
    typed rows that did not change are told from these alone; ``existing`` may be a function that gives the stored rows of
    some keys, and is asked for the other rows' keys only.
    """
    if digests is not None and compare == "typed":
        told, rest = unchanged(updates, digests, spec)
        return told.unionByName(diffs(rest, existing, spec, compare).select(told.columns))
    if not isinstance(existing, DataFrame):
        asked = distinct_keys(updates, key_names(spec))
        existing = existing(asked.select(*[F.col(n).alias(k) for n, k in zip(key_names(spec), spec.key_columns, strict=True)]))
    joined = lookup_join(updates, cut(current_rows(updates, existing, spec)), key_names(spec))
    changed = []
    for f in spec.fields:
        if f.column in spec.key_columns:
            continue
        current = F.col("current").getField(f.column)
        if compare == "typed":
            different = ~F.col("row").getField(f.column).eqNullSafe(current)
        else:
            text = F.try_element_at("values", F.lit(f.name))
            different = text.isNotNull() & (text != preview_value(current, f.type))
        changed.append(F.when(different, F.lit(f.name)))
    return joined.withColumn("changed", F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>"))


@dataclass(frozen=True)
class Preview:
    rows: DataFrame
    summary: DataFrame
    new: DataFrame
    updates: DataFrame
    errors: DataFrame
    duplicates: DataFrame
    duplicate_lines: DataFrame

    def samples(self) -> dict[str, DataFrame]:
        """The first few of each list, for display; the lists themselves are whole."""
        lists = {"new": self.new, "update": self.updates, "error": self.errors}
        shown = {name: df.orderBy("file", "line_number").limit(SAMPLES[name]) for name, df in lists.items()}
        shown["duplicate"] = self.duplicates.orderBy("first_file", "first_line").limit(SAMPLES["duplicate"])
        return shown


def preview(
    data: Incoming, existing: DataFrame | Callable[[DataFrame], DataFrame], as_of_year: int, strict: bool = False, compare: str = "typed",
    stored_keys: DataFrame | None = None,
) -> Preview:
    """What a load of the files would do to the rows in ``existing``.

    With ``stored_keys`` (key columns and digest, as a store's key table has them), keys and unchanged rows are known from
    these, and ``existing`` may be a function that gives the stored rows of some keys.
    """
    spec, cells = data.spec, data.cells()
    narrow = validate.width_reason(F.col("tokens"), len(spec.fields))
    read, typed = with_typed(data, as_of_year)
    reasons = validate.all_reasons(cells, spec.fields, as_of_year, strict, typed)
    errors = F.when(narrow.isNotNull(), F.array(narrow)).otherwise(reasons)
    blank = blank_record(F.col("tokens"))
    rows = read.withColumn("errors", F.when(blank, F.array().cast("array<string>")).otherwise(errors))
    rows = rows.select(
        "file",
        "line_number",
        "errors",
        blank.alias("blank"),
        F.when((F.size("errors") == 0) & ~blank, key_of(cells, spec)).alias("row_key"),
        value_map(cells).alias("values"),
        "row",
    )
    # A row without a usable key keeps NULL key columns, so it can only be new or an error.
    keys = key_names(spec)
    usable = F.col("row_key").isNotNull()
    # The files are parsed once; every list and count below reads what was parsed.
    rows = cut(rows.withColumns({n: F.when(usable, F.col("row").getField(k)) for n, k in zip(keys, spec.key_columns, strict=True)}))
    if stored_keys is None:
        known = keyed_rows(existing, spec)
    else:
        known = stored_keys.select(*[F.col(f"`{k}`").alias(n) for n, k in zip(keys, spec.key_columns, strict=True)])
    classified = classify(rows, known, keys)
    classified = classified.withColumn("status", F.when(F.col("blank"), "blank").otherwise(F.col("status"))).drop("blank")
    of = {s: classified.filter(F.col("status") == s) for s in ("new", "update", "error")}
    keyed = classified.filter("row_key is not null")
    return Preview(
        classified,
        summary(classified, keys),
        of["new"],
        diffs(of["update"], existing, spec, compare, stored_keys),
        of["error"],
        duplicate_keys(keyed, ["row_key"], file="file"),
        duplicate_lines(keyed, ["row_key"], file="file"),
    )
