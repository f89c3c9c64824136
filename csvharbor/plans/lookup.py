"""Questions to a stored table that its side tables answer: which keys it has, the rows of some keys, counts and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from csvharbor.operators import filters, history
from csvharbor.operators.filters import Filter
from csvharbor.operators.joins import distinct_keys, existing_keys, lookup_join
from csvharbor.plans import preview
from csvharbor.plans.ingest import Incoming
from csvharbor.session import cut
from csvharbor.sources import summaries
from csvharbor.sources.store import Store
from csvharbor.specs import TableSpec


def existing(store: Store, spec: TableSpec, requested: DataFrame) -> DataFrame:
    """Requested keys that the table has, from the key table alone."""
    return existing_keys(requested, store.keys(spec.key, requested if store.keyed else None), spec.key_columns)


def rows_of(store: Store, spec: TableSpec, keys: DataFrame) -> DataFrame:
    """Stored rows of the requested keys; only batches that hold one of them are read."""
    wanted = cut(distinct_keys(keys, spec.key_columns))
    near = store.placed_rows(spec.key, store.batches_with(spec.key, wanted)).drop("batch", "gen")
    return lookup_join(near, wanted, spec.key_columns, "left_semi").select(near.columns)


def previewed(store: Store, data: Incoming, as_of_year: int, strict: bool = False) -> preview.Preview:
    """The preview of files against the stored table: keys and unchanged rows from the key table, whole rows for the rest."""
    near = lambda keys: rows_of(store, data.spec, keys)
    return preview.preview(data, near, as_of_year, strict, stored_keys=store.keys(data.spec.key))


def search(store: Store, spec: TableSpec, text: str, literal: bool = False) -> DataFrame:
    """Rows with the text in any text column, in any case; files that cannot have it are not opened."""
    if not text:
        return store.rows(spec.key)
    return filters.search(store.rows_like(spec.key, filters.like_pattern(text, literal)), text, spec, literal)


def matching(store: Store, spec: TableSpec, asked: Filter) -> DataFrame:
    """Rows that fit a text filter (contains, starts, ends), by the same index; other filters look at all rows."""
    if asked.op not in ("contains", "starts", "ends"):
        return filters.apply_filters(store.rows(spec.key), [asked])
    near = store.rows_like(spec.key, filters.like_pattern(asked.value, asked.literal), [asked.column])
    return filters.apply_filters(near, [asked])


def table_counts(store: Store, specs: list[TableSpec]) -> DataFrame:
    """Row count of every table, from summaries alone."""
    counts = [summaries.row_count(store.summaries(spec.key), spec) for spec in specs]
    whole = counts[0]
    for count in counts[1:]:
        whole = whole.unionByName(count)
    return whole


def column_profile(store: Store, spec: TableSpec) -> DataFrame:
    """Sum, average, min, max and count of every numeric column, from summaries alone."""
    return summaries.numeric_profile(store.summaries(spec.key), spec)


def column_facts(store: Store, spec: TableSpec) -> DataFrame:
    """Rows, nulls, extremes, about how many different values and which quartiles of every column, from summaries alone."""
    return summaries.column_facts(store.summaries(spec.key))


def table_stats(store: Store, specs: list[TableSpec]) -> DataFrame:
    """Counts beside the newest active load of every table."""
    return history.with_latest(table_counts(store, specs), store.uploads())
