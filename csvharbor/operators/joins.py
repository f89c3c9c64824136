"""Key lookups that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from csvharbor.session import cut

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 5_000_000
BINS = 4096


def _bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 32
    return F.lit(16)


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """At most so many rows and ``BROADCAST_BYTES`` bytes. Counted, not estimated: partial sums meet, rows do not move."""
    width = reduce(add, [_bytes(f) for f in df.schema.fields])
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()
    return found.rows <= (BROADCAST_ROWS if rows is None else rows) and found.bytes <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast behind a size check; a larger side is left to a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df


def _frequent(keyed: DataFrame, on: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than so many rows; None if there cannot be any.

    Rows are counted by a hash of their key first, a few numbers per task. Only keys in bins with that many rows are counted
    one by one, so that keys which are all rare are not shuffled for it.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(BINS))
    full = keyed.groupBy(place.alias("_bin")).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows)
    bins = [r["_bin"] for r in full.select("_bin").collect()]
    if not bins:
        return None
    counts = keyed.filter(place.isin(bins)).groupBy(*on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows)
    hot = cut(counts.select(*on))
    return None if hot.isEmpty() else hot


def split_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, hot_rows: int | None = None) -> DataFrame:
    """Join of many rows to unique keys that never sends a frequent key's rows to one task.

    Keys with more than ``hot_rows`` rows meet their right rows, one per key, by broadcast where they lie, if these are
    small; every other key joins by shuffle. Rows with a NULL in their key match nothing and are kept out of the shuffle.
    """
    on, hot_rows = list(on), HOT_ROWS if hot_rows is None else hot_rows
    solid = reduce(and_, [F.col(c).isNotNull() for c in on])
    keyed = left.filter(solid)
    hot = _frequent(keyed, on, hot_rows)
    if hot is None:
        joined = keyed.join(right, on, how)
    else:
        matches = cut(right.join(small_side(hot), on, "left_semi"))
        frequent = keyed.join(small_side(hot), on, "left_semi").join(small_side(matches), on, how)
        joined = frequent.unionByName(keyed.join(small_side(hot), on, "left_anti").join(right, on, how))
    if how not in ("left", "left_outer", "left_anti"):
        return joined
    return joined.unionByName(left.filter(~solid), allowMissingColumns=True)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join to a side with unique keys: broadcast if it is small, else split. NULL keys match nothing."""
    if is_small(right, rows):
        return left.join(F.broadcast(right), list(on), how)
    return split_join(left, right, on, how, hot_rows)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with no NULL part, once each."""
    return df.select(*keys).dropna().distinct()


def existing_keys(requested: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys that the table has; all key columns are compared, never their joined text."""
    wanted = cut(distinct_keys(requested, keys))
    if is_small(wanted):
        # The table is scanned where it lies; only the keys found move.
        return table.select(*keys).dropna().join(F.broadcast(wanted), list(keys), "left_semi").distinct()
    return wanted.join(distinct_keys(table, keys), list(keys), "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str], order: str = "line_number", file: str | None = None) -> DataFrame:
    """Keys seen more than once: rows, first line, last line, occurrences after the first.

    With ``file``, lines of several files are in order of file and line, and the first and last file are told too.
    """
    place = F.struct(*([F.col(file).alias("file")] if file else []), F.col(order).alias("line"))
    counted = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(place).alias("first"), F.max(place).alias("last"))
    shown = [F.col(f"{end}.{part}").alias(f"{end}_{part}") for part in (["file"] if file else []) + ["line"] for end in ("first", "last")]
    return counted.filter("n_rows > 1").select(*keys, "n_rows", *shown, (F.col("n_rows") - 1).alias("extra"))


def duplicate_lines(df: DataFrame, keys: Sequence[str], order: str = "line_number", file: str | None = None) -> DataFrame:
    """Every line of every repeated key, one row each, so that no key gathers its lines in one place."""
    first = ["first_line", *(["first_file"] if file else [])]
    repeated = cut(duplicate_keys(df, keys, order, file).select(*keys, "n_rows", *first))
    lines = lookup_join(df.select(*keys, *([file] if file else []), order), repeated, keys, "inner")
    is_first = F.col(order) == F.col("first_line")
    return lines.withColumn("is_first", is_first & (F.col(file) == F.col("first_file")) if file else is_first)


def colliding_edits(edits: DataFrame, table: DataFrame, old: Sequence[str], new: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Edits whose new key, being another than the old one, is already in the table."""
    moved = F.lit(False)
    for before, after in zip(old, new, strict=True):
        moved = moved | ~F.col(before).eqNullSafe(F.col(after))
    moving = edits.filter(moved)
    if moving.isEmpty():
        return moving
    held = cut(existing_keys(moving.select(*new).toDF(*keys), table, keys).toDF(*new))
    return lookup_join(moving, held, new, "left_semi").select(edits.columns)
