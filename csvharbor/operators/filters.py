"""Typed column filters, text search and time ranges as predicates that reach the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.specs import FieldType, TableSpec

# Operators allowed per type.
ALLOWED = {
    FieldType.TEXT: ("contains", "eq", "starts", "ends"),
    FieldType.NUMERIC: ("eq", "gte", "lte", "gt", "lt"),
    FieldType.DATE: ("eq", "gte", "lte"),
    FieldType.BOOL: ("eq",),
    FieldType.ENUM: ("eq", "in"),
}


def like_pattern(text: str, literal: bool = False) -> str:
    """LIKE pattern for user text; ``%`` and ``_`` stay wildcards unless ``literal``."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else text


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str
    literal: bool = False

    def condition(self, df: DataFrame, strict: bool = False) -> Column | None:
        c = F.col(f"`{self.column}`")
        kind = df.schema[self.column].dataType
        pattern = like_pattern(self.value, self.literal)

        def typed(text: str) -> Column:
            # The literal takes the column's type, so the column itself stays bare and the filter is pushed down.
            return F.lit(text).cast(kind)

        if self.op == "contains":
            return c.ilike(f"%{pattern}%")
        if self.op == "starts":
            return c.ilike(f"{pattern}%")
        if self.op == "ends":
            return c.ilike(f"%{pattern}")
        if self.op == "eq":
            return c == typed(self.value)
        if self.op == "gte":
            return c >= typed(self.value)
        if self.op == "lte":
            return c <= typed(self.value)
        if self.op == "gt":
            return c > typed(self.value)
        if self.op == "lt":
            return c < typed(self.value)
        if self.op == "in":
            return c.isin(*[typed(v.strip()) for v in self.value.split(",")])
        if strict:
            raise ValueError(f"unknown operator: {self.op}")
        return None


def is_allowed(op: str, kind: FieldType) -> bool:
    return op in ALLOWED[kind]


def parse_filters(request: Mapping[str, Sequence[str]], spec: TableSpec) -> list[Filter]:
    """``filter[column]`` entries with ``op:value``; unknown columns, blank values and unfit operators are left out."""
    filters = []
    for key, values in request.items():
        if not (key.startswith("filter[") and key.endswith("]")):
            continue
        field = spec.field(key[len("filter[") : -1])
        for entry in values if field else ():
            op, colon, value = entry.partition(":")
            if colon and value and is_allowed(op, field.type):
                filters.append(Filter(field.column, op, value))
    return filters


def apply_filters(df: DataFrame, filters: Iterable[Filter], strict: bool = False) -> DataFrame:
    conditions = [c for c in (f.condition(df, strict) for f in filters) if c is not None]
    return df.filter(reduce(and_, conditions)) if conditions else df


def search(df: DataFrame, text: str, spec: TableSpec, literal: bool = False) -> DataFrame:
    """Rows with the text in any text column, in any case."""
    columns = spec.of_type(FieldType.TEXT)
    if not text or not columns:
        return df
    pattern = f"%{like_pattern(text, literal)}%"
    return df.filter(reduce(or_, [F.col(f"`{f.column}`").ilike(pattern) for f in columns]))


def between(column: str, low: str | None, high: str | None) -> list[Filter]:
    """Closed range with either side optional."""
    return [Filter(column, op, v) for op, v in (("gte", low), ("lte", high)) if v]


def equal_if_given(df: DataFrame, values: Mapping[str, str | None]) -> DataFrame:
    for column, value in values.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def end_of_day(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1, seconds=-1)


def in_time_range(
    df: DataFrame,
    column: str,
    as_of: dt.datetime,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """Closed range; open sides run from 1970 to a day after ``as_of``."""
    kind = df.schema[column].dataType
    low = start or dt.datetime(1970, 1, 1)
    high = end or as_of + dt.timedelta(days=1)
    bounds = [F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind) for t in (low, high)]
    return df.filter(F.col(column).between(*bounds))


def of_upload(df: DataFrame, upload_id: str) -> DataFrame:
    return df.filter(F.col("upload_id") == upload_id) if upload_id else df


def not_deleted(uploads: DataFrame) -> DataFrame:
    return uploads.filter(F.col("deleted_at").isNull())


def older_than(df: DataFrame, column: str, as_of: dt.datetime, days: int = 0, years: int = 0) -> Column:
    """Predicate: before ``as_of`` minus the retention period (days or calendar years)."""
    kind = df.schema[column].dataType
    moment = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)
    cutoff = moment - F.make_interval(years=F.lit(years), days=F.lit(days))
    return F.col(column) < cutoff
