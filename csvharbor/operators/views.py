"""Table views: sort, pages, numeric profile, saved views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.operators.filters import Filter, apply_filters, search
from csvharbor.session import scratch
from csvharbor.specs import FieldType, TableSpec

PAGE_SIZE = 25
DEEP_OFFSET = 5_000
MAX_SORTS = 2
Sort = tuple[str, str]


def parse_sorts(columns: str, directions: str = "") -> list[Sort]:
    """``a,b`` with ``desc,asc``: at most two levels, any direction but ``desc`` ascends."""
    given = [d.strip() for d in directions.split(",")]
    sorts = []
    for i, column in enumerate(columns.split(",")):
        if column.strip():
            sorts.append((column.strip(), "desc" if i < len(given) and given[i] == "desc" else "asc"))
    return sorts[:MAX_SORTS]


def effective_sorts(sorts: Sequence[Sort], spec: TableSpec) -> list[Sort]:
    known = [(spec.field(c).name, "desc" if d.lower() == "desc" else "asc") for c, d in sorts if spec.field(c)]
    return known[:MAX_SORTS] or [(spec.fields[0].name, "asc")]


def ordering(sorts: Sequence[Sort], spec: TableSpec) -> list[Column]:
    """NULLs last ascending, first descending; the unique key breaks ties."""
    chosen = effective_sorts(sorts, spec)
    order = []
    for name, direction in chosen:
        c = F.col(f"`{spec.resolve(name)}`")
        order.append(c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last())
    sorted_by = {spec.resolve(name) for name, _ in chosen}
    return order + [F.col(f"`{k}`").asc_nulls_last() for k in spec.key_columns if k not in sorted_by]


def view(df: DataFrame, spec: TableSpec, text: str = "", filters: Sequence[Filter] = ()) -> DataFrame:
    return apply_filters(search(df, text, spec), filters)


@dataclass(frozen=True)
class PageInfo:
    total_rows: int
    total_pages: int
    page: int
    size: int

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.size


def page_info(total_rows: int, page: int, size: int = PAGE_SIZE) -> PageInfo:
    pages = max(-(-total_rows // size), 1)
    return PageInfo(total_rows, pages, min(max(page, 1), pages), size)


def slice_rows(df: DataFrame, order: Sequence[Column], offset: int, size: int, deep: int | None = None) -> DataFrame:
    """Rows from ``offset`` on. Up to ``deep`` they come from a top-k; beyond, no task could hold all rows before them.

    Then the sorted rows are written as range-partitioned files, whose counts tell which one or two files hold the slice.
    """
    if offset <= (DEEP_OFFSET if deep is None else deep):
        return df.orderBy(*order).offset(offset).limit(size)
    path = scratch(df.sparkSession, "sorted")
    # Rows that are equal in all sort columns may lie in any order; the number lets them spread over files.
    df.withColumn("_n", F.monotonically_increasing_id()).orderBy(*order, "_n").write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    counts = written.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"))
    in_order = F.regexp_extract("f", r"part-(\d+)[^/]*$", 1).cast("int")
    files = counts.orderBy(in_order, "f").collect()
    before, wanted, skipped = 0, [], 0
    for file in files:
        if before + file.n <= offset:
            skipped = before + file.n
        elif before < offset + size:
            wanted.append(file.f)
        before += file.n
    if not wanted:
        return df.limit(0)
    rows = df.sparkSession.read.schema(written.schema).parquet(*wanted)
    return rows.orderBy(*order, "_n").offset(offset - skipped).limit(size).drop("_n")


def page_rows(df: DataFrame, order: Sequence[Column], page: int, size: int = PAGE_SIZE, total: int | None = None) -> DataFrame:
    """One page, the page number clamped to those there are."""
    info = page_info(df.count() if total is None else total, page, size)
    return slice_rows(df, order, info.offset, info.size)


def page_after(df: DataFrame, key: Sequence[str], last: Sequence[object], size: int = PAGE_SIZE) -> DataFrame:
    """The page after a known last key, ascending: deep pages cost no more than the first."""
    here = F.struct(*[F.col(k) for k in key])
    bound = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, last, strict=True)])
    first = F.col(key[0]) >= F.lit(last[0]).cast(df.schema[key[0]].dataType)
    return df.filter(first & (here > bound)).orderBy(*key).limit(size)


def page_metadata(df: DataFrame, spec: TableSpec, page: int, size: int = PAGE_SIZE, sorts: Sequence[Sort] = (), filters: Sequence[Filter] = ()) -> DataFrame:
    """One row: total rows and pages, the page shown, the active filters and sorts."""
    pages = F.greatest(F.ceil(F.col("total_rows") / size), F.lit(1))
    shown = F.least(F.lit(max(page, 1)), F.col("total_pages"))
    labels = ", ".join(f"{f.column} {f.op}:{f.value}" for f in filters)
    order = ", ".join(f"{c} {d}" for c, d in effective_sorts(sorts, spec))
    return (
        df.agg(F.count("*").alias("total_rows"))
        .withColumn("total_pages", pages)
        .withColumn("page", shown)
        .withColumn("active_filters", F.lit(labels))
        .withColumn("sorts", F.lit(order))
    )


def column_profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Sum, average, min, max and count of every numeric column: one pass, one row per column."""
    columns = spec.of_type(FieldType.NUMERIC)
    number = "decimal(28,10)"
    if not columns:
        names = "column_name string, sum decimal(38,10), avg decimal(38,10), min decimal(28,10), max decimal(28,10), count bigint"
        return df.sparkSession.createDataFrame([], names)
    measures = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.sum(F.col(f"`{f.column}`").cast(number)).alias("sum"),
            F.avg(F.col(f"`{f.column}`").cast(number)).alias("avg"),
            F.min(F.col(f"`{f.column}`").cast(number)).alias("min"),
            F.max(F.col(f"`{f.column}`").cast(number)).alias("max"),
            F.count(f"`{f.column}`").alias("count"),
        )
        for f in columns
    ]
    return df.agg(F.array(*measures).alias("p")).select(F.inline_outer("p"))


@dataclass(frozen=True)
class SavedView:
    """Search, filters, sorts and visible columns under one name."""

    spec: TableSpec
    text: str = ""
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    columns: tuple[str, ...] = ()

    def rows(self, df: DataFrame) -> DataFrame:
        return view(df, self.spec, self.text, self.filters)

    def apply(self, df: DataFrame) -> DataFrame:
        shown = [self.spec.resolve(c) for c in self.columns] or [f.column for f in self.spec.fields]
        return self.rows(df).orderBy(*ordering(self.sorts, self.spec)).select(*[F.col(f"`{c}`") for c in shown])
