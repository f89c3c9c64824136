"""Rows of a table dealt into ranges of a sort order, with exact counts, so that a page opens one or two ranges.

The borders come from a bounded sample of the first rows and stay; they only balance the ranges, up to ``RANGES`` of about
``RANGE_ROWS`` rows. A table that has grown far beyond its first batch is dealt anew by removing the order's folder. Later batches are dealt by
the same borders, so all pages of an order, and all loads, share one table and nothing is sorted as a whole. Like the other
side tables it is kept by batch and generation and follows the commit log.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from csvharbor.operators.views import Sort, effective_sorts
from csvharbor.specs import TableSpec

RANGES = 1024
RANGE_ROWS = 5_000
SAMPLE_ROWS = 20_000
COUNTS = "upload_id string, range int, n bigint, batch string, gen int"
_DIGITS = "0123456789ABCDEF"


def _part(column: str, kind: T.DataType, descending: bool) -> list[Column]:
    """Two values that ascend, or stay equal, as the rows go by in order: where NULL stands, and the value."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        # Turned digits put greater texts first; the mark behind them puts a text after those it is the beginning of.
        value = F.concat(F.translate(F.hex(c), _DIGITS, _DIGITS[::-1]), F.lit("G")) if descending else c
    else:
        number = F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("double")
        value = number.cast("double") * (-1 if descending else 1)
    return [c.isNotNull() if descending else c.isNull(), value]


def sort_key(sorts: Sequence[Sort], spec: TableSpec) -> Column:
    """A struct that compares as the view sorts, apart from ties: the chosen columns, then the unique key."""
    kinds = {f.name: f.dataType for f in spec.schema().fields}
    chosen = [(spec.resolve(name), direction == "desc") for name, direction in effective_sorts(sorts, spec)]
    named = {c for c, _ in chosen}
    columns = chosen + [(k, False) for k in spec.key_columns if k not in named]
    parts = [p for c, descending in columns for p in _part(c, kinds[c], descending)]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def range_of(key: Column, borders: Sequence[Row], kind: T.StructType) -> Column:
    """The number of the first border that the key is not above, by halves."""
    known = F.from_json(F.lit(json.dumps([dict(zip(kind.names, b, strict=True)) for b in borders])), T.ArrayType(kind))  # folded into a constant

    def halved(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        above = F.struct((middle + 1).alias("low"), high.alias("high"))
        below = F.struct(low.alias("low"), middle.alias("high"))
        return F.when(low >= high, state).when(key > F.get(known, middle), above).otherwise(below)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high"))
    steps = F.array(*map(F.lit, range(len(borders).bit_length() + 1)))
    return F.aggregate(steps, start, halved, lambda state: state["low"])


@dataclass
class OrderTable:
    spark: SparkSession
    path: str
    spec: TableSpec
    sorts: tuple[Sort, ...]

    @staticmethod
    def label(sorts: Sequence[Sort]) -> str:
        return "order-" + hashlib.sha256(repr(list(sorts)).encode()).hexdigest()[:12]

    def _read(self, name: str, schema: T.StructType | str | None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(os.path.join(self.path, name))
        except AnalysisException as none:
            if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _borders(self, rows: DataFrame | None = None) -> list[Row]:
        """The borders that were written once; without any, and with rows, those of a sample of them."""
        known = self._read("borders", None)
        if known is not None:
            return [r.key for r in known.filter("at >= 0").orderBy("at").collect()]
        if rows is None:
            return []
        keys = rows.select(sort_key(self.sorts, self.spec).alias("key"))
        n = keys.count()
        if not n:
            return []
        sample = sorted(r.key for r in keys.sample(min(1.0, SAMPLE_ROWS / n), 17).collect())
        ranges = max(1, min(RANGES, n // RANGE_ROWS))
        borders = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
        schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("key", keys.schema["key"].dataType)])
        self.spark.createDataFrame([(-1, None), *enumerate(borders)], schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(self.path, "borders"))
        return borders

    def ranged(self, rows: DataFrame, borders: list[Row] | None = None) -> DataFrame:
        key = sort_key(self.sorts, self.spec)
        kind = rows.select(key.alias("key")).schema["key"].dataType
        return rows.withColumn("_key", key).withColumn("range", range_of(F.col("_key"), self._borders() if borders is None else borders, kind)).drop("_key")

    def counted(self, rows: DataFrame) -> DataFrame:
        return self.ranged(rows).groupBy("upload_id", "range", "batch", "gen").agg(F.count("*").alias("n"))

    def add(self, rows: DataFrame, attempt: str) -> None:
        columns = [F.col(f"`{f.column}`") for f in self.spec.fields]
        dealt = self.ranged(rows, self._borders(rows)).select(*columns, "upload_id", "batch", "gen", "range")
        # Large ranges are split over tasks, small ones share them.
        dealt = dealt.hint("rebalance", "range")
        path = os.path.join(self.path, "rows")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "gen", "range").parquet(path)
        counts = rows.select("batch", "gen").distinct().join(self.rows(), ["batch", "gen"]).groupBy("upload_id", "range", "batch", "gen").agg(F.count("*").alias("n"))
        counts = counts.select("upload_id", F.col("range").cast("int"), "n", "batch", "gen").coalesce(1)
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "gen").parquet(os.path.join(self.path, "counts"))

    def rows(self, first: int | None = None, last: int | None = None) -> DataFrame:
        schema = T.StructType([*self.spec.schema().fields, T.StructField("upload_id", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("gen", T.IntegerType()), T.StructField("range", T.IntegerType())])
        found = self._read("rows", schema)
        found = self.spark.createDataFrame([], schema) if found is None else found
        return found if first is None else found.filter(F.col("range").between(first, last))

    def counts(self) -> DataFrame:
        found = self._read("counts", COUNTS)
        return self.spark.createDataFrame([], COUNTS) if found is None else found
