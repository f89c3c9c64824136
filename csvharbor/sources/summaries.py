"""What a batch's columns hold, as small rows that can be merged: counts, sums, extremes and sketches.

A row describes one column of one upload in one batch at one generation; the commit log and the state of the uploads tell
which rows count. Merged, they give a table's counts and profile without a look at its rows.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.specs import FieldType, TableSpec

NUMBER = "decimal(28,10)"
LOG2_REGISTERS = 14
SUMMARY = (
    "upload_id string, column_name string, kind string, n bigint, present bigint, sum decimal(38,10), least decimal(28,10), greatest decimal(28,10),"
    " first string, last string, distinct binary, spread binary, batch string, gen int"
)


def _measured(spec: TableSpec) -> list[Column]:
    """One struct of aggregates per column."""
    out = []
    for f in spec.fields:
        c = F.col(f"`{f.column}`")
        number = c.cast(NUMBER) if f.type is FieldType.NUMERIC else F.lit(None).cast(NUMBER)
        text = F.lit(None).cast("string") if f.type is FieldType.NUMERIC else c.cast("string")
        spread = F.kll_sketch_agg_double(c.cast("double")) if f.type is FieldType.NUMERIC else F.lit(None).cast("binary")
        out.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.type.value).alias("kind"),
                F.count("*").alias("n"),
                F.count(c).alias("present"),
                F.sum(number).alias("sum"),
                F.min(number).alias("least"),
                F.max(number).alias("greatest"),
                F.min(text).alias("first"),
                F.max(text).alias("last"),
                F.hll_sketch_agg(c.cast("string"), LOG2_REGISTERS).alias("distinct"),
                spread.alias("spread"),
            )
        )
    return out


def summarized(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of batches (the table's columns, upload_id, batch, gen) to their summaries: one pass, partial results meet."""
    per_upload = rows.groupBy("batch", "gen", "upload_id").agg(F.array(*_measured(spec)).alias("c"))
    return per_upload.select("upload_id", F.inline("c"), "batch", "gen")


def merged(summaries: DataFrame) -> DataFrame:
    """One row per column over any number of summaries."""
    return summaries.groupBy("column_name", "kind").agg(
        F.sum("n").alias("n"),
        F.sum("present").alias("present"),
        F.sum("sum").alias("sum"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("spread").alias("spread"),
    )


def row_count(summaries: DataFrame, spec: TableSpec) -> DataFrame:
    """Table key and row count; every column counts all rows, so one of them is asked."""
    one = summaries.filter(F.col("column_name") == spec.fields[0].name)
    return one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count")).select(F.lit(spec.key).alias("table_key"), "row_count")


def numeric_profile(summaries: DataFrame, spec: TableSpec) -> DataFrame:
    """The profile of every numeric column, as a pass over all rows gives it."""
    wanted = [f.name for f in spec.of_type(FieldType.NUMERIC)]
    names = summaries.sparkSession.createDataFrame([(n,) for n in wanted], "column_name string")
    found = names.join(F.broadcast(merged(summaries.filter(F.col("kind") == FieldType.NUMERIC.value))), "column_name", "left")
    count = F.coalesce("present", F.lit(0))
    rest = F.col("sum") % count  # divided apart, so that the average keeps its 14 digits
    average = F.when(count > 0, (((F.col("sum") - rest) / count).cast("decimal(18,0)") + rest / count).cast("decimal(32,14)"))
    return found.select("column_name", "sum", average.alias("avg"), F.col("least").alias("min"), F.col("greatest").alias("max"), count.alias("count"))


def column_facts(summaries: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per column of any type: rows, nulls, extremes as text, about how many different values, and about which quantiles."""
    whole = merged(summaries)
    text = lambda number, other: F.coalesce(F.col(number).cast("string"), F.col(other))
    ranks = F.array(*[F.lit(s) for s in shares])
    return whole.select(
        "column_name",
        F.col("n").alias("rows"),
        (F.col("n") - F.col("present")).alias("nulls"),
        text("least", "first").alias("least"),
        text("greatest", "last").alias("greatest"),
        F.hll_sketch_estimate("distinct").alias("distinct"),
        F.when((F.col("kind") == FieldType.NUMERIC.value) & (F.col("present") > 0), F.kll_sketch_get_quantile_double("spread", ranks)).alias("quantiles"),
    )


@dataclass
class SummaryTable:
    """Summaries as Parquet files by batch and generation; a generation written again replaces what it left before."""

    spark: SparkSession
    path: str
    spec: TableSpec

    def add(self, rows: DataFrame, attempt: str) -> None:
        made = summarized(rows, self.spec).coalesce(1)  # a few rows per upload
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "gen").parquet(self.path)

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SUMMARY).parquet(os.path.join(self.path))
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SUMMARY)
