"""Which files of a table can hold a text: an inverted index from runs of three characters to columns and files.

A file is looked at only if one of its text columns has every run that the searched text is made of; the search itself is then
done on the rows. Like the other side tables it is kept by batch and generation and follows the commit log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.specs import FieldType, TableSpec

WIDTH = 3
POSTINGS = "gram string, column_name string, file string, batch string, gen int"
MOST_FILES = 10_000


def grams(text: Column) -> Column:
    """The different runs of ``WIDTH`` characters of a text in lower case; none of a shorter one."""
    low = F.lower(text)
    starts = F.when(F.char_length(low) >= WIDTH, F.sequence(F.lit(1), F.char_length(low) - (WIDTH - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(WIDTH))))


def fragments(pattern: str) -> list[str]:
    """What a LIKE pattern asks for literally, between its wildcards."""
    parts, at = [""], 0
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern):
            parts[-1] += pattern[at + 1]
            at += 1
        elif pattern[at] in "%_":
            parts.append("")
        else:
            parts[-1] += pattern[at]
        at += 1
    return [p for p in parts if len(p) >= WIDTH]


def text_columns(spec: TableSpec) -> list[str]:
    return [f.column for f in spec.of_type(FieldType.TEXT)]


@dataclass
class GramTable:
    """Postings gram, column, file, sorted by gram, so that a search opens few row groups of them."""

    spark: SparkSession
    path: str
    spec: TableSpec

    def add(self, rows: DataFrame, attempt: str) -> None:
        """Postings of written rows; ``file`` is the file that holds the row. Equal postings meet before they move."""
        columns = [F.struct(F.lit(c).alias("column_name"), grams(F.col(f"`{c}`")).alias("grams")) for c in text_columns(self.spec)]
        if not columns:
            return
        held = rows.select("file", "batch", "gen", F.inline(F.array(*columns)))
        postings = held.select(F.explode("grams").alias("gram"), "column_name", "file", "batch", "gen").distinct()
        sorted_ = postings.repartition("batch", "gen", F.substring("gram", 1, 1)).sortWithinPartitions("batch", "gen", "gram")
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "gen").parquet(self.path)

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(POSTINGS).parquet(self.path)
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], POSTINGS)


def holding(postings: DataFrame, pattern: str, columns: list[str]) -> DataFrame | None:
    """Files of which one of the columns has every run of the pattern; None if the pattern has no run to look for."""
    asked = fragments(pattern)
    if not asked:
        return None
    spark = postings.sparkSession
    found = spark.createDataFrame([(a,) for a in asked], "text string").select(F.explode(grams(F.col("text"))).alias("gram")).distinct().collect()
    wanted = [r.gram for r in found]  # as many as the pattern is long
    hits = postings.filter(F.col("gram").isin(wanted) & F.col("column_name").isin(columns))
    per_column = hits.groupBy("file", "column_name", "batch", "gen").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted))
    return per_column.select("file", "batch", "gen").distinct()
