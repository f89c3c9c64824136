"""Load history and table statistics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from csvharbor.operators.joins import lookup_join
from csvharbor.operators.views import slice_rows

HISTORY_LENGTH = 5
UPLOAD_PAGE_SIZE = 50

UPLOAD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("rows_inserted", T.LongType()),
        T.StructField("rows_skipped", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("csv_headers", T.ArrayType(T.StringType())),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table in one plan."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(k).alias("table_key"), "row_count") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def latest_per(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The newest row per group as an aggregate: partial results meet, not the groups' rows."""
    payload = F.struct(*[c for c in df.columns if c != group])
    newest = df.groupBy(group).agg(F.max_by(payload, F.struct(*order)).alias("r"))
    return newest.select(group, "r.*").select(df.columns)


def newest_per(df: DataFrame, group: str, order: list[str], n: int = HISTORY_LENGTH) -> DataFrame:
    """The newest n rows per group; each partition passes on at most n per group before the shuffle."""
    ranked = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def current_uploads(events: DataFrame) -> DataFrame:
    """State events to one row per upload: the event with the greatest sequence number."""
    return latest_per(events, "id", ["seq"])


def latest_active(uploads: DataFrame) -> DataFrame:
    return latest_per(uploads.filter("status = 'active'"), "name", ["uploaded_at", "id"])


def last_upload(uploads: DataFrame, table_key: str) -> DataFrame:
    """The newest load of one table, whatever its status."""
    return uploads.filter(F.col("name") == table_key).orderBy(F.desc("uploaded_at"), F.desc("id")).limit(1)


def upload_history(uploads: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    return newest_per(uploads, "name", ["uploaded_at", "id"], n)


def with_latest(counts: DataFrame, uploads: DataFrame) -> DataFrame:
    """Counts by table beside the newest active load of each."""
    last = latest_active(uploads).select(F.col("name").alias("table_key"), "file_name", "rows_inserted", "rows_skipped", "uploaded_at")
    return counts.join(last, "table_key", "left")


def table_stats(tables: Mapping[str, DataFrame], uploads: DataFrame) -> DataFrame:
    return with_latest(table_counts(tables), uploads)


def failed_counts(failed: DataFrame) -> DataFrame:
    return failed.groupBy("upload_id").agg(F.count("*").alias("n_failed"))


def failed_page(failed: DataFrame, upload_id: str, page: int, size: int = UPLOAD_PAGE_SIZE) -> DataFrame:
    """Failed rows of one upload by line number."""
    mine = failed.filter(F.col("upload_id") == upload_id)
    return slice_rows(mine, [F.col("line_number")], (max(page, 1) - 1) * size, size)


def with_upload(rows: DataFrame, uploads: DataFrame) -> DataFrame:
    """Rows beside the load they came from."""
    about = uploads.select(F.col("id").alias("upload_id"), "file_name", "status", "uploaded_at")
    return lookup_join(rows, about, ["upload_id"])
