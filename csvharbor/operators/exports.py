"""CSV exports written by the executors, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvharbor.functions.formats import export_value
from csvharbor.operators.filters import Filter
from csvharbor.operators.views import ordering, view
from csvharbor.specs import TableSpec


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 files; part files in name order hold the rows in order."""
    df.write.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode(
        "errorifexists"
    ).csv(path)


def export_view(table: DataFrame, spec: TableSpec, text: str = "", filters: Sequence[Filter] = ()) -> DataFrame:
    """The rows a view shows, as text under display names, by the first column ascending."""
    rows = view(table, spec, text, filters).orderBy(*ordering([], spec))
    return rows.select(*[export_value(F.col(f"`{f.column}`"), f.type).alias(f.name) for f in spec.fields])


def export_failed(failed: DataFrame, upload_id: str, header: Sequence[str]) -> DataFrame:
    """Failed rows of one upload for repair: line, error, then the cells under the file's own header."""
    if not header:
        raise ValueError("export unavailable: the upload has no stored header")
    cells = [F.coalesce(F.get("row_data", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)]
    mine = failed.filter(F.col("upload_id") == upload_id).orderBy("line_number")
    return mine.select(F.col("line_number").alias("_line"), F.col("reason").alias("_error"), *cells)
