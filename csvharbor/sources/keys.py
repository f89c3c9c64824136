"""Where each key of a table lies: a narrow table from key to batch and a digest of the row, in buckets of the key's hash.

A row stands for a key of one batch at one generation, written by one attempt; the log of what is covered names the attempt
that counts, so a stopped one leaves nothing that is read. The buckets are Spark's own: a join on the key columns takes the stored side as it lies, without an exchange, and a lookup of
a few single-column keys opens their buckets only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.specs import TableSpec

BUCKETS = 64
FEW_KEYS = 500
ROWS_PER_FILE = 1_000_000


def quoted(name: str) -> str:
    return f"`{name}`"


def row_digest(spec: TableSpec, of: Column | None = None) -> Column:
    """Equal for rows with one key whose other columns are equal, NULL to NULL; columns are taken from the struct ``of``, if given."""
    parts = []
    for f in spec.fields:
        if f.column not in spec.key_columns:
            c = F.col(quoted(f.column)) if of is None else of.getField(f.column)
            parts += [c.isNull(), c]
    return F.xxhash64(F.lit(0), *parts)


@dataclass
class KeyTable:
    """Key columns, digest, upload_id, batch, gen, attempt. One writer at a time."""

    spark: SparkSession
    path: str
    spec: TableSpec
    buckets: int = BUCKETS

    @property
    def name(self) -> str:
        """The same files have the same name in every session; the session's catalog only learns where they are."""
        return f"csvharbor_keys_{hashlib.sha256(f'{self.path}/{self.buckets}'.encode()).hexdigest()[:24]}"

    def _defined(self) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in self.spec.schema().fields}
        keys = self.spec.key_columns
        columns = ", ".join(f"{quoted(k)} {kinds[k]}" for k in keys)
        names = ", ".join(map(quoted, keys))
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, digest bigint, upload_id string, batch string, gen int, attempt string) USING parquet"
            f" CLUSTERED BY ({names}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self.name

    def picked(self, rows: DataFrame) -> DataFrame:
        """The table's columns of stored rows, one row each, without those whose key has a NULL part."""
        keys = self.spec.key_columns
        named = rows.select(*[F.col(quoted(k)) for k in keys], row_digest(self.spec).alias("digest"), "upload_id", "batch", "gen")
        return named.dropna(subset=keys)

    def add(self, rows: DataFrame, attempt: str) -> None:
        """Keys of written rows (the table's columns, upload_id, batch, gen); the attempt adds a file per bucket, more for many rows.

        A task writes to one bucket alone: its number, modulo the buckets, is the bucket's. The files are not sorted: Spark
        would work out the bucket of both rows in each comparison, and no reader counts on their order.
        """
        parts = 1 + rows.count() // (self.buckets * ROWS_PER_FILE)
        dealt = self.picked(rows).repartition(self.buckets * parts, *[F.col(quoted(k)) for k in self.spec.key_columns])
        dealt.withColumn("attempt", F.lit(attempt)).write.insertInto(self._defined())

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """Every row of every attempt; with at most ``FEW_KEYS`` single-column ``keys``, of those keys only."""
        found = self.spark.table(self._defined())
        self.spark.catalog.refreshTable(self.name)  # another session may have written
        columns = self.spec.key_columns
        if keys is None or len(columns) > 1:
            return found
        few = [r[0] for r in keys.select(quoted(columns[0])).limit(FEW_KEYS + 1).collect()]
        return found if len(few) > FEW_KEYS else found.filter(F.col(quoted(columns[0])).isin(few))
