"""Tables as committed batches of Parquet files.

Data of a batch is written first, under ``<table>/batch=<id>/gen=<n>``; nobody sees it until a row
naming it is appended to the commit log. One append may name batches of several tables, so a load's
rows, its record and its audit entries appear together or not at all. A change writes a further
generation of the batches it touches and leaves all others alone.

A store may keep side tables: where keys lie, and summaries of columns. They follow the commit log: what
is committed never changes, so ``settle`` adds what they lack at any time, and a reader takes batches that
they do not cover yet from the rows themselves.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from csvharbor.operators.audit import ARCHIVE_SCHEMA, AUDIT_SCHEMA
from csvharbor.operators.history import UPLOAD_SCHEMA, current_uploads
from csvharbor.operators.joins import distinct_keys, lookup_join, small_side
from csvharbor.operators.views import PAGE_SIZE, Sort, ordering, page_info, slice_rows
from csvharbor.session import cut
from csvharbor.sources import grams
from csvharbor.sources.grams import GramTable
from csvharbor.sources.keys import BUCKETS, KeyTable
from csvharbor.sources.orders import OrderTable
from csvharbor.sources.summaries import SummaryTable, summarized
from csvharbor.specs import Registry

COMMIT_SCHEMA = "table_key string, batch string, gen int"
COVER_SCHEMA = "side string, batch string, gen int, attempt string"
MOST_NAMED = 10_000
PLACE = [T.StructField("batch", T.StringType()), T.StructField("gen", T.IntegerType())]
OUTCOME = T.StructField("outcome", T.StringType())
LOAD_COLUMNS = [
    T.StructField("upload_id", T.StringType()),
    T.StructField("line_number", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("row_data", T.ArrayType(T.StringType())),
]


def failed_key(table: str) -> str:
    """Under this name the commit log counts generations of a table's rejected rows."""
    return f"{table}/failed"


LOG_SCHEMAS = {"uploads": UPLOAD_SCHEMA, "audit_log": AUDIT_SCHEMA, "audit_log_archive": ARCHIVE_SCHEMA}


def named(rows: DataFrame) -> list[str] | None:
    """The batches that rows name, for a read of their files alone; None if there are too many to list."""
    names = [r.batch for r in rows.select("batch").distinct().limit(MOST_NAMED + 1).collect()]
    return names if len(names) <= MOST_NAMED else None


@dataclass
class Store:
    spark: SparkSession
    root: str
    registry: Registry
    keyed: bool = False
    summarized: bool = False
    searched: bool = False
    sorted_by: Mapping[str, Sequence[tuple[Sort, ...]]] = field(default_factory=dict)
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        # An empty append leaves a readable log for a new store and changes nothing in an old one.
        self.spark.createDataFrame([], COMMIT_SCHEMA).write.mode("append").parquet(self.path("_commits"))

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _schema(self, table: str) -> T.StructType:
        if table in LOG_SCHEMAS:
            return T.StructType([*LOG_SCHEMAS[table].fields, *PLACE])
        return T.StructType([*LOAD_COLUMNS, *self.registry.get(table).schema().fields, *PLACE, OUTCOME])

    def write(self, table: str, batch: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """First generation of a batch; a retry of the same batch replaces what an earlier try left."""
        path = self.path(table, f"batch={batch}", "gen=0")
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)

    def commits(self) -> DataFrame:
        """Current generation of every batch."""
        log = self.spark.read.schema(COMMIT_SCHEMA).parquet(self.path("_commits"))
        return log.groupBy("table_key", "batch").agg(F.max("gen").alias("gen"))

    def is_committed(self, table: str, batch: str) -> bool:
        here = (F.col("table_key") == table) & (F.col("batch") == batch)
        return not self.commits().filter(here).isEmpty()

    def commit(self, places: Iterable[tuple[str, str, int]] | DataFrame) -> None:
        rows = places if isinstance(places, DataFrame) else self.spark.createDataFrame(list(places), COMMIT_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(self.path("_commits"))

    def _read(self, schema: T.StructType | str, *parts: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(*parts))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _files(self, table: str, batches: Sequence[str] | None = None) -> DataFrame:
        """Whatever lies there; with ``batches``, no other batch's files are opened."""
        found = self._read(self._schema(table), table)
        return found if batches is None else found.filter(F.col("batch").isin(list(batches)))

    def _places(self, table: str) -> DataFrame:
        return self.commits().filter(F.col("table_key") == table).select("batch", "gen")

    def current(self, table: str, batches: Sequence[str] | None = None) -> DataFrame:
        """Rows of every committed batch at its current generation, with batch and generation."""
        return self._files(table, batches).join(small_side(self._places(table)), ["batch", "gen"], "left_semi")

    def log(self, table: str) -> DataFrame:
        return self.current(table).select(LOG_SCHEMAS[table].names)

    def uploads(self) -> DataFrame:
        return current_uploads(self.log("uploads"))

    def _active(self, rows: DataFrame) -> DataFrame:
        """Without those of loads that are rolled back."""
        undone = self.uploads().filter("status = 'rolled_back'").select(F.col("id").alias("upload_id"))
        return lookup_join(rows, undone, ["upload_id"], "left_anti")

    def placed_rows(self, table: str, batches: Sequence[str] | None = None) -> DataFrame:
        """Accepted rows of loads that are not rolled back, with their batch and generation."""
        columns = self.registry.get(table).schema().names
        active = self._active(self.current(table, batches).filter("outcome = 'accepted'"))
        return active.select(*[F.col(f"`{c}`") for c in columns], "upload_id", "batch", "gen")

    def rows(self, table: str) -> DataFrame:
        return self.placed_rows(table).drop("batch", "gen")

    def _sides(self, table: str) -> dict[str, KeyTable | SummaryTable | GramTable | OrderTable]:
        spec = self.registry.get(table)
        sides: dict[str, KeyTable | SummaryTable | GramTable | OrderTable] = {}
        if self.keyed:
            sides["keys"] = KeyTable(self.spark, self.path("_keys", table), spec, self.buckets)
        if self.summarized:
            sides["summaries"] = SummaryTable(self.spark, self.path("_summaries", table), spec)
        if self.searched:
            sides["grams"] = GramTable(self.spark, self.path("_grams", table), spec)
        for sorts in self.sorted_by.get(table, ()):
            label = OrderTable.label(sorts)
            sides[label] = OrderTable(self.spark, self.path("_orders", table, label), spec, tuple(sorts))
        return sides

    def _uncovered(self, table: str, side: str) -> DataFrame:
        covered = self._read(COVER_SCHEMA, "_covered", table).filter(F.col("side") == side)
        return self._places(table).join(small_side(covered.select("batch", "gen").distinct()), ["batch", "gen"], "left_anti")

    def _accepted_at(self, table: str, places: DataFrame) -> DataFrame:
        """Accepted rows at the given places, of rolled back loads too."""
        rows = self._files(table, named(places)).filter("outcome = 'accepted'").withColumn("file", F.col("_metadata.file_path"))
        return rows.join(small_side(places), ["batch", "gen"], "left_semi")

    def settle(self, table: str) -> None:
        """Bring the side tables up to the commit log. A stop on the way leaves work to the next call, never wrong rows."""
        for name, side in self._sides(table).items():
            late = cut(self._uncovered(table, name))
            if not late.isEmpty():
                attempt = uuid.uuid4().hex
                side.add(self._accepted_at(table, late), attempt)
                covered = late.select(F.lit(name).alias("side"), "batch", "gen", F.lit(attempt).alias("attempt"))
                covered.coalesce(1).write.mode("append").parquet(self.path("_covered", table))

    def _beside(self, table: str, side: str, kept: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of a side table that count now, and the same ``made`` from batches that it does not cover."""
        late = cut(self._uncovered(table, side))
        covered = self._read(COVER_SCHEMA, "_covered", table).filter(F.col("side") == side)
        places = covered.groupBy("batch", "gen").agg(F.max("attempt").alias("attempt")).join(self._places(table), ["batch", "gen"], "left_semi")
        on = ["batch", "gen", *(["attempt"] if "attempt" in kept.columns else [])]
        found = kept.join(small_side(places.select(on)), on, "left_semi").drop("attempt")
        return found if late.isEmpty() else found.unionByName(made(self._accepted_at(table, late)).select(found.columns))

    def keys(self, table: str, wanted: DataFrame | None = None) -> DataFrame:
        """Key columns, digest, upload_id, batch and gen of the rows there are; keys with a NULL part are left out.

        With few ``wanted`` single-column keys, other keys may be missing: their buckets are not opened.
        """
        side = self._sides(table).get("keys")
        if side is None:
            return KeyTable(self.spark, "", self.registry.get(table)).picked(self.placed_rows(table))
        return self._active(self._beside(table, "keys", side.rows(wanted), side.picked))

    def batches_of(self, table: str, wanted: DataFrame) -> list[str] | None:
        """Names of the batches that hold any of the keys; None (look everywhere) without a key table or if there are very many."""
        return self.batches_with(table, cut(distinct_keys(wanted, self.registry.get(table).key_columns))) if self.keyed else None

    def batches_with(self, table: str, wanted: DataFrame) -> list[str] | None:
        """The same for keys that stand there once each, without NULL parts, as a table that is at hand."""
        if not self.keyed:
            return None
        return named(lookup_join(self.keys(table, wanted), wanted, self.registry.get(table).key_columns, "left_semi"))

    def summaries(self, table: str) -> DataFrame:
        """Summaries of the rows there are, by upload, batch and column."""
        side = self._sides(table).get("summaries")
        if side is None:
            return summarized(self.placed_rows(table), self.registry.get(table))
        return self._active(self._beside(table, "summaries", side.rows(), lambda rows: summarized(rows, side.spec)))

    def rows_like(self, table: str, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of the files that may have a LIKE pattern's text in one of the columns (all text columns, if none are named).

        Files without it are not opened. The caller still has to look for the text in the rows. All rows come back without
        the index, or if the pattern has no three characters in a row, or if very many files may have them.
        """
        side = self._sides(table).get("grams")
        if side is None:
            return self.rows(table)
        late = cut(self._uncovered(table, "grams"))
        files = grams.holding(side.rows(), pattern, list(columns or grams.text_columns(side.spec)))
        if files is None:
            return self.rows(table)
        places = self._places(table)
        few = files.join(small_side(places), ["batch", "gen"], "left_semi").select("file").limit(grams.MOST_FILES + 1).collect()
        if len(few) > grams.MOST_FILES:
            return self.rows(table)
        columns = [*self.registry.get(table).schema().names, "upload_id"]
        held = self._active(self._picked(table, [r.file for r in few])).select(*[F.col(f"`{c}`") for c in columns])
        if late.isEmpty():
            return held
        rest = self._active(self._accepted_at(table, late))
        return held.unionByName(rest.select(*[F.col(f"`{c}`") for c in columns]))

    def page(self, table: str, sorts: Sequence[Sort], page: int, size: int = PAGE_SIZE) -> DataFrame:
        """A page of the sorted table, the page number clamped to those there are.

        For an order named in ``sorted_by`` only the ranges that the page lies in are read; other orders are sorted.
        """
        spec = self.registry.get(table)
        columns, order = [F.col(f"`{f.column}`") for f in spec.fields], ordering(sorts, spec)
        side = self._sides(table).get(OrderTable.label(tuple(sorts)))
        if not isinstance(side, OrderTable):
            rows = self.rows(table)
            info = page_info(rows.count(), page, size)
            return slice_rows(rows.select(*columns), order, info.offset, info.size)
        counts = self._active(self._beside(table, side.label(side.sorts), side.counts(), side.counted))
        per_range = counts.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
        info = page_info(sum(r.n for r in per_range), page, size)
        before, skipped, wanted = 0, 0, []
        for r in per_range:
            if before + r.n <= info.offset:
                skipped = before + r.n
            elif before < info.offset + size:
                wanted.append(r.range)
            before += r.n
        if not wanted:
            return self.rows(table).limit(0).select(*columns)
        first, last = wanted[0], wanted[-1]
        late: Callable[[DataFrame], DataFrame] = lambda rows: side.ranged(rows).filter(F.col("range").between(first, last))
        near = self._active(self._beside(table, side.label(side.sorts), side.rows(first, last), late))
        return slice_rows(near.select(*columns), order, info.offset - skipped, size)

    def _picked(self, table: str, files: list[str]) -> DataFrame:
        """Accepted rows of the given files."""
        schema = self._schema(table)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*files).filter("outcome = 'accepted'")

    def placed_failed(self, table: str) -> DataFrame:
        """Rejected rows with their batch and generation: the first, or a later one that a deletion of theirs has made."""
        commits = self.commits()
        loaded = commits.filter(F.col("table_key") == table).select("batch")
        later = commits.filter(F.col("table_key") == failed_key(table)).select("batch", "gen")
        places = loaded.join(later, "batch", "left").select("batch", F.coalesce("gen", F.lit(0)).alias("gen"))
        rejected = self._files(table).filter("outcome = 'failed'")
        return rejected.join(small_side(places), ["batch", "gen"], "left_semi")

    def failed(self, table: str) -> DataFrame:
        return self.placed_failed(table).select("upload_id", "line_number", "reason", "row_data")

    def staged(self, table: str, batch: str) -> DataFrame:
        """What a batch holds, committed or not."""
        return self._files_of(table, batch).select(*[f.name for f in LOAD_COLUMNS], "outcome")

    def _files_of(self, table: str, batch: str) -> DataFrame:
        base = self.spark.read.schema(self._schema(table)).option("basePath", self.path(table))
        return base.parquet(self.path(table, f"batch={batch}", "gen=0"))

    def rewrite(
        self,
        table: str,
        change: Callable[[DataFrame], DataFrame],
        touched: DataFrame,
        committed: Iterable[tuple[str, str, int]] = (),
        failed: bool = False,
    ) -> None:
        """Next generation of the touched batches; ``committed`` names written batches to publish with it.

        One writer at a time: if the generation that was read is no longer the current one, nothing is committed.
        """
        partitions = ["batch", "gen"] if table in LOG_SCHEMAS else ["batch", "gen", "outcome"]
        touched = cut(touched.select("batch").distinct())
        batches = named(touched)
        if failed:
            current = self.placed_failed(table)
        elif table in LOG_SCHEMAS:
            current = self.current(table, batches)
        else:
            current = self.placed_rows(table, batches).withColumn("outcome", F.lit("accepted"))
        key = failed_key(table) if failed else table
        generations = lambda: self.commits().filter(F.col("table_key") == key)
        places = touched.join(generations().select("batch", "gen"), "batch", "left")
        # A generation that an uncommitted try has left behind is not used again: its rows would be taken for ours.
        left = self._files(table, batches).groupBy("batch").agg(F.max("gen").alias("left"))
        places = places.join(left, "batch", "left").select(
            F.lit(key).alias("table_key"), "batch", F.coalesce("gen", F.lit(0)).alias("gen"), (F.greatest(F.coalesce("gen", F.lit(0)), "left") + 1).alias("next")
        )
        places = cut(places)
        mine = current.drop("gen").join(small_side(places.select("batch", F.col("next").alias("gen"))), "batch").select(current.columns)
        changed = change(mine)
        (
            changed.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions)
            .parquet(self.path(table))
        )
        moved = generations().withColumnRenamed("gen", "now").join(places, ["table_key", "batch"]).filter("now <> gen")
        if not moved.isEmpty():
            raise RuntimeError(f"{table} was changed by another writer meanwhile")
        following = places.select("table_key", "batch", F.col("next").alias("gen"))
        beside = self.spark.createDataFrame(list(committed), COMMIT_SCHEMA)
        self.commit(cut(following.unionByName(beside)))
